"""Recordings attached to people: validated, matched by phone, people made where none is known."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.normalise import phone_key, stripped
from rollcall.operators.resolve import SHOWN, STEP, dense_ids
from rollcall.sources.specs import LARGEST_UPLOAD, LONGEST_NAME, MEDIA_EXTENSIONS

#: New people come after all that a merge makes.
NEW_RANK = 4


def media_type(raw: Column) -> Column:
    return F.lower(stripped(F.split_part(F.coalesce(raw, F.lit("")), F.lit(";"), F.lit(1))))


def validated(submissions: DataFrame) -> DataFrame:
    """phone_key, media type, extension, mode, and ``reason``: the first rule broken, or NULL."""
    rows = submissions.withColumns({"clean_name": stripped(F.coalesce("name", F.lit(""))), "typed_phone": stripped(F.coalesce("phone", F.lit(""))), "phone_key": phone_key(F.col("phone")), "media": media_type(F.col("content_type"))})
    extensions = F.create_map(*[F.lit(x) for x in chain(*MEDIA_EXTENSIONS.items())])
    rows = rows.withColumn("extension", F.try_element_at(extensions, F.col("media")))
    reason = (
        F.when(F.col("clean_name") == "", "name_missing")
        .when(F.length("clean_name") > LONGEST_NAME, "name_too_long")
        .when(F.col("typed_phone") == "", "phone_missing")
        .when(F.col("phone_key").isNull(), "phone_too_short")
        .when(F.coalesce("original_filename", F.lit("")) == "", "file_missing")
        .when(F.col("extension").isNull(), "type_not_accepted")
        .when(F.coalesce("byte_size", F.lit(0)) <= 0, "file_empty")
        .when(F.col("byte_size") > LARGEST_UPLOAD, "file_too_large")
    )
    mode = F.when(F.col("capture_mode").isin("record", "upload"), F.col("capture_mode")).otherwise("upload")
    return rows.withColumn("reason", reason).withColumn("mode", mode)


@dataclass
class Intake:
    """attached: accepted rows with their person; made: the new people; phones: of each submitted phone that several people have: how many, and the first of them; holders: all of these people."""

    attached: DataFrame
    made: DataFrame
    phones: DataFrame
    holders: DataFrame

    def ambiguous(self) -> DataFrame:
        """One issue for each accepted submission whose phone several people have."""
        return self.attached.join(self.phones, "phone_key").select("submission_id", "phone_key", F.col("typed_phone").alias("raw_value"), "holders", "ids")

    def created(self) -> DataFrame:
        """One issue for each person made."""
        return self.made.select("person_id", F.col("primary_phone").alias("phone_key"), "raw_value", F.lit("person_created_from_audio_submission").alias("issue_type"))


def lowest_holders(people: DataFrame) -> DataFrame:
    """phone_key, known: the lowest id of the people with that phone."""
    return people.where("primary_phone is not null").groupBy(F.col("primary_phone").alias("phone_key")).agg(F.min("person_id").alias("known"))


def attach_known(accepted: DataFrame, lowest: DataFrame, order: str = "created_seq", start: int = 0) -> tuple[DataFrame, DataFrame]:
    """Accepted submissions with their person, and the people made for phones that nobody in ``lowest`` has.

    New people are numbered on from ``start`` in the order of their first submissions (then
    of the phones), so ids are distinct and never null whatever the submissions' own ids are, and
    the same each time.
    """
    matched = accepted.join(lowest, "phone_key", "left")
    first = F.min(F.struct(F.col(order).alias("at"), "submission_id", "clean_name", "typed_phone"))
    made = matched.where("known is null").groupBy("phone_key").agg(first.alias("f")).select("phone_key", "f.*")
    made = dense_ids(made, "at", "submission_id", "phone_key", name="number", start=start)
    made = made.select((F.lit(NEW_RANK * STEP) + F.col("number")).alias("person_id"), F.col("clean_name").alias("full_name"), F.col("phone_key").alias("primary_phone"), F.lit("audio_app").alias("source_origin"), F.col("typed_phone").alias("raw_value"))
    whole = matched.join(made.select(F.col("primary_phone").alias("phone_key"), F.col("person_id").alias("new")), "phone_key", "left")
    return whole.withColumn("person_id", F.coalesce("known", "new")).drop("known", "new"), made


def attach(submissions: DataFrame, people: DataFrame, order: str = "created_seq", lowest: DataFrame | None = None) -> Intake:
    """Each accepted submission's person: the lowest id with its phone, else one made for the phone.

    ``lowest`` (see :func:`lowest_holders`) spares the people's shuffle where an index has it.
    """
    accepted = validated(submissions).where("reason is null")
    held = people.where("primary_phone is not null").select(F.col("primary_phone").alias("phone_key"), "person_id")
    attached, made = attach_known(accepted, lowest_holders(people) if lowest is None else lowest, order)
    # Of the people of one phone the first SHOWN are gathered, cut before the shuffle; all of them are rows of ``holders``.
    several = held.groupBy("phone_key").agg(F.count("*").alias("holders")).where("holders > 1").join(accepted.select("phone_key").distinct(), "phone_key", "left_semi")
    holders = held.join(several, "phone_key").select("phone_key", "person_id")
    few = holders.withColumn("i", F.row_number().over(Window.partitionBy("phone_key").orderBy("person_id"))).where(F.col("i") <= SHOWN)
    ids = few.groupBy("phone_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("person_id")), lambda i: i.cast("string")), "|").alias("ids"))
    more = F.when(F.col("holders") > SHOWN, F.format_string("|and %d more", F.col("holders") - SHOWN)).otherwise("")
    phones = several.join(ids, "phone_key").withColumn("ids", F.concat("ids", more))
    return Intake(attached, made, phones, holders)


def listing(attached: DataFrame, people: DataFrame, measured: DataFrame, newest: int | None = None) -> DataFrame:
    """Every accepted submission with its person (its place is in ``created_seq``); with ``newest`` only so many, cut before anything is joined."""
    page = attached if newest is None else attached.orderBy(F.desc("created_seq"), F.desc("submission_id")).limit(newest)
    who = people.select("person_id", "full_name", "source_origin")
    out = page.join(who, "person_id").join(measured.select("submission_id", "sample_rate_hz", "bitrate_bps"), "submission_id", "left")
    return out.select(
        "submission_id", "created_seq", "person_id", "full_name", (F.col("sample_rate_hz") / 1000).alias("khz"), F.floor(F.col("bitrate_bps") / 1000).alias("kbps"),
        F.when(F.col("typed_phone") != F.col("phone_key"), F.col("phone_key")).alias("matched_as"), F.when(F.col("source_origin") == "audio_app", "new").otherwise("known").alias("origin"),
    )
