"""Is an incoming row already known?  By phone first, then by email."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.normalise import email_key, phone_key


# The two sentences of the alert.
SOME_KNOWN = "%d of %d incoming rows already exist in the database."
NONE_KNOWN = "No duplicates. All %d rows are new people."
#: Slots that keys are counted in; a slot is hot that holds more than so many rows and more than one row in so many.
SLOTS, HOT_ROWS, HOT_SHARE = 1 << 16, 50_000, 256


def key_index(people: DataFrame, column: str, key: str, prefix: str) -> DataFrame:
    """Of each key the person with the lowest id; NULL keys aren't indexed."""
    first = F.min(F.struct("person_id", "full_name", "source_origin"))
    return people.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(first.alias(prefix))


def key_indexes(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The people by phone and by email."""
    return key_index(people, "primary_phone", "phone_key", "by_phone"), key_index(people, "primary_email", "email_key", "by_email")


def looked_up(incoming: DataFrame, people: DataFrame) -> DataFrame:
    """D01-D03 against :func:`key_indexes` of ``people``, made for this batch."""
    return looked_up_in(incoming, *key_indexes(people))


def with_both_columns(incoming: DataFrame) -> DataFrame:
    """A batch without either column is an error; one column alone will do."""
    if not {"phone", "email"} & set(incoming.columns):
        raise ValueError("a batch needs a column phone or a column email")
    for name in ("phone", "email"):
        if name not in incoming.columns:
            incoming = incoming.withColumn(name, F.lit(None).cast("string"))
    return incoming


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def hot_slots(keyed: DataFrame, *keys: str) -> dict[str, list[int]]:
    """Of each key column the slots of keys that very many rows share; fewer than ``HOT_SHARE`` numbers a column come to the driver."""
    of = [F.struct(F.lit(key).alias("key"), F.when(F.col(key).isNotNull(), slot(F.col(key))).alias("slot")) for key in keys]
    counts = keyed.select(F.inline(F.array(*of))).where("slot is not null").groupBy("key", "slot").agg(F.count("*").alias("n"))
    counts = counts.withColumn("all", F.sum("n").over(Window.partitionBy("key")))
    found = counts.where((F.col("n") > HOT_ROWS) & (F.col("n") * HOT_SHARE > F.col("all"))).collect()
    return {key: sorted(r.slot for r in found if r.key == key) for key in keys}


def looked_up_in(incoming: DataFrame, by_phone: DataFrame, by_email: DataFrame) -> DataFrame:
    """Incoming rows with status, matched_on, person and a note where no key was usable.

    A row with neither value (both NULL) is rejected; one whose values are no keys is new, with a note.
    Rows meet people by key.  Rows without a key are dealt out by what they hold, and so are
    those of keys that very many rows share (a placeholder): the people of these keys' slots, under 1 in 256 of all, are broadcast.
    So no task takes more than its share, whatever the keys.
    """
    keyed = with_both_columns(incoming).withColumn("phone_key", phone_key(F.col("phone"))).withColumn("email_key", email_key(F.col("email")))
    own = F.xxhash64(*[F.col(f.name) for f in keyed.schema if "map<" not in f.dataType.simpleString()])
    nowhere = F.concat(F.lit(" "), own.cast("string"))  # no key begins with a space
    both, hot = keyed, hot_slots(keyed, "phone_key", "email_key")
    for index, key, person in ((by_phone, "phone_key", "by_phone"), (by_email, "email_key", "by_email")):
        at = F.col(key)
        if hot[key]:
            few = index.where(slot(at).isin(hot[key])).select(at.alias("__shared"), F.col(person).alias("__person"))
            both = both.join(F.broadcast(few), at == F.col("__shared"), "left").drop("__shared")
            at = F.when(~slot(at).isin(hot[key]), at)
        both = both.join(index.withColumnRenamed(key, "__known"), F.coalesce(at, nowhere) == F.col("__known"), "left").drop("__known")
        if hot[key]:
            both = both.withColumn(person, F.coalesce(person, "__person")).drop("__person")
    person = F.coalesce("by_phone", "by_email")
    out = both.withColumn("person", person).withColumn("matched_on", F.when(F.col("by_phone").isNotNull(), "phone").when(F.col("by_email").isNotNull(), "email"))
    nothing = F.col("phone").isNull() & F.col("email").isNull()
    note = F.when(nothing, "neither phone nor email").when(F.col("phone_key").isNull() & F.col("email_key").isNull(), "no usable key")
    status = F.when(nothing, "rejected").when(F.col("person").isNotNull(), "duplicate").otherwise("new")
    return out.withColumn("status", status).withColumn("note", note).drop("by_phone", "by_email")


def alert(checked: DataFrame) -> DataFrame:
    """One row: checked (without rejected rows), duplicates, new, rejected, message."""
    out = checked.agg(F.count_if(F.col("status") != "rejected").alias("checked"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "new").alias("new"))
    return out.withColumn("alert", F.when(F.col("duplicates") > 0, F.format_string(SOME_KNOWN, "duplicates", "checked")).otherwise(F.format_string(NONE_KNOWN, "checked")))


def collisions(checked: DataFrame) -> DataFrame:
    """The duplicates, and with whom they collide; a blank email is NULL."""
    return checked.where("status = 'duplicate'").select("row_no", "name", F.col("phone").alias("submitted_phone"), F.nullif("email", F.lit("")).alias("submitted_email"), "matched_on", F.col("person.person_id").alias("person_id"), F.col("person.full_name").alias("full_name"))


def outcome(checked: DataFrame) -> DataFrame:
    """The outcome in words."""
    hit = F.concat(F.col("matched_on"), F.lit(" -> #"), F.col("person.person_id").cast("string"), F.lit(" "), F.coalesce("person.full_name", F.lit("")))
    return checked.select("row_no", "status", F.when(F.col("status") == "duplicate", hit).otherwise(F.coalesce("note", F.lit("not in database"))).alias("expected"))
