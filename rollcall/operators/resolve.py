"""Entity resolution on exact phone and email keys, never on names.

One shuffle of the bridge by phone makes the people; one by email makes the
index that the email source joins.  Struct minima and maxima do survivorship, so
hot keys shrink before the shuffle.  Of a merged group the first few lines are
shown with the issue; all of them are rows of a table.  NULL keys stay out of joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import normalise as N
from rollcall.sources.tables import durable, side_by_side

#: Ids keep the order of creation: bridge groups by first line, then orphans of gigs and of contacts by line.
STEP = 1 << 40
BRIDGE_RANK, GIGS_RANK, CONTACTS_RANK = 1, 2, 3
#: Lines of a merged group that its issue shows.
SHOWN = 10


def person_id(rank: int, line: Column) -> Column:
    """An id that orders as people were made, without a global sort; lines of several files are numbered through them first."""
    return F.lit(rank * STEP) + line


def read_bridge(bridge: DataFrame) -> DataFrame:
    """Bridge rows with their normalised columns."""
    out = bridge.withColumns({"phone_key": N.phone_key(F.col("phone")), "email_key": N.email_key(F.col("email")), "city_norm": N.city(F.col("city")), "experience_years": N.plain_number(F.col("experience")), "ctc_parsed": N.ctc(F.col("ctc")), "date_parsed": N.applied_date(F.col("applied_date")), "skill_list": N.skills(F.col("skills"))})
    return out.withColumn("group_key", F.coalesce("phone_key", F.concat(F.lit("row-"), F.col("line_no").cast("string"))))


def read_gigs(gigs: DataFrame) -> DataFrame:
    return gigs.withColumns({"email_key": N.email_key(F.col("email")), "city_norm": N.city(F.col("city")), "rate_parsed": N.rate(F.col("rate")), "status_norm": N.status(F.col("status")), "skill_list": N.skills(F.col("skills")), "name_key": N.name_key(F.col("full_name"))})


def read_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.withColumns({"phone_key": N.phone_key(F.col("phone")), "city_norm": N.city(F.col("city")), "verified_norm": N.verified(F.col("verified")), "projects_norm": N.plain_whole(F.col("projects")), "name_key": N.name_key(F.col("full_name"))})


def bridge_groups(b: DataFrame) -> DataFrame:
    """One row a group; name and email by length then alphabet, the rest from the first line."""
    first = F.min_by(F.struct("phone_key", "city", "city_norm", "experience_years", "ctc", "ctc_parsed", "applied_date", "date_parsed", "skill_list"), "line_no")
    longest = F.min(F.when(F.col("full_name") != "", F.struct((-F.length("full_name")).alias("l"), F.col("full_name").alias("v"))))
    shortest = F.min(F.when(F.col("email_key").isNotNull(), F.struct(F.length("email_key").alias("l"), F.col("email_key").alias("v"))))
    out = b.groupBy("group_key").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), longest.alias("n"), shortest.alias("e"), first.alias("first"))
    return out.select(person_id(BRIDGE_RANK, F.col("first_line")).alias("person_id"), "group_key", "lines", "first_line", F.col("n.v").alias("full_name"), F.col("e.v").alias("primary_email"), "first.*")


def email_index(b: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each email the last group that has it as its primary one, else the first group that has it at all."""
    held = b.where("email_key is not null").select("group_key", "email_key").join(groups.select("group_key", "person_id", "primary_email"), "group_key")
    primary = F.max(F.when(F.col("email_key") == F.col("primary_email"), F.col("person_id")))
    return held.groupBy("email_key").agg(F.coalesce(primary, F.min("person_id")).alias("person_id"))


def attach(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows with the person that holds their key, or NULL; rows without a key are dealt out by line, not to one task."""
    own = F.coalesce(F.col(key), F.concat(F.lit(" "), F.col("line_no").cast("string")))  # no key begins with a space
    return rows.withColumn("__own", own).join(index.withColumnRenamed(key, "__held"), F.col("__own") == F.col("__held"), "left").drop("__own", "__held")


@dataclass
class Resolved:
    """The tables of a merge; gigs and contacts hold each row's person and whether it is an orphan."""

    bridge: DataFrame
    groups: DataFrame
    index: DataFrame
    gigs: DataFrame
    contacts: DataFrame
    #: Normalised gigs and contacts, not yet attached.
    unattached: tuple[DataFrame, DataFrame]

    def fold_gigs(self) -> DataFrame:
        """Of each person the last line's fields, even where they are NULL."""
        last = F.max_by(F.struct(F.col("rate").alias("rate_raw"), F.col("rate_parsed.amount").alias("rate_amount"), F.col("rate_parsed.period").alias("rate_period"), F.col("status_norm").alias("status")), "line_no")
        return self.gigs.groupBy("person_id").agg(last.alias("g")).select("person_id", "g.*")

    def fold_contacts(self) -> DataFrame:
        """Of each person the last line's fields."""
        last = F.max_by(F.struct(F.col("verified_norm").alias("verified"), F.col("projects_norm").alias("projects_completed")), "line_no")
        return self.contacts.groupBy("person_id").agg(last.alias("c")).select("person_id", "c.*")

    def orphans(self) -> DataFrame:
        """People made of rows that match nobody, one a row."""
        none = lambda kind: F.lit(None).cast(kind)
        head = lambda phone, email: ["person_id", "full_name", phone.alias("primary_phone"), email.alias("primary_email"), F.col("city_norm").alias("city"), F.col("city").alias("city_raw")]
        return self.gigs.where("orphan").select(*head(none("string"), F.col("email_key"))).unionByName(self.contacts.where("orphan").select(*head(F.col("phone_key"), none("string"))))

    def settled(self) -> "Resolved":
        """The same with each step written to the checkpoint folder and the next one made from it: sources are read and normalised once, however many results follow."""
        return _merge(durable(self.bridge), *self.unattached, keep=durable)

    def everyone(self) -> DataFrame:
        """Bridge people and orphans, before anything is folded in."""
        seeded = self.groups.select("person_id", "full_name", F.col("phone_key").alias("primary_phone"), "primary_email", F.col("city_norm").alias("city"), F.col("city").alias("city_raw"), "experience_years", F.col("ctc_parsed.amount_inr").alias("ctc_annual_inr"), F.col("ctc").alias("ctc_raw"), F.col("ctc_parsed.unit").alias("ctc_source_unit"), F.col("date_parsed.value").alias("applied_date"), F.col("applied_date").alias("applied_date_raw"))
        return seeded.unionByName(self.orphans(), allowMissingColumns=True)

    def people(self) -> DataFrame:
        """Canonical people: bridge fields, folded fields, orphans."""
        return self.everyone().join(self.fold_gigs(), "person_id", "left").join(self.fold_contacts(), "person_id", "left").withColumn("source_origin", F.lit("csv_merge"))

    def links(self) -> DataFrame:
        """Every staged row's person and how it was matched."""
        row = lambda df, source, method: df.select("person_id", F.lit(source).alias("source_file"), F.col("line_no").alias("source_row_number"), method.alias("match_method"), F.lit(1.0).alias("match_confidence"))
        b = self.bridge.join(self.groups.select("group_key", "person_id", "first_line"), "group_key")
        seed = lambda other: F.when(F.col("orphan"), "seed").otherwise(other)
        return (
            row(b, "bridge", F.when(F.col("line_no") == F.col("first_line"), "seed").otherwise("exact_phone"))
            .unionByName(row(self.gigs, "gigs", seed("exact_email")))
            .unionByName(row(self.contacts, "contacts", seed("exact_phone")))
        )

    def skills(self) -> DataFrame:
        """Distinct (person, skill): the bridge group's first line, and every gigs row."""
        both = self.groups.select("person_id", "skill_list").unionByName(self.gigs.select("person_id", "skill_list"))
        return both.select("person_id", F.explode("skill_list").alias("skill")).dropDuplicates()

    def city_conflicts(self) -> DataFrame:
        """Attached rows whose city isn't the one of their bridge person."""
        kept = self.groups.select("person_id", F.col("city_norm").alias("kept_city"))
        rows = lambda df, source, column: df.where("not orphan").select("person_id", F.lit(source).alias("source_file"), "line_no", F.lit(column).alias("column_name"), "city", "city_norm")
        attached = rows(self.gigs, "gigs", "location").unionByName(rows(self.contacts, "contacts", "City"))
        return attached.join(kept, "person_id").where(F.col("city_norm") != F.col("kept_city"))

    def unparsed(self) -> DataFrame:
        """Cells that hold something and parse to nothing."""
        cell = lambda column, raw, value: F.struct(F.lit(column).alias("column_name"), raw.alias("raw_value"), value.isNull().alias("empty"))
        rows = lambda df, source, line, cells: df.select(F.lit(source).alias("source_file"), line.alias("line_no"), F.explode(F.array(*cells)).alias("x")).select("source_file", "line_no", "x.*")
        found = (
            rows(self.groups, "bridge", F.col("first_line"), [cell("Current CTC", F.col("ctc"), F.col("ctc_parsed.amount_inr")), cell("Applied Date", F.col("applied_date"), F.col("date_parsed.value"))])
            .unionByName(rows(self.gigs, "gigs", F.col("line_no"), [cell("rate", F.col("rate"), F.col("rate_parsed.amount")), cell("status", F.col("status"), F.col("status_norm"))]))
            .unionByName(rows(self.contacts, "contacts", F.col("line_no"), [cell("Verified", F.col("verified"), F.col("verified_norm"))]))
        )
        return found.where(F.col("empty") & (N.stripped(F.col("raw_value")) != "")).drop("empty")

    def lookalikes(self) -> DataFrame:
        """Each gigs orphan with a name, beside the first contacts orphan of the same name key."""
        firsts = self.contacts.where("orphan and name_key is not null").groupBy("name_key").agg(F.min("line_no").alias("source_b_row"))
        return self.gigs.where("orphan and name_key is not null").join(firsts, "name_key").select(F.col("full_name").alias("name"), F.lit("gigs").alias("source_a_file"), F.col("line_no").alias("source_a_row"), F.lit("contacts").alias("source_b_file"), "source_b_row", F.lit("unresolved").alias("resolution"))

    def merged_members(self) -> DataFrame:
        """first_line, line_no, full_name, email_key of every line of the bridge groups of more than one."""
        several = self.groups.where("lines > 1").select("group_key", "first_line")
        return self.bridge.select("group_key", "line_no", "full_name", "email_key").join(several, "group_key").select("first_line", "line_no", "full_name", "email_key")

    def merged_duplicates(self) -> DataFrame:
        """Bridge groups of more than one line: what was kept, how many names and emails they held, and their first lines.

        Of a group only ``SHOWN`` lines are gathered, cut before the shuffle; the others
        are counted here and listed by :meth:`merged_members`.
        """
        members = self.merged_members()
        first = members.withColumn("i", F.row_number().over(Window.partitionBy("first_line").orderBy("line_no"))).where(F.col("i") <= SHOWN)
        listed = F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.col("full_name").alias("held")))), lambda x: F.format_string("line %d: %s", x["line_no"], x["held"]))
        shown = first.groupBy("first_line").agg(F.array_join(listed, " | ").alias("shown"))
        counts = lambda column, name: members.where(F.col(column).isNotNull()).select("first_line", column).distinct().groupBy("first_line").agg(F.count("*").alias(name))
        kept = self.groups.where("lines > 1").select("first_line", "lines", F.col("full_name").alias("kept_name"), F.col("primary_email").alias("kept_email"))
        rows = kept.join(shown, "first_line").join(counts("full_name", "names"), "first_line", "left").join(counts("email_key", "emails"), "first_line", "left")
        more = F.when(F.col("lines") > SHOWN, F.format_string(" | and %d more", F.col("lines") - SHOWN)).otherwise("")
        return rows.select("first_line", "lines", "kept_name", "kept_email", F.concat("shown", more).alias("raw_value"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("names", "emails")])

    def issues(self) -> DataFrame:
        """All judgments of the merge, one schema."""
        shape = lambda df, source, line, kind, column, raw, action: df.select(source.alias("source_file"), line.alias("row_number"), F.lit(kind).alias("issue_type"), column.alias("column_name"), raw.alias("raw_value"), action.alias("action_taken"), F.lit("flagged").alias("severity"))
        c = F.col
        none = F.lit(None).cast("string")
        return (
            shape(self.merged_duplicates(), F.lit("bridge"), c("first_line"), "duplicate_person_merged", none, c("raw_value"), F.format_string("%d lines share a phone; kept name %s and email %s", "lines", "kept_name", "kept_email"))
            .unionByName(shape(self.city_conflicts(), c("source_file"), c("line_no"), "city_conflict_across_sources", c("column_name"), c("city"), F.format_string("reads %s; the person keeps %s", "city_norm", "kept_city")))
            .unionByName(shape(self.unparsed(), c("source_file"), c("line_no"), "unparsed_value", c("column_name"), c("raw_value"), F.lit("stored as NULL")))
            .unionByName(shape(self.lookalikes(), F.lit("gigs"), c("source_a_row"), "name_only_match_not_merged", F.lit("worker_name"), c("name"), F.format_string("same name as contacts line %d; two people until reviewed", "source_b_row")))
        )

    def summary(self) -> DataFrame:
        """How many people, links, review candidates, skill rows, and issues of each type."""
        count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
        by_type = self.issues().groupBy(F.concat(F.lit("issue:"), "issue_type").alias("what")).agg(F.count("*").alias("n"))
        return count(self.everyone(), "people").unionByName(count(self.links(), "links")).unionByName(count(self.lookalikes(), "review_candidates")).unionByName(count(self.skills(), "skills")).unionByName(by_type)


def resolve(bridge: DataFrame, gigs: DataFrame, contacts: DataFrame) -> Resolved:
    """Merge three staged sources (all text, with ``line_no``) into people."""
    return _merge(read_bridge(bridge), read_gigs(gigs), read_contacts(contacts))


def _merge(b: DataFrame, gigs: DataFrame, contacts: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> Resolved:
    """``keep``, if given, writes each step before the next one is made from it."""
    groups = keep(bridge_groups(b)) if keep else bridge_groups(b)
    index = email_index(b, groups)
    phones = groups.where("phone_key is not null").select("phone_key", "person_id")

    def owned(rows: DataFrame, rank: int) -> DataFrame:
        return rows.withColumn("orphan", F.col("person_id").isNull()).withColumn("person_id", F.coalesce("person_id", person_id(rank, F.col("line_no"))))

    attached = (owned(attach(gigs, index, "email_key"), GIGS_RANK), owned(attach(contacts, phones, "phone_key"), CONTACTS_RANK))
    kept = side_by_side(b.sparkSession, [partial(keep, rows) for rows in attached]) if keep else attached
    return Resolved(b, groups, index, *kept, (gigs, contacts))


def dense_ids(people: DataFrame, *order: str, name: str = "dense_id", start: int = 0) -> DataFrame:
    """Ids start + 1, start + 2, ... in the order of the columns (person_id): range partitions, their counts (one row each) and running sums.

    The rows are written first, as finding the ranges reads them once more.
    """
    order = order or ("person_id",)
    ranged = durable(people).repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__m"))
    ranged = durable(ranged).withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()
    offsets = []
    for r in sorted(counts, key=lambda r: r["__p"]):
        offsets.append((r["__p"], start))
        start += r.n
    table = people.sparkSession.createDataFrame(offsets, "__p long, __o long")
    return ranged.join(F.broadcast(table), "__p").withColumn(name, F.col("__o") + F.col("__i") + 1).drop("__m", "__p", "__i", "__o")
