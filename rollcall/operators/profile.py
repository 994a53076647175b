"""Data-quality profiles: the counts that say whether the rules fit the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import normalise as N
from rollcall.operators.resolve import Resolved
from rollcall.sources.specs import PLAUSIBLE_CTC


def phone_shapes(bridge: DataFrame, contacts: DataFrame) -> DataFrame:
    """What stands before the last ten digits, per source."""
    both = bridge.select(F.lit("bridge").alias("source_file"), "phone").unionByName(contacts.select(F.lit("contacts").alias("source_file"), "phone"))
    return both.groupBy("source_file", F.regexp_replace("phone", r"\p{Nd}{10}$", "#").alias("shape")).agg(F.count("*").alias("n"))


def city_spellings(m: Resolved) -> DataFrame:
    """Of each city how many spellings, and how many of them differ by white space at an end only."""
    every = m.bridge.select("city", "city_norm").unionByName(m.gigs.select("city", "city_norm")).unionByName(m.contacts.select("city", "city_norm"))
    one = every.where("city_norm is not null").groupBy("city_norm", "city").agg(F.count("*").alias("n"))
    return one.groupBy("city_norm").agg(F.count("*").alias("spellings"), F.count_if(F.col("city") != N.stripped(F.col("city"))).alias("padded"), F.sum("n").alias("n"))


def flag_census(m: Resolved) -> DataFrame:
    """Raw values of status and verified, and what they became."""
    a = m.gigs.groupBy(F.lit("status").alias("column_name"), F.col("status").alias("raw"), F.col("status_norm").alias("value")).agg(F.count("*").alias("n"))
    b = m.contacts.groupBy(F.lit("verified").alias("column_name"), F.col("verified").alias("raw"), F.col("verified_norm").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


def ctc_units(m: Resolved) -> DataFrame:
    """Count, least and most of each unit, and how many lie outside what is plausible."""
    x = m.bridge.select("ctc_parsed.*").where("unit is not null")
    return x.groupBy("unit").agg(F.count("*").alias("n"), F.min("amount_inr").alias("least"), F.max("amount_inr").alias("most"), F.count_if(~F.col("amount_inr").between(*PLAUSIBLE_CTC)).alias("implausible"))


def rate_periods(m: Resolved) -> DataFrame:
    """Count, least and most of each period, and how many were written in thousands."""
    x = m.gigs.select("rate_parsed.*", "rate").where("period is not null")
    return x.groupBy("period").agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most"), F.count_if(F.contains(F.lower("rate"), F.lit("k"))).alias("in_thousands"))


def date_layouts(m: Resolved) -> DataFrame:
    """Rows of each layout, ambiguous ones, and their distinct values."""
    x = m.bridge.select("date_parsed.*", "applied_date").where("layout is not null")
    return x.groupBy("layout").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"), F.count_distinct(F.when(F.col("ambiguous"), F.col("applied_date"))).alias("ambiguous_values"))


def key_coverage(m: Resolved) -> DataFrame:
    """Rows that match the bridge by key, as written and normalised."""

    def matched(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
        known = held.select(F.col(key).alias("k")).where("k is not null and k <> ''").distinct()
        return rows.select(F.col(key).alias("k")).join(known, "k", "left_semi").agg(F.count("*").alias("n"))

    out = [matched(m.gigs, "email", m.bridge).select(F.lit("email raw").alias("what"), "n"), matched(m.gigs, "email_key", m.bridge).select(F.lit("email normalised").alias("what"), "n")]
    out += [matched(m.contacts, "phone", m.bridge).select(F.lit("phone raw").alias("what"), "n"), matched(m.contacts, "phone_key", m.bridge).select(F.lit("phone normalised").alias("what"), "n")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def skill_agreement(m: Resolved) -> DataFrame:
    """Rows matched by email whose skills equal those of their person's first line, or don't."""
    kept = m.groups.select("person_id", F.sort_array("skill_list").alias("kept"))
    both = m.gigs.where("not orphan").select("person_id", F.sort_array("skill_list").alias("own")).join(kept, "person_id")
    return both.groupBy((F.col("own") == F.col("kept")).alias("agree")).agg(F.count("*").alias("n"))


def duplicate_keys(m: Resolved) -> DataFrame:
    """Rows in bridge groups of several lines by phone, by email, by both."""
    of = lambda key, name: m.bridge.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) > 1)
    rows = m.bridge.select("line_no", "phone_key", "email_key").join(of("phone_key", "p"), "phone_key", "left").join(of("email_key", "e"), "email_key", "left")
    return rows.where("p is not null or e is not null").groupBy(F.col("p").isNotNull().alias("by_phone"), F.col("e").isNotNull().alias("by_email")).agg(F.count("*").alias("n"))


def shared_keys(people: DataFrame) -> DataFrame:
    """P10: phones and emails that several people have after the merge."""
    of = lambda column, kind: people.where(F.col(column).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(column).alias("key")).agg(F.count("*").alias("people")).where("people > 1")
    return of("primary_phone", "phone").unionByName(of("primary_email", "email"))


def skill_spellings(bridge: DataFrame, gigs: DataFrame) -> DataFrame:
    """Of each skill how many spellings and rows."""
    cells = bridge.select(F.explode(F.split("skills", ",")).alias("raw")).unionByName(gigs.select(F.explode(F.split("skills", ",")).alias("raw")))
    named = cells.select(N.stripped(F.col("raw")).alias("raw"), N.skill(F.col("raw")).alias("skill")).where("skill is not null")
    return named.groupBy("skill").agg(F.count_distinct("raw").alias("spellings"), F.count("*").alias("n"))
