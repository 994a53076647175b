"""Where a person comes from, and how complete the links are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.normalise import stripped

#: The fields of a canonical record, raw beside parsed.
RECORD = (
    "person_id", "full_name", "primary_email", "primary_phone", "city", "city_raw", "experience_years", "ctc_raw", "ctc_annual_inr", "ctc_source_unit", "rate_raw", "rate_amount",
    "rate_period", "status", "verified", "projects_completed", "applied_date", "applied_date_raw", "source_origin",
)

def source_cells(links: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Every staged cell behind each person: file, line, method, column, value; blank cells too."""
    out = None
    for name, rows in sources.items():
        columns = [c for c in rows.columns if c != "line_no"]
        own = links.where(F.col("source_file") == name).join(rows, F.col("source_row_number") == F.col("line_no"))
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]))
        own = own.select("person_id", "source_file", "source_row_number", "match_method", cells.alias("x")).select("person_id", "source_file", "source_row_number", "match_method", "x.*")
        out = own if out is None else out.unionByName(own)
    return out


def canonical(people: DataFrame, skills: DataFrame) -> DataFrame:
    """The whole record with raw beside parsed, and its skills in order."""
    listed = skills.groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_list("skill")), " | ").alias("skills"))
    return people.join(listed, "person_id", "left").select(*RECORD, "skills")


def find_person(people: DataFrame, name: str | None = None, person_id: int | None = None) -> DataFrame:
    """person_id, full_name of the people of that name (stripped, without case), or else of the one of that id."""
    same = F.lower("full_name") == F.lower(stripped(F.lit(name))) if name else F.col("person_id") == person_id
    return people.where(same).select("person_id", "full_name")


def namesakes(people: DataFrame) -> DataFrame:
    """R03 for every name at once: name, person_id, people: who else answers to the name."""
    return people.where("full_name is not null").select(F.lower("full_name").alias("name"), "person_id").join(shared_names(people), "name")


def shared_names(people: DataFrame) -> DataFrame:
    """Names, without case, that more than one person has."""
    return people.where("full_name is not null").groupBy(F.lower("full_name").alias("name")).agg(F.count("*").alias("people")).where("people > 1")


def completeness(links: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged rows without a link, links without a row, rows linked twice."""
    l, s = links.select("source_file", "source_row_number"), staged.select("source_file", F.col("line_no").alias("source_row_number"))
    on = ["source_file", "source_row_number"]
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    twice = l.groupBy(*on).count().where("count > 1")
    return count(s.join(l, on, "left_anti"), "rows_without_link").unionByName(count(l.join(s, on, "left_anti"), "links_without_row")).unionByName(count(twice, "rows_linked_twice")).unionByName(count(l, "links"))
