"""Structural screening of export lines: what is staged verbatim, what is set aside and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.normalise import stripped
from rollcall.sources.lines import cells, first_fields
from rollcall.sources.specs import ExportSpec


def screened(lines: DataFrame, spec: ExportSpec) -> DataFrame:
    """File, line_no, line, fields, found, verdict, recovered of every line but the header.

    The first rule that fails gives the verdict: unclosed_quote, blank_row, repeated_header,
    wrong_column_count, column_shift; ``staged`` if none does.  ``recovered`` is the key
    that turning a shifted row left by one brings back, where it has the key's shape.
    """
    n = len(spec.header)
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(spec.name))
    if "unclosed" not in lines.columns:
        lines = lines.withColumn("unclosed", F.lit(False))
    # Columns from a generator are computed once, however often the rules below name them.
    rows = lines.where("line_no > 1").select("*", F.inline(F.array(F.struct(cells(F.col("line")).alias("cells")))))
    rows = rows.withColumns({"fields": first_fields(F.col("cells"), n), "found": F.size("cells")})
    key = F.col("fields")[spec.key]
    turned = F.concat(F.slice("fields", 2, n - 1), F.slice("fields", 1, 1))[spec.key]
    verdict = (
        F.when(F.col("unclosed"), "unclosed_quote")
        .when(F.forall("cells", lambda c: stripped(c) == ""), "blank_row")
        .when((F.col("found") == n) & (F.col("fields") == F.array(*map(F.lit, spec.header))), "repeated_header")
        .when(F.col("found") != n, "wrong_column_count")
        .when(~key.rlike(spec.key_pattern), "column_shift")
        .otherwise("staged")
    )
    return rows.withColumn("verdict", verdict).drop("cells", "unclosed").withColumn("recovered", F.when((F.col("verdict") == "column_shift") & turned.rlike(spec.key_pattern), turned))


def staged(rows: DataFrame, spec: ExportSpec) -> DataFrame:
    """Staged rows as named text columns, not a character changed."""
    return rows.where("verdict = 'staged'").select("file", "line_no", *[F.col("fields")[i].alias(name) for i, name in enumerate(spec.columns)])


def shift_duplicates(rows: DataFrame, spec: ExportSpec) -> DataFrame:
    """Shifted rows whose recovered key a line before them in their file already has, and the first such line."""
    shifted = rows.where("recovered is not null").select("file", "line_no", "recovered", F.lower(stripped(F.col("recovered"))).alias("k"))
    keys = rows.where("verdict = 'staged'").select("file", F.lower(stripped(F.col("fields")[spec.key])).alias("k"), F.col("line_no").alias("at"))
    firsts = keys.join(shifted.select("file", "k").distinct(), ["file", "k"], "left_semi").groupBy("file", "k").agg(F.min("at").alias("earlier_line"))
    return shifted.join(firsts, ["file", "k"]).where("earlier_line < line_no").select("file", "line_no", "recovered", "earlier_line")


def issues(rows: DataFrame, spec: ExportSpec) -> DataFrame:
    """One issue for each line that isn't staged; raw_value is the line itself, row_number its place in the file."""
    earlier = shift_duplicates(rows, spec).select("file", "line_no", "earlier_line")
    bad = rows.where("verdict <> 'staged'").join(earlier, ["file", "line_no"], "left")
    shift = F.col("verdict") == "column_shift"
    action = (
        F.when(F.col("verdict") == "wrong_column_count", F.format_string(f"skipped: expected {len(spec.header)} fields, found %d", "found"))
        .when(F.col("verdict") == "unclosed_quote", F.lit("skipped: a quote opens a field that doesn't end; reading went on at the next line"))
        .when(shift & F.col("earlier_line").isNotNull(), F.format_string("skipped: turned left by one it would repeat line %d", "earlier_line"))
        .when(shift & F.col("recovered").isNotNull(), "skipped: turned left by one it would be well-formed")
        .otherwise("skipped")
    )
    return bad.select(
        "file", F.lit(spec.name).alias("source_file"), F.col("line_no").alias("row_number"), F.col("verdict").alias("issue_type"), F.when(shift, spec.key_header).alias("column_name"),
        F.regexp_replace("line", r"[\r\n]+\z", "").alias("raw_value"), action.alias("action_taken"), F.when(shift, "flagged").otherwise("skipped").alias("severity"),
    )


def load_summary(rows: DataFrame, source: str) -> DataFrame:
    """Read, loaded, skipped of the source and of all (TOTAL)."""
    named = rows.withColumn("source_file", F.lit(source))
    out = named.rollup("source_file").agg(F.count("*").alias("read"), F.count_if(F.col("verdict") == "staged").alias("loaded"), F.count_if(F.col("verdict") != "staged").alias("skipped"))
    return out.withColumn("source_file", F.coalesce("source_file", F.lit("TOTAL")))


def issue_counts(found: DataFrame) -> DataFrame:
    """I12."""
    return found.groupBy("severity", "issue_type").agg(F.count("*").alias("n"))
