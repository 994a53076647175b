"""Chat formatting: logged snapshots of one conversation collapse to the longest.

A service that logs the whole conversation at every turn leaves each of them
many times over.  Rolling hashes of turn prefixes find the logs that are a
prefix of another; an anti-join drops them, and what is left, the maximal
conversations, is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn, and the marks' opening inside a text made harmless.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
INNER, HARMLESS = "<|", "< |"


def rolled(turns: DataFrame) -> DataFrame:
    """conv_id, p, role, text, n and the hash (two 64-bit halves) of the first p turns.

    Each turn's hash includes its place, so the exclusive-or over the first p
    turns is a hash of the prefix.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = clean.withColumn("p", F.row_number().over(order).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for name, seed in (("h1", 1), ("h2", 2)):
        placed = placed.withColumn(name, F.bit_xor(F.xxhash64(F.lit(seed), "p", "role", "text")).over(upto))
    return placed.select("conv_id", "p", "role", "text", "n", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies: the conversations that are no proper prefix of another; of equal ones the least id."""
    prefixes = rolled(turns)
    whole = prefixes.where("p = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = prefixes.where("p < n").groupBy(F.col("p").alias("n"), "h1", "h2").agg(F.count("*").alias("longer"))
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered: each maximal conversation as one text.

    Turns are in the order of ``turn`` (null first), then role and text, so ties
    and repeated rows have a fixed place; a repeated row is a turn of its own.  A
    null role or text is empty.  Rows without a conv_id are one conversation, whose
    id is null.  Marks inside a text are made harmless.  Roles and texts are
    compared as they are.  An empty table gives no rows.
    """
    chosen = maximal(turns).select(F.col("conv_id").alias("__conv"), "n_turns", "copies")
    kept = rolled(turns).select("conv_id", "p", "role", "text").join(chosen, F.col("conv_id").eqNullSafe(F.col("__conv")))
    turn = F.concat(F.lit(OPEN), F.replace("role", F.lit(INNER), F.lit(HARMLESS)), F.lit("\n"), F.replace("text", F.lit(INNER), F.lit(HARMLESS)), F.lit(CLOSE + "\n"))
    grouped = kept.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("p", turn.alias("part")))).alias("parts"))
    return grouped.select("conv_id", "n_turns", "copies", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("rendered"))


RENDERED_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY p) AS turns,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY p) AS rendered
  FROM t GROUP BY conv_id),
whole AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, turns, any_value(rendered) AS rendered FROM c GROUP BY n, turns),
cuts AS (SELECT turns, unnest(range(1, n)) AS k FROM c),
shorter AS (SELECT DISTINCT turns[1:k] AS turns FROM cuts)
SELECT conv_id, n AS n_turns, copies, rendered FROM whole WHERE NOT EXISTS (SELECT 1 FROM shorter WHERE shorter.turns = whole.turns)
"""
