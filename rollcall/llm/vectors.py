"""What the two vector searches share: clean rows, classes of equal vectors, blocks and queries, merged results.

Rows of one vector are a *class*: it is compared once and brings its smallest ids.
A query is known by its id and its class, so rows that repeat an id are queries,
and candidates, each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import cut

#: What a task returns: of a query (id, class, rows that are this query) a class it found, its score and ids.
FOUND = "query_id long, query_class long, times long, class long, score {}, ids array<long>"
QUERY = ["query_id", "query_class"]


def usable(vectors: DataFrame, id_column: str, vector: str, nonzero: bool) -> DataFrame:
    """id, v (array of double): the rows that take part.

    Left out are null ids, and vectors that are null, empty or hold null or
    non-finite components (with ``nonzero`` zero vectors too).  Rows that repeat an id,
    or id and vector, take part each.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def by_length(rows: DataFrame, search: Callable[[DataFrame, int], DataFrame], empty: DataFrame) -> DataFrame:
    """``search`` over the rows of each vector length, and how many these are; vectors of different lengths have no distance or product."""
    rows = cut(rows)
    out = empty
    for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # one row a length
        out = out.unionByName(search(rows.where(F.size("v") == r.d), r.n))
    return out


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids, class: each distinct vector with its ``keep`` smallest ids (cut before the shuffle)."""
    order = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("class", F.xxhash64("v"))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """query_id, query_class, times, v: the rows whose id is divisible by ``every``, equal ones once."""
    asked = rows.where(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id"), "v").agg(F.count("*").alias("times"))
    return asked.select("query_id", F.xxhash64("v").alias("query_class"), "times", "v")


def packed(column) -> np.ndarray:
    """An Arrow column of equally long lists of doubles as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def blocks_and_queries(batches, keys: int, most: int):
    """(rows, queries) of each group, known by the first ``keys`` columns: its rows whole, its queries ``most`` at a time.

    Rows of a group come together, those that aren't queries (the column after the
    keys) first.  Queries pass by, so no more than one block of rows and one set of
    queries is held.
    """
    key, held, rows = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: keys + 1]]
        change = np.flatnonzero(np.any([i[1:] != i[:-1] for i in ids], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            *group, is_query = (i[lo].item() for i in ids)
            if group != key:
                key, held, rows = group, [], None
            if not is_query:
                held.append(batch.slice(lo, hi - lo))
            elif held:
                rows = rows or pa.Table.from_batches(held)
                for at in range(lo, hi, most):
                    yield rows, batch.slice(at, min(most, hi - at))


def found_batch(queries: pa.RecordBatch, found: list[tuple], score: pa.DataType) -> pa.RecordBatch:
    """FOUND rows of (number of the query, class, score, ids)."""
    at, *rest = list(zip(*found)) if found else [[], [], [], []]
    at = pa.array(at, pa.int64())
    columns = [queries.column(queries.schema.get_field_index(n)).take(at) for n in (*QUERY, "times")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(rest[0], pa.int64()), pa.array(rest[1], score), pa.array(rest[2], pa.list_(pa.int64()))], names=[*QUERY, "times", "class", "score", "ids"])


def without(ids: list[int], own: int) -> list[int]:
    """The ids of the query's own class without the query itself, once."""
    at = ids.index(own) if own in ids else len(ids)
    return ids[:at] + ids[at + 1 :]


def _order(ascending: bool) -> Column:
    return F.col("score").asc() if ascending else F.col("score").desc()


def best_classes(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """FOUND rows: each query's k best classes, each once; of equal ones those with the smaller ids.

    A class is known by its hash and its least id, so that two vectors of one hash are two classes.
    """
    one = found.groupBy(*QUERY, "class", F.element_at("ids", 1).alias("least")).agg(F.first("times").alias("times"), F.first("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy(*QUERY).orderBy(_order(ascending), F.element_at("ids", 1), "class")
    return one.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select(*QUERY, "times", "class", "score", "ids")


def entries(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """query_id, query_class, times, rank, vec_id, score: the k best ids of the classes found, ties to the smaller id."""
    each = found.select(*QUERY, "times", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy(*QUERY).orderBy(_order(ascending), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answers(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the entries, for each of the rows that are this query."""
    each = entries(found, k, ascending).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("query_id", "rank", "vec_id", "score")
