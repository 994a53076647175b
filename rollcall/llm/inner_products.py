"""Exact top-k inner products over integer vectors, the longest vectors first.

Vectors are sorted by length into blocks.  The block of the longest ones gives each
query a first threshold: its k-th best product so far.  A query then goes to
the blocks, in order, until its own length times the block's greatest length
cannot reach the threshold.  Within a block, vectors and queries are rotated by
the right singular vectors of a sample, which puts most of the length into the
first coordinates; the product over the first of them plus the product of the
remaining lengths (Cauchy-Schwarz) bounds the whole product, stage by stage.
Only the pairs that no bound rules out are multiplied, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, tidy
from rollcall.llm.vectors import FOUND, QUERY, answers, best_classes, blocks_and_queries, by_length, classes_of, entries, found_batch, packed, queries_of, usable, without

#: Vectors in a block; queries that one task lets pass by it in all, and holds at once; vectors compared at once.
BLOCK_ROWS, SET_QUERIES, QUERY_ROWS, PART_ROWS = 16_384, 65_536, 1024, 1024
SAMPLE_ROWS = 8192
#: Shares of the coordinates after which products are bounded.
STAGES = (0.25, 0.5, 0.75)
#: Beyond it the products of integers are no longer exact in double precision; Python's integers serve then.
EXACT = float(1 << 53)
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
#: From this share of surviving pairs on, one matrix product is cheaper than the pairs one by one.
DENSE = 0.25


def integers(v: str, scale: int) -> Column:
    """floor(scale * x) of each component as a double; from 2^53 on doubles are whole numbers, and none exceeds the largest double."""
    y = lambda x: F.least(F.greatest(x * scale, F.lit(-1.7976931348623157e308)), F.lit(1.7976931348623157e308))
    return F.transform(v, lambda x: F.when(F.abs(y(x)) < EXACT, F.floor(y(x)).cast("double")).otherwise(y(x)))


def exact_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, sure: bool) -> np.ndarray:
    """Integer products of the pairs (q[i], x[j]), held to the range of long; ``sure``: all are exact in double precision."""
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 8192):
        a, b = q[i[at : at + 8192]], x[j[at : at + 8192]]
        if sure:
            out[at : at + 8192] = np.einsum("nd,nd->n", a, b)
            continue
        for n, (u, w) in enumerate(zip(a.tolist(), b.tolist()), at):
            out[n] = min(MOST_LONG, max(LEAST_LONG, sum(int(s) * int(t) for s, t in zip(u, w))))
    return out


class Block:
    """Vectors by descending length, their rotated coordinates and what is left of their lengths after each stage."""

    def __init__(self, rows: pa.Table, rotation: np.ndarray, stages: list[int]):
        norms = rows.column("norm").to_numpy()
        order = np.argsort(-norms, kind="stable")
        self.x, self.norms = packed(rows.column("v"))[order], norms[order]
        self.classes = rows.column("class").to_numpy()[order]
        ids = rows.column("ids").to_pylist()
        self.ids = [ids[i] for i in order.tolist()]
        self.turned, self.rest = turned(self.x, rotation, stages)


def no_more(scores: np.ndarray) -> np.ndarray:
    """Thresholds as doubles that don't exceed the scores, where doubles can't hold these."""
    out = np.asarray(scores, float)
    return np.where(np.abs(out) > EXACT, np.nextafter(out, -np.inf), out)


def turned(x: np.ndarray, rotation: np.ndarray, stages: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    with np.errstate(all="ignore"):  # components that overflow give no bound
        out = x @ rotation
        return out, {h: np.sqrt((out[:, h:] ** 2).sum(axis=1)) for h in stages}


def top_in(batches, k: int, rotation: np.ndarray):
    """Of each query, the k best classes that reach its threshold, in each pair of a block and a set of queries."""
    width = len(rotation)
    stages = sorted({max(1, int(width * s)) for s in STAGES} - {width})
    held, block = None, None
    for rows, queries in blocks_and_queries(batches, 2, QUERY_ROWS):
        if rows is not held:
            held, block = rows, Block(rows, rotation, stages)
        column = lambda n: queries.column(queries.schema.get_field_index(n))
        q, own, own_class = packed(column("v")), column("query_id").to_pylist(), column("query_class").to_pylist()
        norms, least = column("norm").to_numpy(), no_more(column("threshold").to_numpy(zero_copy_only=False))
        asked, rest = turned(q, rotation, stages)
        found: list[tuple] = []
        for at in range(0, len(block.x), PART_ROWS):
            some = slice(at, min(len(block.x), at + PART_ROWS))
            x, longest = block.x[some], block.norms[at]
            with np.errstate(all="ignore"):
                slack = 1e-7 * (1 + norms.max() * longest)  # for rounding in the rotation
                live = np.flatnonzero(~(norms * longest + slack < least))  # what isn't a number bounds nothing
                if not len(live):
                    break
                partial, keep, done = np.zeros((len(live), len(x))), np.ones((len(live), len(x)), bool), 0
                for h in stages:
                    partial += asked[live, done:h] @ block.turned[some, done:h].T
                    keep &= ~(partial + np.outer(rest[h][live], block.rest[h][some]) + slack < least[live, None])
                    done = h
                    stay = keep.any(axis=1)
                    if not stay.all():
                        live, partial, keep = live[stay], partial[stay], keep[stay]
                if not len(live):
                    continue
                sure = bool(norms[live].max() * longest < EXACT)
            i, j = np.nonzero(keep)
            if sure and len(i) > DENSE * keep.size:
                scores = (q[live] @ x.T)[i, j].astype(np.int64)
            else:
                scores = exact_products(q[live], x, i, j, sure)
            bounds = np.searchsorted(i, np.arange(len(live) + 1)).tolist()
            for n, query in enumerate(live.tolist()):
                score, at_row = scores[bounds[n] : bounds[n + 1]], j[bounds[n] : bounds[n + 1]]
                if len(score) > k + 1:  # the query's own class may bring no id
                    cut_at = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    score, at_row = score[score >= cut_at], at_row[score >= cut_at]
                best = []
                for s, row in zip(score.tolist(), (at_row + at).tolist()):
                    if s >= least[query]:
                        ids = block.ids[row]
                        if block.classes[row] == own_class[query]:
                            ids = without(ids, own[query])
                        if ids:
                            best.append((-s, ids[0], int(block.classes[row]), ids))
                best = sorted(best)[:k]
                if len(best) == k:
                    least[query] = max(least[query], no_more(-best[-1][0]))
                found += [(query, c, -s, ids) for s, _, c, ids in best]
        yield found_batch(queries, found, pa.int64())


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest products of each row whose id is divisible by ``every``.

    Components become floor(scale * x).  See :func:`rollcall.llm.vectors.usable`
    for the rows that take part (zero vectors do).  Candidates are all rows of the
    query's length but its own; rows that repeat an id are queries and candidates
    each.  Scores beyond the range of long are its ends (components of 1e300 are
    no error); ties go to the smaller id.  With fewer than k candidates, all of them;
    an empty table gives no rows.
    """
    rows = usable(vectors, id_column, vector, nonzero=False).select("id", integers("v", scale).alias("v"))
    return by_length(rows, lambda own, n: _top_products(own, n, k, every), vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long"))


def _top_products(rows: DataFrame, n: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    blocks = -(-n // BLOCK_ROWS)
    sorted_ = cut(classes_of(rows, k + 1).withColumn("norm", norm).repartitionByRange(blocks, F.desc("norm"), "class").withColumn("block", F.spark_partition_id()))
    few = sorted_.where(F.col("norm") < 1e150)  # a bounded sample, for the rotation alone
    sample = np.array([r.v for r in few.orderBy("class").limit(SAMPLE_ROWS).select("v").collect()])
    width = len(sample[0]) if len(sample) else len(rows.select("v").first().v)
    rotation = np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1]) if len(sample) else np.eye(width)  # right singular vectors, the greatest value first

    # One length for each block: 8 bytes for every BLOCK_ROWS rows, held by the driver and broadcast.
    longest = {r.block: r.norm for r in sorted_.groupBy("block").agg(F.max("norm").alias("norm")).collect()}
    first = min(longest)
    queries = queries_of(rows, every).withColumn("norm", norm)
    sets = max(1, -(-(n // max(every, 1) + 1) // SET_QUERIES))
    queries = cut(queries.withColumn("set", F.pmod(F.xxhash64(*QUERY), F.lit(sets)).cast("int")))

    def search(asked: DataFrame, inside: DataFrame) -> DataFrame:
        """asked: query, v, norm, threshold, set, block; inside: class, v, ids, norm, set, block."""
        none = lambda kind: F.lit(None).cast(kind)
        both = inside.select("block", "set", F.lit(False).alias("query"), none("long").alias("query_id"), none("long").alias("query_class"), none("long").alias("times"), "class", "v", "ids", "norm", none("double").alias("threshold")).unionByName(
            asked.select("block", "set", F.lit(True).alias("query"), *QUERY, "times", F.lit(0).cast("long").alias("class"), "v", none("array<long>").alias("ids"), "norm", "threshold")
        )
        return both.repartition("block", "set").sortWithinPartitions("block", "set", "query").mapInArrow(tidy(lambda b: top_in(b, k, rotation)), FOUND.format("long"))

    nothing = F.lit(float("-inf"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))
    start = search(queries.withColumn("block", F.lit(first)).withColumn("threshold", nothing), sorted_.where(F.col("block") == first).withColumn("set", everywhere))
    start = cut(best_classes(start, k, ascending=False))
    if len(longest) == 1:
        return answers(start, k, ascending=False)
    reached = entries(start, k, ascending=False).where(F.col("rank") == k).select(*QUERY, F.col("score").cast("double").alias("threshold"))
    order = sorted(b for b in longest if b != first)
    shared = spark.sparkContext.broadcast((np.array(order, np.int32), np.array([longest[b] for b in order])))

    def reaches(batches):
        for batch in batches:
            numbers, lengths = shared.value
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                hits = [numbers[~(lengths * (n * (1 + 1e-9)) < t)] for n, t in zip(column("norm"), no_more(column("threshold")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h.tolist() for h in hits], pa.list_(pa.int32()))], names=[*batch.schema.names, "blocks"])

    ready = queries.join(reached, QUERY, "left").select(*QUERY, "times", "v", "norm", "set", F.coalesce("threshold", nothing).alias("threshold"))
    ready = cut(ready.mapInArrow(reaches, "query_id long, query_class long, times long, v array<double>, norm double, set int, threshold double, blocks array<int>"))
    ready = ready.withColumn("block", F.explode("blocks")).drop("blocks")
    met = ready.select("block", "set").distinct()  # a block is copied to the sets of queries that reach it, and to no other
    more = search(ready, sorted_.join(met, "block"))
    return answers(start.unionByName(more), k, ascending=False)
