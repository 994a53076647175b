"""Exact Lloyd rounds over integer vectors by two trees.

Each task builds a cover tree over blocks of its own rows, once; blocks and trees
are written to the checkpoint folder, so the vectors are never shuffled.  A round
sends out the centroids (a bounded table of k rows) with a tree over them, walks both
trees and returns sums by cluster: one row for each cluster and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, tidy
from rollcall.llm.cover_tree import LARGEST, Tree, exact, grow, nearest, squares

BLOCK_ROWS = 1024
#: Components beyond this size are it.
LARGEST_COMPONENT = 1 << 62
_PARTS = ("order", "centre", "radius", "lo", "hi", "child", "children")
BLOCK = f"ids array<long>, vectors binary, {', '.join(f'{p} binary' for p in _PARTS)}"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as longs."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    inside = np.clip(scaled, -float(LARGEST_COMPONENT), float(LARGEST_COMPONENT))
    return inside.astype(np.int64)


def kept_vectors(vectors: DataFrame, width: int, id_column: str, vector: str) -> DataFrame:
    """id, v: the vectors of ``width`` components, none null or non-finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == width) & finite)


def blocks_of(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` rows, each with its cover tree and its vectors in the tree's order."""

    def build(batches):
        from rollcall.llm import clustering as own

        for batch in batches:
            for at in range(0, batch.num_rows, own.BLOCK_ROWS):
                part = batch.slice(at, own.BLOCK_ROWS)
                points = whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
                tree = grow(exact(points))
                ids = part.column(0).take(pa.array(tree.order))
                values = [pa.array([getattr(tree, p).tobytes()], pa.binary()) for p in _PARTS]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([points[tree.order].tobytes()], pa.binary()), *values], names=["ids", "vectors", *_PARTS])

    return cut(rows.select("id", "v").mapInArrow(tidy(build), BLOCK))


def opened(batches, width: int):
    """(ids, tree, vectors in its order) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023, E731
            tree = Tree(*(np.frombuffer(cell(p).as_py(), float if p == "radius" else np.int64) for p in _PARTS))
            yield cell("ids").values, tree, exact(np.frombuffer(cell("vectors").as_py(), np.int64).reshape(-1, width))


def totals(blocks: DataFrame, centroids: np.ndarray, width: int) -> list[tuple[int, list[int]]]:
    """How many vectors each centroid is nearest to, and the sums of their components, exact."""
    over = grow(centroids, leaf=1)

    def run(batches):
        found: dict[int, list] = {}
        for _, tree, points in opened(batches, width):
            cluster = nearest(tree, points, over, centroids).cluster
            for c in np.unique(cluster).tolist():
                own = points[cluster == c]
                halves = [(own >> 31).sum(axis=0), (own & ((1 << 31) - 1)).sum(axis=0)] if own.dtype != object else [own.sum(axis=0), 0]
                one = found.setdefault(c, [0, np.zeros(width, object)])
                one[0] += len(own)
                one[1] = one[1] + (halves[0].astype(object) * (1 << 31) + halves[1] if own.dtype != object else halves[0])
        decimal = pa.decimal128(38, 0)
        sums = [pa.array([_decimal(x) for x in s], decimal) for _, s in found.values()]
        flat = pa.concat_arrays(sums) if sums else pa.array([], decimal)
        offsets = pa.array(np.arange(len(sums) + 1) * width, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(tidy(run), "cluster int, n long, sums array<decimal(38,0)>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(width)])
    return [(r.cluster, [r.n, *[int(r[f"s{i}"]) for i in range(width)]]) for r in added.collect()]  # k rows at most


def _decimal(x):
    from decimal import Decimal

    return Decimal(int(x))


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector that takes part.

    Vectors of exactly ``width`` components, none null or non-finite, take part;
    components become floor(scale * x), sizes beyond 2^62 being 2^62.  The first
    centroids are the k vectors with the least sha256 of ``1:<vec_id>``, of equal ids those of
    the least components; fewer vectors make fewer centroids.  A null id has no hash:
    its row takes part, and is a first centroid only where ids are too few.  Rows that repeat an id count each.
    In each round every vector goes to its nearest centroid (squared distance, ties to the
    smaller number), which then becomes the floor of the mean, exactly; one without
    vectors stays.  Distances and sums beyond the range of long are its end.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, width, id_column, vector)
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    seeds = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], schema)
    centroids = exact(whole(np.array([r.v for r in seeds], float), scale))
    blocks = blocks_of(rows, width, scale)
    for _ in range(rounds):
        new = centroids.astype(object)
        for cluster, (n, *sums) in totals(blocks, centroids, width):
            new[cluster] = [s // n for s in sums]
        centroids = exact(new.astype(np.int64))
    over = grow(centroids, leaf=1)

    def assign(batches):
        for ids, tree, points in opened(batches, width):
            cluster = nearest(tree, points, over, centroids).cluster
            away = np.minimum(squares(points, centroids[cluster]), LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(away)], names=["vec_id", "cluster", "distance"])

    assigned = cut(blocks.mapInArrow(tidy(assign), "vec_id long, cluster int, distance long"))
    spread = [(r.cluster, int(r.d)) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()]  # k rows at most
    inertia = min(sum(d for _, d in spread), LARGEST)
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()
    told = spark.createDataFrame([(c, min(d, LARGEST), inertia, digest(c)) for c, d in spread], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
