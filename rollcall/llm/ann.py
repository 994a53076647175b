"""Approximate nearest neighbours: multi-probe hashing with p-stable projections.

Each of several tables cuts the space by Gaussian projections, shifted and
floored, into buckets.  A query visits its own bucket and then the perturbed ones
(projections moved by one step down or up) in the order of their estimated
chance of success: the least sum of squared distances to the bounds crossed,
among the perturbations that are likeliest for a query anywhere in its bucket.
The number of projections, the cell width and how many buckets are visited are
fitted: a bounded set of queries is compared with *every* row, and of the
settings with which the visits find enough of these true neighbours the one
that compares the fewest rows is taken.

Vectors that occur often count once, with their smallest ids.  Buckets are dealt
into cells by hash, large cells into chunks; a query goes to the cells that it
visits, with its visits there.  A task holds one block of rows, by bucket, and lets its
queries pass by: it measures the visited rows and returns each query's
nearest ones; these are merged over tables and cells.

The number of visits is bounded, so what they gave is checked: a query with fewer
finds than there are to find, or whose visits are likely to miss a row at the
distance of its last find, is compared with every row in a second pass.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import cut, tidy
from rollcall.llm.vectors import FOUND, QUERY, answers, best_classes, blocks_and_queries, by_length, classes_of, found_batch, packed, queries_of, usable, without

LOG = logging.getLogger(__name__)
TABLES = 8
#: Settings tried: projections of a table, and cell widths in distances of a k-th neighbour.
PROJECTIONS, WIDTHS = (2, 4, 6, 8, 10, 12, 16), (1.5, 2.5, 4.0)
#: Queries that are compared with every row for the fit, rows that visits are counted on, and the finds wanted.
FIT_QUERIES, SAMPLE_ROWS, FIT_RECALL = 64, 4096, 0.96
#: Buckets visited in a table, at most.
MOST_PROBES = 512
#: Queries whose visits find a row as far as their k-th find with less than this chance are compared with every row.
LEAST_CHANCE = 0.8
#: Rows of the index in one cell or chunk, about.
CELL_ROWS = 16_384
#: Queries that a task compares with a block of rows at once; the others of the group come after them.
QUERY_ROWS = 256
#: From this share of visited pairs on, one matrix product is cheaper than the pairs one by one.
DENSE = 0.25
#: Squares up to which distances can be told from products.
SAFE = 1e200

_GRID = np.linspace(-8, 8, 8001)
_NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID.tolist()])


@lru_cache
def perturbations(projections: int, most: int) -> np.ndarray:
    """Rows of 0 and 1: sets of moves, by their rank among a query's 2 x ``projections`` moves, of least expected cost.

    The j-th smallest of the squared distances to a cell's bounds has a known mean for a point
    anywhere in the cell; the j-th smallest and the j-th largest are the two sides of one projection.
    """
    import heapq

    j = np.arange(1, projections + 1)
    near = j * (j + 1) / (4 * (projections + 1) * (projections + 2))
    far = (1 - j / (projections + 1) + j * (j + 1) / (4 * (projections + 1) * (projections + 2)))[::-1]
    mean = np.concatenate([near, far]).tolist()
    chosen: list[tuple[int, ...]] = [()]
    heap = [(mean[0], (0,))]
    while heap and len(chosen) < most:
        cost, some = heapq.heappop(heap)
        if len({min(i, 2 * projections - 1 - i) for i in some}) == len(some):
            chosen.append(some)
        last = some[-1]
        if last + 1 < len(mean):
            heapq.heappush(heap, (cost - mean[last] + mean[last + 1], (*some[:-1], last + 1)))
            heapq.heappush(heap, (cost + mean[last + 1], (*some, last + 1)))
    out = np.zeros((len(chosen), 2 * projections))
    for n, some in enumerate(chosen):
        out[n, list(some)] = 1
    return out


@dataclass
class Hashes:
    """Projections (tables x projections x d), shifts, cell width and buckets visited in a table."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    probes: int = 1

    def positions(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x projections, in cells."""
        with np.errstate(all="ignore"):
            return (np.einsum("nd,tpd->ntp", x, self.directions) + self.shifts) / self.width

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        """One 64-bit number for the cell's coordinates (the last axis)."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        with np.errstate(all="ignore"):
            for k in range(cells.shape[-1]):
                out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
        return out.view(np.int64)

    def steps(self, position: np.ndarray) -> np.ndarray:
        """queries x probes x projections: steps (-1, 0, 1) from the own bucket to each one visited in one table, likeliest first."""
        m = position.shape[1]
        with np.errstate(all="ignore"):
            inside = np.nan_to_num(position - np.floor(position))
        cost = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)
        rank = np.argsort(cost, axis=1, kind="stable")
        sets = perturbations(m, 2 * MOST_PROBES)
        chosen = np.argsort(np.take_along_axis(cost, rank, 1) @ sets.T, axis=1, kind="stable")[:, : self.probes]
        moves = np.zeros((len(position), 2 * m, m))  # of each rank: the projection moved, and where to
        at = np.arange(len(position))[:, None], np.arange(2 * m)[None]
        moves[(*at, rank % m)] = np.where(rank < m, -1.0, 1.0)
        return sets[chosen] @ moves

    def visited(self, position: np.ndarray) -> np.ndarray:
        """queries x probes: codes of the buckets that queries at ``position`` in one table visit, likeliest first."""
        with np.errstate(all="ignore"):
            return self.code(np.floor(position)[:, None] + self.steps(position))

    def chance(self, positions: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """How likely the visits in all tables find a row at ``distance`` of each query at ``positions`` (queries x tables x projections)."""
        missed = np.ones(len(positions))
        with np.errstate(all="ignore"):
            for t in range(positions.shape[1]):
                position = positions[:, t]
                edges = (np.arange(-1, 3) - (position - np.floor(position))[..., None]) * (self.width / distance)[:, None, None]
                within = np.diff(np.interp(edges, _GRID, _NORMAL), axis=-1)  # by projection: a step down, none, a step up
                steps = self.steps(position).astype(int) + 1
                missed *= 1 - np.take_along_axis(within[:, None], steps[..., None], axis=-1)[..., 0].prod(axis=-1).sum(axis=-1)
        return np.where(distance > 0, 1 - missed, 1.0)


def fit_hashes(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray], tables: int = TABLES, recall: float = FIT_RECALL, seed: int = 4) -> Hashes:
    """The cheapest setting with which ``recall`` of the queries' true neighbours (``near``, vectors by query) are found.

    The cost is the share of the sample's rows that a query is compared with, all tables together.
    If no setting finds enough, the one that finds most.
    """
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((tables, max(PROJECTIONS), sample.shape[1]))
    shifts = rng.random((tables, max(PROJECTIONS)))
    far = [float(distances(n, q).max()) for q, n in zip(queries, near) if len(n)]
    with np.errstate(all="ignore"):
        low, high = np.quantile(np.einsum("nd,pd->np", sample, directions[0, :2]), (0.25, 0.75))
    spread = (high - low) / 1.349 if np.isfinite(high - low) and high > low else 1.0
    unit = float(np.median(far)) if far else 0.0
    if not (0 < unit < math.inf):
        unit = spread
    flat = np.concatenate([n for n in near if len(n)]) if far else np.zeros((0, sample.shape[1]))
    of = np.repeat(np.arange(len(near)), [len(n) for n in near])
    best, least = None, (math.inf, math.inf)
    for m in PROJECTIONS:
        for width in WIDTHS:
            h = Hashes(directions[:, :m], shifts[:, :m] * width * unit, width * unit, MOST_PROBES)
            at, rows, own = h.positions(queries), h.positions(sample), h.positions(flat)
            need = np.full(len(flat), MOST_PROBES)
            cost = np.zeros(MOST_PROBES)
            for t in range(tables):
                visits = h.visited(at[:, t])
                found = visits[of] == h.code(np.floor(own[:, t]))[:, None]
                need = np.minimum(need, np.where(found.any(axis=1), found.argmax(axis=1), MOST_PROBES))
                codes, count = np.unique(h.code(np.floor(rows[:, t])), return_counts=True)
                place = np.minimum(np.searchsorted(codes, visits), len(codes) - 1)
                share = np.where(codes[place] == visits, count[place], 0).mean(axis=0) / len(sample)
                cost += np.pad(share, (0, MOST_PROBES - len(share))).cumsum()
            last = int(np.quantile(need, recall, method="higher")) if len(need) else 7
            probes = min(MOST_PROBES, max(8, last + 1))
            short = float(np.mean(need >= probes)) if last >= MOST_PROBES else 0.0
            if (short, cost[probes - 1]) < least:
                least, best = (short, cost[probes - 1]), Hashes(h.directions, h.shifts, h.width, probes)
    LOG.info("%d projections, %d buckets in each of %d tables, %.3f of all rows compared", best.directions.shape[1], best.probes, tables, least[1])
    return best


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, from scaled components."""
    with np.errstate(all="ignore"):
        d = x - q
        square = (d * d).sum(axis=1)
        out = np.sqrt(square)
        odd = np.flatnonzero(~((square > 1e-280) & (square < 1e300)))
        if len(odd):
            most = np.abs(d[odd]).max(axis=1)
            scaled = d[odd] / np.where(most > 0, most, 1)[:, None]
            out[odd] = np.where(most > 0, most * np.sqrt((scaled * scaled).sum(axis=1)), 0.0)
        return out


def visited_rows(codes: np.ndarray, bounds: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the visited buckets' rows begin and end, for rows in the order of their distinct ``codes``."""
    place = np.searchsorted(codes, visits)
    place[place == len(codes)] = 0
    place = place[codes[place] == visits]
    return bounds[place], bounds[place + 1]


def nearest_in(batches, k: int):
    """Each query's k nearest classes among the visited rows (all, if visits are null), in each group of a table, cell and chunk."""
    held = None
    for rows, queries in blocks_and_queries(batches, 3, QUERY_ROWS):
        if rows is not held:
            held = rows
            order = np.argsort(rows.column("bucket").to_numpy(), kind="stable")
            codes, first = np.unique(rows.column("bucket").to_numpy()[order], return_index=True)
            bounds = np.append(first, len(order))
            x, classes = packed(rows.column("v"))[order], rows.column("class").to_numpy()[order]
            ids = rows.column("ids").combine_chunks().take(pa.array(order))
            with np.errstate(all="ignore"):
                square = (x * x).sum(axis=1)
            safe = square.max() < SAFE
        column = lambda n: queries.column(queries.schema.get_field_index(n))
        q, own, own_class = packed(column("v")), column("query_id").to_pylist(), column("query_class").to_pylist()
        visits = column("visits")
        seen = [None if visits[i].values is None else visited_rows(codes, bounds, visits[i].values.to_numpy()) for i in range(len(q))]
        pairs = sum(len(x) if s is None else int((s[1] - s[0]).sum()) for s in seen)
        dense = safe and pairs > DENSE * len(x) * len(q)
        rough = square - 2 * q @ x.T if dense else None  # squared distances less the query's own square
        found: list[tuple] = []
        for i, span in enumerate(seen):
            if span is None:
                at = np.arange(len(x))
            elif len(span[0]):
                at = np.concatenate([np.arange(a, b) for a, b in zip(span[0].tolist(), span[1].tolist())])
            else:
                continue
            if safe and len(at) > k + 1:  # the query's own class may bring no id
                d = rough[i, at] if dense else square[at] - 2 * x[at] @ q[i]
                limit = np.partition(d, k)[k]
                at = at[~(d > limit + 1e-9 * (1 + abs(limit) + square.max()))]
            best = []
            for s, row in zip(distances(x[at], q[i]).tolist(), at.tolist()):
                some = ids[row].as_py()
                if classes[row] == own_class[i]:
                    some = without(some, own[i])
                if some:
                    best.append((s, some[0], int(classes[row]), some))
            found += [(i, c, s, some) for s, _, c, some in sorted(best)[:k]]
        yield found_batch(queries, found, pa.float64())


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    See :func:`rollcall.llm.vectors.usable` for the rows that take part (zero
    vectors don't).  Candidates are all rows of the query's length but its own; rows
    that repeat an id are queries and candidates each.  Score is the Euclidean
    distance in double precision, of components as large as 1e300 too (infinity beyond the largest
    double); ties go to the smaller id.  Every query gets k rows; with fewer candidates, all of them; an
    empty table gives no rows.  How many queries were compared with every row is logged.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return by_length(usable(vectors, id_column, vector, nonzero=True), lambda rows, n: _nearest(rows, n, k, every, options), empty)


def true_neighbours(classes: DataFrame, queries: list, k: int) -> list[list]:
    """Of each of a few queries (rows of query_class and v) the vectors of its k nearest other classes."""
    asked, own = np.array([r.v for r in queries]), [r.query_class for r in queries]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, of = packed(batch.column(0)), batch.column(1).to_numpy()
            for i, q in enumerate(asked):
                far = distances(x, q)
                far[of == own[i]] = np.inf
                at = np.argsort(far, kind="stable")[:k]
                at = at[of[at] != own[i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(far[at]), batch.column(1).take(pa.array(at)), batch.column(0).take(pa.array(at))], names=["q", "far", "class", "v"])

    order = Window.partitionBy("q").orderBy("far", "class")
    found = classes.select("v", "class").mapInArrow(tidy(run), "q int, far double, class long, v array<double>").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    near: list[list] = [[] for _ in queries]
    for r in found.collect():  # k rows a query
        near[r.q].append(r.v)
    return near


def _nearest(rows: DataFrame, n: int, k: int, every: int, options: dict) -> DataFrame:
    spark = rows.sparkSession
    classes, queries = cut(classes_of(rows, k + 1)), cut(queries_of(rows, every))
    sample = np.array([r.v for r in classes.orderBy("class").limit(SAMPLE_ROWS).select("v").collect()])
    tried = queries.orderBy(F.xxhash64(*QUERY), *QUERY).limit(FIT_QUERIES).select("query_class", "v").collect()
    if not tried:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = [np.array(v, float).reshape(-1, sample.shape[1]) for v in true_neighbours(classes, tried, k)]
    shared = spark.sparkContext.broadcast(fit_hashes(sample, np.array([r.v for r in tried]), near, **options))
    cells = max(1, -(-classes.count() // CELL_ROWS))
    cell_of = lambda codes: ((codes.view(np.uint64) >> np.uint64(7)) % np.uint64(cells)).astype(np.int32)
    codes_of = lambda x: shared.value.code(np.floor(shared.value.positions(x)))

    def counted(batches):
        for batch in batches:
            codes = codes_of(packed(batch.column(0))) if batch.num_rows else np.zeros((0, 0), np.int64)
            for t in range(codes.shape[1]):
                cell, count = np.unique(cell_of(np.ascontiguousarray(codes[:, t])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell), pa.array(count.astype(np.int64))], names=["table", "cell", "n"])

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, min(2048, batch.num_rows - at))
                codes = codes_of(packed(part.column(0)))
                for t in range(codes.shape[1]):
                    own = np.ascontiguousarray(codes[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(cell_of(own)), pa.array(own), *part.columns], names=["table", "cell", "bucket", "v", "ids", "class"])

    def visits(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, min(64, batch.num_rows - at))
                position = shared.value.positions(packed(part.column(3)))
                for t in range(position.shape[1]):
                    codes = shared.value.visited(position[:, t])
                    cell = cell_of(codes.ravel())
                    query = np.repeat(np.arange(len(codes)), codes.shape[1])
                    order = np.lexsort((codes.ravel(), cell, query))
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(cell[order]) != 0)]))
                    some = part.take(pa.array(query[order][first]))
                    own = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(codes.ravel()[order]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), t, np.int32)), pa.array(cell[order][first]), *some.columns, own], names=["table", "cell", *part.schema.names, "visits"])

    sizes = classes.select("v").mapInArrow(tidy(counted), "table int, cell int, n long").groupBy("table", "cell").agg(F.ceil(F.sum("n") / (2 * CELL_ROWS)).cast("int").alias("chunks"))
    sizes = cut(sizes)
    indexed = classes.select("v", "ids", "class").mapInArrow(tidy(index), "table int, cell int, bucket long, v array<double>, ids array<long>, class long")
    indexed = indexed.join(sizes, ["table", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks").cast("int"))
    asked = queries.select(*QUERY, "times", "v").mapInArrow(tidy(visits), "table int, cell int, query_id long, query_class long, times long, v array<double>, visits array<long>")
    asked = asked.join(sizes, ["table", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    none = lambda kind: F.lit(None).cast(kind)

    def search(index_rows: DataFrame, asked: DataFrame) -> DataFrame:
        group = ["table", "cell", "chunk"]
        both = index_rows.select(*group, F.lit(False).alias("query"), *[none("long").alias(c) for c in (*QUERY, "times")], "bucket", "class", "v", "ids", none("array<long>").alias("visits")).unionByName(
            asked.select(*group, F.lit(True).alias("query"), *QUERY, "times", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("class"), "v", none("array<long>").alias("ids"), "visits")
        )
        return both.repartition(*group).sortWithinPartitions(*group, "query").mapInArrow(tidy(lambda b: nearest_in(b, k)), FOUND.format("double"))

    found = cut(best_classes(search(indexed, asked), k, ascending=True))
    least = min(k, n - 1)

    def lacking(batches):
        """The queries whose visits fell short: too few finds, or too small a chance at the last one's distance."""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, min(64, batch.num_rows - at))
                finds, last = part.column(4).to_numpy(), part.column(5).to_numpy()
                likely = shared.value.chance(shared.value.positions(packed(part.column(3))), last)
                yield part.select([0, 1, 2, 3]).filter(pa.array((finds < least) | ~((likely >= LEAST_CHANCE) | (finds == 0))))

    finds = found.groupBy(*QUERY).agg(F.sum(F.size("ids")).alias("finds"), F.max("score").alias("last"))
    known = queries.select(*QUERY, "times", "v").join(finds, QUERY, "left").select(*QUERY, "times", "v", F.coalesce("finds", F.lit(0)).cast("long").alias("finds"), F.coalesce("last", F.lit(0.0)).alias("last"))
    short = cut(known.mapInArrow(tidy(lacking), "query_id long, query_class long, times long, v array<double>"))
    n_short = short.count()
    LOG.info("%d queries are compared with every row", n_short)
    if not n_short:
        return answers(found, k, ascending=True)
    place = [F.lit(0).alias("table"), F.lit(0).alias("chunk")]
    blocks = classes.select(*place, F.pmod(F.xxhash64("class"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).cast("long").alias("bucket"), "class", "v", "ids")
    everywhere = short.select(*place, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), *QUERY, "times", "v", none("array<long>").alias("visits"))
    return answers(best_classes(found.unionByName(search(blocks, everywhere)), k, ascending=True), k, ascending=True)
