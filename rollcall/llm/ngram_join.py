"""Near-duplicate join on the Jaccard similarity of word n-grams.

1. Rows of one text make a *class*; from here on each class counts once.
2. Each text has 150 MinHash values of its set of hashed n-grams.  Bands of five
   bring classes with equal values together (a pair at a similarity of 0.8 is
   missed with a probability of one in 150,000, a more similar one hardly ever).
3. Within a bucket, pairs are pruned by Bayesian inference: the values are
   compared a few at a time, and a pair goes as soon as the posterior
   probability that its similarity reaches the threshold is below ``tolerance``.
   What is left joins classes into candidate groups, by spanning edges only.
4. Each class's n-grams go to its group, where pairs are pruned the same way
   and the rest are verified exactly on the n-gram sets.

Where spanning edges are enough (step 3, and step 4 for :func:`keep_one`) a large
bucket or group is dealt out in chunks, each with the same few *pivots*.  Members that
chunks and pivots join into the largest set are done with; only the others
meet the members of other chunks in a second pass.  A bucket of near copies
so costs what its members cost, and no link is lost.  Counts of links
(:func:`class_rows`) need all pairs of a group: its chunks meet in pairs of chunks.
Pairs exist only inside a task, as numpy arrays; tasks return counts by class
and edges of a spanning forest, so no result grows with the square of a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, modest_batches, plain_names, tidy
from rollcall.llm.components import components

WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
SLICE_BYTES = 1 << 22
BANDS, BAND_ROWS = 30, 5
HASHES = BANDS * BAND_ROWS
#: Rounds of comparison: so many values in all after each.
ROUNDS = (15, 30, 60, HASHES)
#: Members of a bucket in one chunk, about, and in one of the second pass; pivots of a large bucket or group, at most.
BUCKET_ROWS, WIDE_ROWS, PIVOTS = 512, 4096, 8
#: Members of a group that one chunk holds, about, and bytes of n-grams.
CHUNK_ROWS, CHUNK_BYTES = 768, 6 << 20
#: Steps of a distance, and how many a ring around a pivot is wide.
STEPS, RING, RING_ID = 1000, 10, 1 << 20
#: Rows of the group table (under 64 bytes each) up to which it is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000
#: From this many members on, intersections of a group are counted together.
TOGETHER = 24

_rng = np.random.default_rng(7)
MULTIPLIER = (_rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADDEND = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


# ---- n-grams and sketches ---------------------------------------------------------


def grams(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    A text of fewer words has one gram, all of its words; a text without words none.
    """
    import xxhash

    words = WORD_RE.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * _POWERS[k % 8] + np.uint64(k)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhashes(hashed: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, 32 bits each."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashed), 2048):
            out = np.minimum(out, (hashed[at : at + 2048, None] * MULTIPLIER + ADDEND).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for part in mins.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
            key = (key ^ part) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


# ---- Bayesian pruning -------------------------------------------------------------------


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each round, the fewest equal values with which a pair stays.

    With a uniform prior the similarity after m of n equal values is Beta(m + 1, n - m + 1).
    Values are compared by their low eight bits: different ones agree once in 256,
    so the bound is for the rate s + (1 - s) / 256.
    """
    s = (np.arange(200_000) + 0.5) / 200_000
    rate = s + (1 - s) / 256
    out = []
    for n in ROUNDS:
        for m in range(n + 1):
            density = m * np.log(rate) + (n - m) * np.log1p(-rate)
            density = np.exp(density - density.max())
            if density[s >= threshold].sum() / density.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, signatures: np.ndarray, needed: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) stay after all rounds."""
    keep = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    done = 0
    for upto, least in zip(ROUNDS, needed):
        equal[keep] += (signatures[a[keep], done:upto] == signatures[b[keep], done:upto]).sum(axis=1, dtype=np.int32)
        keep = keep[equal[keep] >= least]
        done = upto
    return keep


class Forest:
    """Union of sets; each is named by its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        """Each set as a star: its least member, and each of the others."""
        roots = [self.root(i) for i in range(len(self.up))]
        others = [i for i, r in enumerate(roots) if r != i]
        return [roots[i] for i in others], others


def groups_of(batches, key_columns: int):
    """Arrow tables made of whole groups: rows with equal leading columns, which come together."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:key_columns]]
        change = np.flatnonzero(np.any([i[1:] != i[:-1] for i in ids], axis=0)) + 1
        last = [i[0] for i in ids]
        if held and any(h.column(k)[h.num_rows - 1].as_py() != v for h in held[-1:] for k, v in enumerate(last)):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def numbered(table: pa.Table, key_columns: int) -> np.ndarray:
    """A number for each row's group."""
    ids = [c.to_numpy() for c in table.columns[:key_columns]]
    return np.concatenate([[0], np.cumsum(np.any([i[1:] != i[:-1] for i in ids], axis=0))]) if len(table) else np.zeros(0, np.int64)


def matrix(column: pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def spanning_edges(batches, needed: tuple[int, ...], threshold: float | None = None):
    """Spanning edges of the pairs that stay plausible (and reach ``threshold``, if given, on their n-grams), in each group.

    Groups have equal unit, lo and hi.  A side of -1: all pairs count; else those of different sides.
    """
    for table in groups_of(batches, 3):
        group, side = numbered(table, 3), table.column("side").to_numpy()
        signatures = matrix(table.column("signature"), HASHES, np.uint8)
        size = table.column("n").to_numpy() if threshold else None
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()] if threshold else None
        forest = Forest(len(table))
        parts = np.bincount(group)  # sets left in each group
        alive = np.arange(len(table))  # rows of groups that aren't one set yet
        for d in range(1, len(table)):
            i = alive[alive + d < len(table)]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            alive = i
            i = i[(side[i] < 0) | (side[i] != side[i + d])]
            if threshold:
                i = i[np.minimum(size[i], size[i + d]) >= threshold * np.maximum(size[i], size[i + d]) - 1e-9]
            for k in plausible(i, i + d, signatures, needed):
                a = int(i[k])
                if forest.root(a) != forest.root(a + d) and (not threshold or linked(sets, size, np.array([a]), np.array([a + d]), threshold)[0]):
                    parts[group[a]] -= forest.unite(a, a + d)
            alive = alive[parts[group[alive]] > 1]
        keys = table.column("key")
        a, b = (pa.array(x, pa.int64()) for x in forest.edges())
        yield pa.RecordBatch.from_arrays([keys.take(a).combine_chunks().cast(pa.binary()), keys.take(b).combine_chunks().cast(pa.binary())], names=["a", "b"])


def linked(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, together: bool = False) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly: both / (|x| + |y| - both), in integers of a thousandth."""
    both = (common_grams_together if together and len(a) else common_grams)(sets, a, b)
    return both * 1000 >= round(threshold * 1000) * (size[a] + size[b] - both)


def common_grams(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets."""
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        s, t = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
        if len(t):
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            out[k] = np.count_nonzero(t[at] == s)
    return out


def common_grams_together(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same, from products of an incidence matrix without the grams of one set only."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    column = np.cumsum(count > 1) - 1
    gram, owner = column[gram[shared]], owner[shared]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        lo, hi = np.searchsorted(gram, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], gram[lo:hi] - at] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def verified(batches, needed: tuple[int, ...], threshold: float):
    """Links of each class, and spanning edges of the links, in each group (or pair of its chunks)."""
    for whole in groups_of(batches, 3):
        group = numbered(whole, 3)
        bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() + [len(group)]
        at = 0
        while at + 1 < len(bounds):  # some small groups at a time, or one large one
            upto = at + 1
            while upto + 1 < len(bounds) and bounds[upto + 1] - bounds[at] <= 256:
                upto += 1
            yield links_in(whole.slice(bounds[at], bounds[upto] - bounds[at]), needed, threshold)
            at = upto


def links_in(table: pa.Table, needed: tuple[int, ...], threshold: float) -> pa.RecordBatch:
    group = numbered(table, 3)
    side = table.column("side").to_numpy()
    signatures = matrix(table.column("signature"), HASHES, np.uint8)
    size, x, reach = table.column("n").to_numpy(), table.column("x").to_numpy(), steps(threshold)
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    together = len(sets) > TOGETHER and group[-1] == 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(1, len(sets)):
        i = np.arange(len(sets) - d)
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        i = i[(side[i] < 0) | (side[i] != side[i + d])]
        i = i[(x[i] < 0) | ((x[i] + x[i + d] > reach) & (np.abs(x[i] - x[i + d]) <= reach + 1))]
        i = i[np.minimum(size[i], size[i + d]) >= threshold * np.maximum(size[i], size[i + d]) - 1e-9]
        i = i[plausible(i, i + d, signatures, needed)]
        found.append((i, i + d))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    reached = linked(sets, size, a, b, threshold, together)
    a, b = a[reached], b[reached]
    counts = np.bincount(np.concatenate([a, b]), minlength=len(sets))
    forest = Forest(len(sets))
    for one, other in zip(a.tolist(), b.tolist()):
        forest.unite(one, other)
    have = np.flatnonzero(counts)
    keys = table.column("key")
    roots, others = forest.edges()
    first = pa.array([*have.tolist(), *roots], pa.int64())
    other = pa.array([None] * len(have) + others, pa.int64())
    links = pa.array([*counts[have].tolist(), *[0] * len(roots)], pa.int64())
    take = lambda at: keys.take(at).combine_chunks().cast(pa.binary())
    return pa.RecordBatch.from_arrays([take(first), take(other), links], names=["a", "b", "links"])


# ---- the join ----------------------------------------------------------------------------


def steps(threshold: float) -> int:
    """The largest distance of linked sets, in steps."""
    return STEPS - round(threshold * STEPS)


def distances(batches):
    """group, key, n, and the distance (in steps, rounded up) of each member to each pivot of its group; rows with a side are pivots."""
    for table in groups_of(batches, 3):
        side, size = table.column("side").to_numpy(), table.column("n").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        members = np.flatnonzero(side < 0)
        away = np.full((len(members), PIVOTS), STEPS, np.int32)
        for p in np.flatnonzero(side >= 0).tolist():
            both = common_grams(sets, members, np.full(len(members), p))
            union = size[members] + size[p] - both
            away[:, side[p]] = -(-STEPS * (union - both) // union)
        rows = pa.array(members)
        column = lambda name: table.column(name).take(rows).combine_chunks()  # noqa: B023, E731
        offsets = pa.array(np.arange(len(members) + 1) * PIVOTS, pa.int32())
        yield pa.RecordBatch.from_arrays([column("group").cast(pa.binary()), column("key").cast(pa.binary()), column("n"), pa.ListArray.from_arrays(offsets, pa.array(away.ravel()))], names=["group", "key", "n", "away"])


@dataclass
class Rings:
    """links: key, links (those that need no comparison); edges: a, b, joining what they join; members: the rows that must meet, dealt out."""

    links: DataFrame
    edges: DataFrame
    members: DataFrame


def around_pivots(large: DataFrame, threshold: float) -> Rings:
    """Groups of several chunks (group, chunks, key, n, signature, grams): what one pivot of each settles, and who must still meet."""
    reach = steps(threshold)
    chunk = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("long")
    payload = ["key", "n", "grams"]
    slots = large.groupBy("group", "chunks", F.pmod(F.xxhash64("key", F.lit(78)), F.lit(PIVOTS)).cast("long").alias("side")).agg(F.min(F.struct(*payload)).alias("p"))
    slots = cut(slots)
    pivots = slots.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
    own = chunk(F.col("chunks"), 77)
    rows = large.select("group", own.alias("lo"), own.alias("hi"), F.lit(-1).cast("long").alias("side"), *payload)
    rows = rows.unionByName(pivots.select("group", "lo", F.col("lo").alias("hi"), "side", "p.*"))
    measured = cut(dealt(rows, "group").mapInArrow(tidy(distances), "group binary, key binary, n long, away array<int>"))
    near = F.array(*[F.sum((F.get("away", F.lit(i)) <= reach // 2).cast("long")) for i in range(PIVOTS)])
    best = measured.groupBy("group").agg(near.alias("near")).select("group", (F.array_position("near", F.array_max("near")) - 1).alias("side"))
    best = cut(best.join(slots.select("group", "side", F.col("p.key").alias("pivot")), ["group", "side"]))
    placed = measured.join(best, "group").select("group", "key", "n", "pivot", F.element_at("away", F.col("side").cast("int") + 1).alias("x"))
    placed = cut(placed.withColumn("ring", F.floor(F.col("x") / RING).cast("long")))
    # Settled links: a histogram of at most reach + 1 rows a group.
    counts = placed.where(F.col("x") <= reach).groupBy("group", "x").agg(F.count("*").alias("m")).groupBy("group").agg(F.collect_list(F.struct("x", "m")).alias("held"))
    among = F.aggregate("held", F.lit(0).cast("long"), lambda so_far, h: so_far + F.when(h["x"] <= reach - F.col("x"), h["m"]).otherwise(0))
    links = placed.where(F.col("x") <= reach).join(counts, "group").select("key", (among - (2 * F.col("x") <= reach).cast("long")).alias("links")).where("links > 0")
    edges = placed.where((F.col("x") <= reach) & (F.col("key") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    # Rings: two of them meet unless all their pairs are near enough, or all too far.
    size = F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") * 8 / CHUNK_BYTES))
    rings = placed.groupBy("group", "ring").agg(size.alias("chunks")).groupBy("group").agg(F.collect_list(F.struct("ring", "chunks")).alias("rings"))
    meets = lambda r: (RING * (r["ring"] + F.col("ring")) + 2 * (RING - 1) > reach) & (RING * F.abs(r["ring"] - F.col("ring")) - (RING - 1) <= reach + 1)
    ids = F.flatten(F.transform(F.filter("rings", meets), lambda r: F.transform(F.sequence(F.lit(0).cast("long"), r["chunks"] - 1), lambda j: r["ring"] * RING_ID + j)))
    own_chunks = F.filter("rings", lambda r: r["ring"] == F.col("ring"))[0]["chunks"]
    meeting = placed.join(rings, "group").withColumn("own", F.col("ring") * RING_ID + chunk(own_chunks, 80)).withColumn("others", ids).where(F.size("others") > 0)
    whole = meeting.select("group", "key", "x", "own", "others").join(large.drop("chunks"), ["group", "key"]).withColumn("other", F.explode("others"))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own"))
    members = whole.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "x", "key", "n", "signature", "grams")
    return Rings(links, edges, members)


def dealt(df: DataFrame, unit: str) -> DataFrame:
    """Rows of a group (equal unit, lo and hi) together, in one partition and next to each other, the columns of the group first."""
    keys = [unit, "lo", "hi"]
    return df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, "key")


def spanning(members: DataFrame, unit: str, edges) -> DataFrame:
    """a, b: edges that join what any pairs inside the units join.

    ``members`` has unit, key, ``chunks`` and ``wide`` (how many chunks the unit has, in the
    first and second pass) and what ``edges`` (a function of Arrow batches) compares.
    """
    payload = [c for c in members.columns if c not in (unit, "chunks", "wide")]
    compare = lambda df: cut(dealt(df, unit).mapInArrow(tidy(edges), "a binary, b binary"))
    chunk = lambda chunks, seed: F.pmod(F.xxhash64("key", F.lit(seed)), chunks).cast("int")
    members = cut(members)
    own = chunk(F.col("chunks"), 77)
    first = members.select(unit, own.alias("lo"), own.alias("hi"), F.lit(-1).alias("side"), *payload)
    large = members.where("chunks > 1")
    if not large.limit(1).count():
        return compare(first)
    pivots = large.groupBy(unit, "chunks", F.pmod(F.xxhash64("key", F.lit(78)), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(*payload)).alias("p"))
    pivots = pivots.withColumn("lo", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    found = compare(first.unionByName(pivots.select(unit, "lo", F.col("lo").alias("hi"), F.lit(-1).alias("side"), "p.*")))

    labels = components(found).withColumnRenamed("node", "key")
    labelled = large.select(unit, "key", "wide").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = labelled.groupBy(unit, "wide", "label").agg(F.count("*").alias("n")).groupBy(unit, "wide").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("main"))
    rest_chunks = F.ceil(F.col("wide") * (F.col("m") - F.col("main.n")) / F.col("m")).cast("int")
    sizes = cut(sizes.where(F.col("m") > F.col("main.n")).select(unit, F.col("main.label").alias("main"), rest_chunks.alias("rest_chunks")))
    if not sizes.limit(1).count():
        return found
    upto = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    some = large.join(sizes, unit)
    rest = some.join(labelled.select(unit, "key", "label"), [unit, "key"]).where("label != main")
    left = rest.withColumn("lo", chunk(F.col("rest_chunks"), 79)).withColumn("hi", upto(F.col("wide"))).withColumn("side", F.lit(0))
    right = some.withColumn("hi", chunk(F.col("wide"), 77)).withColumn("lo", upto(F.col("rest_chunks"))).withColumn("side", F.lit(1))
    both = [d.select(unit, "lo", "hi", "side", *payload) for d in (left, right)]
    return found.unionByName(compare(both[0].unionByName(both[1])))


@dataclass
class Candidates:
    """texts: key and __text of every row; groups: key, n, signature and group of the texts with a plausible partner."""

    texts: DataFrame
    groups: DataFrame
    needed: tuple[int, ...]
    n: int
    threshold: float

    def with_grams(self) -> DataFrame:
        """The groups with each text's n-grams (sorted 64-bit hashes)."""
        n = self.n

        def sets(batches):
            from rollcall.llm.common import slices
            from rollcall.llm.ngram_join import SLICE_BYTES, grams

            for part in slices(batches, "__text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([grams(t, n).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["key", "grams"])

        wanted = F.broadcast(self.groups.select("key")) if self.groups.count() <= BROADCAST_ROWS else self.groups.select("key")
        texts = self.texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(tidy(sets), "key binary, grams binary")
        totals = self.groups.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("chunks"))
        return self.groups.join(totals, "group").join(texts, "key").select("group", "chunks", "key", "n", "signature", "grams")


def key_of(text: str):
    """The digest that stands for a text; a null one counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def candidates(texts: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> Candidates:
    """Groups of texts that plausible pairs join; ``texts``: key and __text."""
    modest_batches(texts.sparkSession)
    needed = least_matches(threshold, tolerance)

    def sketch(batches):
        from rollcall.llm.common import slices
        from rollcall.llm.ngram_join import BANDS, SLICE_BYTES, band_keys, grams, minhashes

        for part in slices(batches, "__text", SLICE_BYTES):
            sets = [grams(t, n) for t in part.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            mins = [minhashes(sets[i]) for i in some]
            bands = np.concatenate([band_keys(m) for m in mins]) if mins else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(some, pa.int64())), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([m.astype(np.uint8).tobytes() for m in mins], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands))],
                names=["key", "n", "signature", "bands"],
            )

    sketches = cut(texts.mapInArrow(tidy(sketch), "key binary, n long, signature binary, bands array<long>").dropDuplicates(["key"]))
    banded = sketches.select("key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    sized = lambda rows: F.ceil(F.col("m") / rows).cast("int")
    members = banded.join(shared, "bucket").join(sketches.select("key", "signature"), "key").select("bucket", sized(BUCKET_ROWS).alias("chunks"), sized(WIDE_ROWS).alias("wide"), "key", "signature")
    groups = components(spanning(members, "bucket", lambda batches: spanning_edges(batches, needed))).select(F.col("node").alias("key"), F.col("label").alias("group"))
    return Candidates(texts, cut(groups.join(sketches.select("key", "n", "signature"), "key")), needed, n, threshold)


def class_rows(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_copies, n_links: one row for each row of ``docs``.

    class_id is the least doc_id of all documents that near-duplicate links join
    (a document without links has its own, or that of its exact copies); n_copies
    counts the other rows of the same text; n_links the *different* texts of
    similarity ``threshold`` or more.  Words are runs of characters other than
    ASCII white space, compared as they are.  A text of fewer than n words is one
    gram; a text without words (or null) is like no other text, but equal to its
    copies.  A null id counts in no minimum.  An empty table gives no rows.
    """
    rows = docs.select("doc_id", key_of("text").alias("key"))
    near = candidates(docs.select(key_of("text").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("__text")), **options)
    needed, threshold = near.needed, near.threshold
    whole = cut(near.with_grams())
    zero = F.lit(0).cast("long")
    in_groups = whole.where("chunks = 1").select("group", zero.alias("lo"), zero.alias("hi"), F.lit(-1).cast("long").alias("side"), F.lit(-1).alias("x"), "key", "n", "signature", "grams")
    large = whole.where("chunks > 1")
    settled = around_pivots(large, threshold) if large.limit(1).count() else None
    if settled:
        in_groups = in_groups.unionByName(settled.members)
    found = cut(dealt(in_groups, "group").mapInArrow(tidy(lambda batches: verified(batches, needed, threshold)), "a binary, b binary, links long"))
    links, edges = found.where("b is null").select(F.col("a").alias("key"), "links"), found.where("b is not null").select("a", "b")
    if settled:
        links, edges = links.unionByName(settled.links), edges.unionByName(settled.edges)
    links = links.groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(edges).withColumnRenamed("node", "key")
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    classes = classes.join(links, "key", "left").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = classes.groupBy("label").agg(F.min("first_id").alias("class_id"))
    classes = classes.join(least, "label").select("key", "class_id", (F.col("copies") - 1).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return rows.join(classes, "key").select("doc_id", "class_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the one with the least doc_id (a null one only if there is no other).

    Classes are those of :func:`class_rows`; columns may have any names.  Rows
    that repeat both id and text are kept once.  Links are verified until they join a
    group, not counted; texts are shuffled once, to the ids that stay.
    """
    plain, name = plain_names(docs)
    doc_id, text = name["doc_id"], name["text"]
    near = candidates(plain.select(key_of(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("__text")), **options)
    needed, threshold = near.needed, near.threshold
    members = near.with_grams().withColumn("wide", F.col("chunks"))
    found = spanning(members, "group", lambda batches: spanning_edges(batches, needed, threshold))
    labels = components(found).withColumnRenamed("node", "key")
    each = plain.select(F.col(doc_id).alias("id"), key_of(text).alias("key")).groupBy("key", "id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "key", "rows")).alias("first")
    best = each.groupBy("key").agg(first).join(labels, "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("first").alias("first"))
    chosen = cut(best.select(F.col("first.key").alias("__key"), F.col("first.id").alias("__id"), F.col("first.rows").alias("__rows")))
    kept = plain.withColumn("__own", key_of(text)).join(chosen.drop("__rows"), (F.col("__own") == F.col("__key")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_semi")
    if chosen.where("__rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["__own"])
    return kept.select(*plain.columns).toDF(*docs.columns)
