"""Mixing sources to target weights, by index over fixed-length blocks.

The words of each source, in a fixed pseudorandom order of its documents, are
packed into blocks of ``block_words``.  The mix is a run of slots, dealt into
output shards; each shard draws its sources' slot counts from a multinomial.  A
source's n-th slot is mapped to a block by a keyed permutation of the block
numbers, another one on each pass over the source, and joined to the block by
number.  Where all shards together drew too many slots of a source, the last
ones go to the sources that have too few; a source's very last slot may take
only the front of its block, so that each source's words equal its target,
rounded.

Positions come from two levels of running sums (buckets of a few thousand rows,
then the buckets of a source), so no source, however large, meets in one task.
What the driver holds is one row a source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import cut, modest_batches, plain_names, tidy

BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
#: Rows of a source that are put in order together, about.
BUCKET_ROWS = 4096
#: Sources up to which the per-source table (under 200 bytes a row) is broadcast; beyond, it is shuffled.
BROADCAST_SOURCES = 100_000
#: Copies of one row that one task turns into rows.
COPIES = 1 << 16
SLICE_BYTES = 1 << 22
WEIGHTS = (5, 2, 1)
#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


# ---- targets ------------------------------------------------------------------


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """``share`` of all sizes, split by weight; none above ``most`` times its size, the excess reshared."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    caps, out = most * sizes, np.zeros(len(sizes))
    left, free = share * sizes.sum(), np.ones(len(sizes), bool)
    while free.any():
        part = left * weights[free] / weights[free].sum()
        above = part > caps[free]
        if not above.any():
            out[free] = part
            break
        full = np.flatnonzero(free)[above]
        out[full] = caps[full]
        left -= caps[full].sum()
        free[full] = False
    return out


# ---- permutations ---------------------------------------------------------------


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of ``range(n)`` at ``i`` (its inverse with ``back``): a Feistel net, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [_mix(np.array([r + 1], np.uint64), np.array([key & (1 << 64) - 1], np.uint64)) for r in range(4)]
    out = np.array(i, np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            a, b = x >> half, x & mask
            for k in keys[::-1] if back else keys:
                a, b = (b ^ (_mix(a, k) & mask), a) if back else (b, a ^ (_mix(b, k) & mask))
            out[todo] = (a << half) | b
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


# ---- the plan: one row a source ----------------------------------------------------


@dataclass
class Plan:
    """Of each source, in order: name, size, target and the slots that make it up."""

    names: list
    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last_cut: np.ndarray
    buckets: np.ndarray
    keys: list
    block_words: int
    shard_slots: int
    seed: int

    @property
    def total(self) -> int:
        return int(self.slots.sum())

    @property
    def shards(self) -> int:
        return -(-self.total // self.shard_slots)

    def draw(self, shard: int) -> np.ndarray:
        """The slots of each source that this shard draws."""
        n = min(self.shard_slots, self.total - shard * self.shard_slots)
        return np.random.default_rng([self.seed, shard]).multinomial(n, self.slots / self.total)

    def length(self, source: int, block: np.ndarray) -> np.ndarray:
        return np.minimum(self.block_words, self.size[source] - block * self.block_words)

    def block_of(self, source: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pass over the source, and block, of each of its slots."""
        n = int(self.blocks[source])
        turn, index = slot // n, slot % n
        block = np.zeros(len(slot), np.int64)
        for t in np.unique(turn):
            block[turn == t] = permuted(index[turn == t], n, self.keys[source] + int(t))
        return turn, block


def make_plan(names: list, sizes: list[int], rows: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 2) -> Plan:
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    names = [names[i] for i in order]
    size = np.array([sizes[i] for i in order], np.int64)
    target = targets(size, np.array([weights[i % len(weights)] for i in range(len(names))]), share, most)
    blocks = -(-size // block_words)
    keys = [int(x) for x in np.random.default_rng([seed, len(names)]).integers(0, 1 << 62, len(names))]
    plan = Plan(names, size, target, blocks, np.zeros_like(size), np.zeros_like(size), np.array([max(1, -(-rows[i] // BUCKET_ROWS)) for i in order]), keys, block_words, shard_slots, seed)
    for s in range(len(names)):
        if not size[s]:
            continue
        want = int(np.floor(target[s] + 0.5))
        turns, rest = divmod(want, int(size[s]))
        n, short = int(blocks[s]), int(blocks[s]) * block_words - int(size[s])
        m = -(-rest // block_words)
        at = int(permuted(np.array([n - 1]), n, keys[s] + turns, back=True)[0]) if rest else n
        if at < m:  # the short block is among the slots
            m = -(-(rest + short) // block_words)
        plan.slots[s] = turns * n + m
        plan.last_cut[s] = rest - ((m - 1) * block_words - (short if at < m - 1 else 0)) if rest else block_words
    return plan


# ---- slots -------------------------------------------------------------------------


def slots(spark, plan: Plan) -> DataFrame:
    """shard, source (number), turn, block, words: one row for each slot of the mix.

    ``words`` is -1 where the slot takes its whole block, else how many of its first words.
    """
    fields = "shard long, source int, turn int, block long, words int"
    if not plan.total:
        return spark.createDataFrame([], fields)
    shared = spark.sparkContext.broadcast(plan)

    def drawn(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = shared.value.draw(shard)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["shard", "source", "count"])

    counts = spark.range(plan.shards).mapInArrow(tidy(drawn), "shard long, source int, count long")
    had = np.zeros(len(plan.names), np.int64)
    for r in counts.groupBy("source").agg(F.sum("count").alias("n")).collect():  # one row a source
        had[r.source] = r.n
    surplus, lack = np.maximum(had - plan.slots, 0), np.maximum(plan.slots - had, 0)
    surplus_from, lack_from = np.cumsum(surplus) - surplus, np.cumsum(lack) - lack
    running = F.sum("count").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))

    def dealt(batches):
        plan = shared.value
        for batch in batches:
            for shard, source, count, start in zip(*(c.to_pylist() for c in batch.columns)):
                slot = np.arange(start, start + count)
                owner = np.full(count, source)
                over = slot >= plan.slots[source]
                if over.any():  # slots that this source has no use for go to one that has too few
                    rank = surplus_from[source] + slot[over] - plan.slots[source]
                    owner[over] = np.searchsorted(lack_from + lack, rank, side="right")
                    slot[over] = had[owner[over]] + rank - lack_from[owner[over]]
                for s in np.unique(owner):
                    own = slot[owner == s]
                    turn, block = plan.block_of(s, own)
                    words = np.full(len(own), -1, np.int32)
                    last = own == plan.slots[s] - 1
                    words[last & (plan.length(s, block) > plan.last_cut[s])] = plan.last_cut[s]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard)), pa.array(np.full(len(own), s, np.int32)), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(words)], names=["shard", "source", "turn", "block", "words"])

    return counts.withColumn("start", F.coalesce(running, F.lit(0)).cast("long")).mapInArrow(tidy(dealt), fields)


# ---- documents -----------------------------------------------------------------------

#: What tells rows of documents apart here; rows that are equal in all of it are copies, and numbered.
ROW = ["doc_id", "source", "digest"]
KEY = [*ROW, "copy"]


def digest_of(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def planned(docs: DataFrame, **options) -> tuple[Plan, DataFrame, int]:
    """The plan; a narrow row for each row of ``docs`` (doc_id, source, text); the most copies that a row has.

    The narrow table has KEY, size, number (the source's), source_size, target and
    bucket.  It is written once: the texts are read, and their words counted, once.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", digest_of("text").alias("digest"), size.alias("size")).groupBy(*ROW, "size").agg(F.count("*").alias("copies")))
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n"), F.max("copies").alias("most")).collect()  # one row a source
    plan = make_plan([r.source for r in per_source], [r["size"] for r in per_source], [r["n"] for r in per_source], **options)
    rows = [(name, i, int(plan.buckets[i]), int(plan.size[i]), float(plan.target[i])) for i, name in enumerate(plan.names)]
    sources = spark.createDataFrame(rows, "name string, number int, buckets int, source_size long, target double")
    if len(rows) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    most = max((r.most for r in per_source), default=1)
    if most > COPIES:  # many copies are dealt out before they become rows
        sized = sized.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int")))).repartition("doc_id", "run")
    else:
        sized = sized.withColumn("run", F.lit(0))
    first = F.col("run").cast("long") * COPIES
    each = sized.withColumn("copy", F.explode(F.sequence(first, F.least("copies", first + COPIES) - 1)))
    dealt = each.join(sources, F.col("source").eqNullSafe(F.col("name")))
    bucket = F.pmod(F.xxhash64("doc_id", "digest", "copy", F.lit(plan.seed)), F.col("buckets")).cast("int")
    return plan, dealt.select(*KEY, "size", "number", "source_size", "target", bucket.alias("bucket")), most


def laid_out(dealt: DataFrame) -> DataFrame:
    """``dealt`` with the place of each row's first word among its source's words."""
    sums = dealt.groupBy("number", "bucket").agg(F.sum("size").alias("all"))
    before = F.sum("all").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("number", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("number", "bucket").orderBy("doc_id", "size", "digest", "copy")
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The sums grow with the documents: they are shuffled, like the rows (which are in place already).
    return placed.join(sums.hint("merge"), ["number", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "bucket")


def spans(laid: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document reaches into: its words' places ``lo`` to ``hi`` in the block."""
    end = F.col("start") + F.col("size")
    whole = lambda c: F.floor(c / F.lit(block_words)).cast("long")
    numbers = F.when(F.col("size") > 0, F.sequence(whole(F.col("start")), whole(end - 1)))
    base = F.col("block") * block_words
    out = laid.withColumn("block", F.explode_outer(numbers))
    return out.withColumn("lo", F.greatest(F.col("start") - base, F.lit(0))).withColumn("hi", F.least(end - base, F.lit(block_words)))


def mix_shares(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every row.

    A null text, like an empty one, has size 0 and is never taken; null is a
    source like others and comes last.  Rows that repeat count each.  Reruns
    agree, whatever the partitions.  An empty table gives no rows.  Other columns,
    whatever their names, are not read.
    """
    plan, dealt, _ = planned(docs.select("doc_id", "source", "text"), **options)
    taken = slots(docs.sparkSession, plan).groupBy(F.col("source").alias("number"), "block").agg(F.count_if(F.col("words") < 0).alias("times"), F.max(F.when(F.col("words") >= 0, F.col("words"))).alias("front"))
    in_front = F.when(F.col("front") > F.col("lo"), F.least("hi", F.col("front").cast("long")) - F.col("lo")).otherwise(0)
    got = F.coalesce(F.col("times") * (F.col("hi") - F.col("lo")), F.lit(0)) + in_front
    joined = spans(laid_out(dealt), plan.block_words).join(taken.hint("merge"), ["number", "block"], "left")
    summed = joined.groupBy(*KEY, "size", "source_size", "target").agg(F.sum(got).cast("long").alias("taken"))
    return summed.select("doc_id", "size", "source_size", "target", "taken")


def pieces_taken(plan: Plan, dealt: DataFrame) -> DataFrame:
    """KEY, size and pieces (pass, first word, end) of every row that the mix takes words of."""
    chosen = slots(dealt.sparkSession, plan).select(F.col("source").alias("number"), "block", "turn", "words")
    hi = F.when(F.col("words") >= 0, F.least("hi", F.col("words").cast("long"))).otherwise(F.col("hi"))
    base = F.col("block") * plan.block_words - F.col("start")
    return (
        spans(laid_out(dealt), plan.block_words)
        .join(chosen.hint("merge"), ["number", "block"])
        .where(hi > F.col("lo"))
        .select(*KEY, "size", F.struct("turn", (base + F.col("lo")).alias("a"), (base + hi).alias("b")).alias("piece"))
        .groupBy(*KEY, "size")
        .agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # two for each block of the document, at most
    )


def taken_text(text: str, size: int, pieces: list[dict]) -> str:
    """The whole text if the pieces hold all of its words, else the stretches taken, in order, line by line."""
    joined: list[list[int]] = []
    for p in pieces:
        if joined and joined[-1][1] == p["a"]:
            joined[-1][1] = p["b"]
        else:
            joined.append([p["a"], p["b"]])
    if joined == [[0, size]]:
        return text
    places = [m.span() for m in WORD_RE.finditer(text)]
    return "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in joined)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: of each document, a row for each pass that takes words of it.

    A row's text is the whole text where the pass takes all of its words, else
    the stretches taken, in order, with a line break between them; ``n_chars``,
    if there, follows the text.  Documents that no pass takes are not returned.
    Nulls, copies and other columns are treated as by :func:`mix_shares`; columns may have any names.
    """
    modest_batches(docs.sparkSession)
    plain, name = plain_names(docs)
    plan, dealt, most = planned(plain.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["source"]).alias("source"), F.col(name["text"]).alias("text")), **options)
    pieces = pieces_taken(plan, dealt).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(KEY)], "size", "pieces")
    rows = plain.withColumn("digest", digest_of(name["text"]))
    same = F.col(name["doc_id"]).eqNullSafe(F.col("k0")) & F.col(name["source"]).eqNullSafe(F.col("k1")) & (F.col("digest") == F.col("k2"))
    if most > 1:  # copies are told apart by number, in the order of their other columns
        others = [F.col(f.name) for f in plain.schema if "map<" not in f.dataType.simpleString()]
        order = Window.partitionBy(name["doc_id"], name["source"], "digest").orderBy(F.xxhash64(*others))
        rows = rows.withColumn("number", F.row_number().over(order) - 1)
        same = same & (F.col("number") == F.col("k3"))
    columns, text, chars = list(plain.columns), name["text"], name.get("n_chars")

    def run(batches):
        from rollcall.llm.common import slices

        for batch in slices(batches, text, SLICE_BYTES):
            names = batch.schema.names
            at, texts = [], []
            for i, (body, size, pieces) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in (text, "size", "pieces")))):
                for turn in sorted({p["turn"] for p in pieces}):
                    at.append(i)
                    texts.append(taken_text(body, size, [p for p in pieces if p["turn"] == turn]))
            kept = batch.select(columns).take(pa.array(at, pa.int64()))
            new = {text: pa.array(texts, pa.string())}
            if chars is not None:
                new[chars] = pa.array([len(t) for t in texts]).cast(kept.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([new.get(c, kept.column(j)) for j, c in enumerate(columns)], names=columns)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema])
    return rows.join(pieces.hint("merge"), same).select(*columns, "size", "pieces").mapInArrow(tidy(run), schema).toDF(*docs.columns)
