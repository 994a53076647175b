"""Words that differ by one letter, found through automata of their halves.

Of two words at a distance of one edit, one half of the shorter (of equal ones, of either) is whole in the
other: its first half at the beginning, or its second half at the end.  Each word so
leaves two segments with the shards that their hashes name, and is scanned by the shards where
a word of its length, or one less, would have left the same stretch.  A shard is an Aho-Corasick automaton of its
segments; a hit counts if the segment stands where it must and the lengths fit, and what is left
is then compared.  A pair whose two halves both match is counted by the first.

Words of one segment that are many (``WIDE_ROWS``) aren't compared one by one but looked
up by what is left without one letter.  Large shards are cut into chunks of words that leave segments;
scanned words pass by.  Tasks return a count and the best word for each word that they saw, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, modest_batches, tidy

RUN_RE = re.compile("[A-Za-zÀ-ÿ]+")
SLICE_BYTES = 1 << 22
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words that leave a segment with one automaton, about.
SHARD_WORDS = 20_000
#: Words of one segment from which on they are looked up instead of compared.
WIDE_ROWS = 48
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


# ---- words and their numbers --------------------------------------------------------------


def words_of(doc_id: str, text: str, every: int, shortest: int) -> Counter:
    """How often each word of at least ``shortest`` letters occurs.

    Words are runs of letters, A-Z in lower case; where ``every`` divides the crc32 of id and run, the run loses a letter.
    """
    runs: Counter = Counter()
    for run, n in Counter(RUN_RE.findall(text)).items():
        if len(run) >= shortest:
            runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    found: Counter = Counter()
    head = zlib.crc32(f"{doc_id}:".encode())
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), head)
        if every and h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= shortest:
            found[word] += n
    return found


def counted_words(docs: DataFrame, every: int, shortest: int, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the words that occur at least ``least`` times in all texts."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("__text")).where("__text is not null")

    def count(batches):
        from rollcall.llm import spelling as own
        from rollcall.llm.common import slices

        held: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for part in slices(batches, "__text", own.SLICE_BYTES):
            for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.update(own.words_of(key, body, every, shortest))
                if len(held) >= own.HELD_WORDS:
                    yield told()
                    held.clear()
        yield told()

    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- halves --------------------------------------------------------------------------------


def segment(word: str, side: int, length: int) -> str:
    """The stretch of ``word`` that a word of ``length`` letters leaves as its first (side 0) or second half."""
    return word[: length // 2] if side == 0 else word[len(word) - (length - length // 2) :]


def rest(word: str, side: int, length: int) -> str:
    """What :func:`segment` leaves out."""
    return word[length // 2 :] if side == 0 else word[: len(word) - (length - length // 2)]


def one_edit(a: str, b: str) -> bool:
    """Whether ``a``, as long as ``b`` or longer by one, differs from it by exactly one letter."""
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    return i < len(a) and a[i + 1 :] == b[i + (len(a) == n) :]


class Left:
    """The words that left one segment, from one side and of one length: what of them is one edit away from a scanned word."""

    def __init__(self) -> None:
        self.members: list[int] = []
        self.replaced: dict[tuple[int, str], list[int]] | None = None
        self.whole: dict[str, int] = {}

    def look_up(self, words: list[str], side: int, length: int) -> None:
        self.replaced = {}
        for m in self.members:
            left = rest(words[m], side, length)
            self.whole[left] = m
            for i in range(len(left)):
                self.replaced.setdefault((i, left[:i] + left[i + 1 :]), []).append(m)

    def near(self, x: str, words: list[str], side: int, length: int) -> list[int]:
        own = rest(x, side, length)
        if len(self.members) < WIDE_ROWS:
            return [m for m in self.members if one_edit(own, rest(words[m], side, length))]
        if self.replaced is None:
            self.look_up(words, side, length)
        if len(x) > length:
            return [self.whole[s] for s in {own[:i] + own[i + 1 :] for i in range(len(own))} if s in self.whole]
        return [m for i in range(len(own)) for m in self.replaced.get((i, own[:i] + own[i + 1 :]), ()) if words[m] != x]


class Shard:
    """An automaton of the segments that words left, and what scans have found about these words."""

    def __init__(self, words: list[str], sides: list[int], counts: list[int]) -> None:
        self.words, self.counts = words, counts
        self.found: dict[int, list] = {}
        self.hits: ahocorasick.Automaton = ahocorasick.Automaton()
        left: dict[str, dict[tuple[int, int], Left]] = {}
        for m, (word, side) in enumerate(zip(words, sides)):
            left.setdefault(segment(word, side, len(word)), {}).setdefault((side, len(word)), Left()).members.append(m)
        for key, by in left.items():
            self.hits.add_word(key, (len(key), by))
        if left:
            self.hits.make_automaton()

    def scan(self, x: str, n: int, side: int, length: int) -> tuple[int, int, str] | None:
        """How many words of ``length`` that left a segment at ``side`` are one edit from ``x``, and the best: (count, -n, word)."""
        size = length // 2 if side == 0 else length - length // 2
        end = size - 1 if side == 0 else len(x) - 1
        count, best = 0, (0, "")
        for at, (width, by) in self.hits.iter(x) if len(self.hits) else ():
            if at == end and width == size and (side, length) in by:
                for m in by[side, length].near(x, self.words, side, length):
                    w = self.words[m]
                    if side and x[: length // 2] == w[: length // 2]:
                        continue  # the first halves have met
                    count, best = count + 1, min(best, (-self.counts[m], w))
                    if len(x) > length:  # a longer word doesn't meet it from the other end
                        own = self.found.setdefault(m, [0, (0, "")])
                        own[0], own[1] = own[0] + 1, min(own[1], (-n, x))
        return (count, *best) if count else None


NEAR = "word string, n_near long, minus_n long, form string"


def scanned(batches):
    """NEAR rows of each shard and chunk; rows are (shard, chunk, scan, side, length, word, n), the words that left segments first."""
    from rollcall.llm.spelling import Shard

    def batch(rows):
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "minus_n", "form"])

    key, held, shard, out = None, ([], [], []), None, []
    for part in batches:
        if not part.num_rows:
            continue
        columns = [c.to_pylist() for c in part.columns]
        for at, chunk, scan, side, length, word, n in zip(*columns):
            if (at, chunk) != key:
                out += [(shard.words[m], f[0], *f[1]) for m, f in shard.found.items()] if shard else []
                key, held, shard = (at, chunk), ([], [], []), None
            if not scan:
                for column, value in zip(held, (word, side, n)):
                    column.append(value)
                continue
            shard = shard or Shard(*held)
            if (got := shard.scan(word, n, side, length)) is not None:
                out.append((word, *got))
        yield batch(out)
        out = []
    yield batch([(shard.words[m], f[0], *f[1]) for m, f in shard.found.items()] if shard else [])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, minus_n, form of the words that have a near one: how many, and the commonest (of equal ones the first in code points)."""
    shards = max(1, -(-2 * words.count() // SHARD_WORDS))
    size = F.length("word")
    piece = lambda side, length: F.when(F.lit(side == 0), F.expr(f"substring(word, 1, int({length} / 2))")).otherwise(F.expr(f"right(word, {length} - int({length} / 2))"))
    row = lambda scan, side, length: F.struct(F.pmod(F.xxhash64(F.lit(side), F.expr(length), piece(side, length)), F.lit(shards)).alias("shard"), F.lit(scan).alias("scan"), F.lit(side).alias("side"), F.expr(length).alias("length"))
    left = [row(False, side, "length(word)") for side in (0, 1)]
    seen = [row(True, side, f"(length(word) - {less})") for side in (0, 1) for less in (0, 1)]
    visits = words.select("word", "n", size.alias("size"), F.inline(F.array(*left, *seen)))
    crowded = cut(words.select(F.inline(F.array(*left)), F.lit(1).alias("one")).groupBy("shard").agg(F.ceil(F.count("one") / (2 * SHARD_WORDS)).cast("int").alias("chunks")).where("chunks > 1"))
    if crowded.limit(1).count():
        visits = visits.join(crowded, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("word", F.lit(7)), F.col("chunks")).cast("int")
        visits = visits.withColumn("chunk", F.explode(F.when(F.col("scan"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))))
    else:
        visits = visits.withColumn("chunk", F.lit(0))
    dealt = visits.select("shard", "chunk", "scan", "side", "length", "word", "n").repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "scan")
    found = dealt.mapInArrow(tidy(scanned), NEAR)
    best = F.min(F.struct("minus_n", "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.*")


def spelling_forms(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, times: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: each word that occurs ``least`` times, and the commoner spelling that it varies.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``shortest``
    code points after A-Z have become lower case and, where ``every`` divides the crc32 of
    ``<doc_id>:<run>`` (a null id is empty), a letter went.  Near words differ by one inserted,
    deleted or replaced code point; a word's form is its near word of the largest n
    (ties: the first in code points) if that is at least ``times`` the word's n, and root follows the forms to the
    last.  ``shortest`` is 2 at least (a word of one letter has no halves).  Null and empty texts have no words; rows that repeat an id count each; an empty table gives no rows.
    """
    if shortest < 2:
        raise ValueError("words of one letter have no halves")
    words = cut(counted_words(docs, every, shortest, least, doc_id, text))
    near = cut(near_words(words))
    known = words.join(near, "word", "left")
    common = -F.col("minus_n") >= times * F.col("n")
    out = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("form")).alias("form"), F.when(common, -F.col("minus_n")).alias("form_n")))
    # A form is ``times`` as common as its word, so chains end; each round doubles what a step takes.
    roots = cut(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        beyond = roots.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        step = cut(roots.join(beyond, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
