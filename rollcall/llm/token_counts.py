"""Token counts of whole texts: lengths only, no ids leave the workers.

Texts arrive in Arrow batches, are cut into slices of about equal bytes and
broken at *safe boundaries*: places where a byte-level pre-tokenizer breaks the
text whatever stands around.  A piece that was met before in the same task has
its length from a bounded memo; the pieces that were not are encoded in batches
of about equal bytes.  There is no shuffle.

Safe boundary: before a single space with a non-space character on either side.
The pre-tokenizer's word patterns take at most one leading space and otherwise
no white space, so such a space always begins a new pre-token; special strings
that hold no space lie inside one piece.  A text without such a place is one
piece, encoded whole.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import modest_batches, tidy, with_results

#: Bytes of text taken from an Arrow batch at a time.
SLICE_BYTES = 1 << 22
#: Bytes of new pieces put together into one encoded string, and strings per call.
CHUNK_BYTES = 1 << 14
#: Pieces that a task remembers; then it starts afresh.
MEMO_PIECES = 400_000
#: Longer pieces are not remembered.
MEMO_CHARS = 64

SAFE = re.compile(r"(?<=\S)(?= \S)")
UNEVEN = re.compile(r"\s\s|^\s|\s\Z")
_state: dict = {}


def counter(tokenizer_json: str) -> "PieceCounter":
    """This worker's counter for the tokenizer, made once a process."""
    key = hash(tokenizer_json)
    if _state.get("key") != key:
        _state.update(key=key, counter=PieceCounter(tokenizer_json))
    return _state["counter"]


class PieceCounter:
    """Counts tokens of pieces with the tokenizers library and remembers the counts."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each text, encoded alone."""
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each piece; all begin with one space, so they can be encoded side by side."""
        found: dict[str, int] = {}
        chunks, chunk, size = [], [], 0
        for p in pieces:
            chunk.append(p)
            size += len(p)
            if size >= CHUNK_BYTES:
                chunks.append(chunk)
                chunk, size = [], 0
        if chunk:
            chunks.append(chunk)
        for at in range(0, len(chunks), 16):
            some = chunks[at : at + 16]
            encoded = self.tokenizer.encode_batch(["".join(c) for c in some], add_special_tokens=False)
            for c, e in zip(some, encoded):
                ends = np.fromiter(accumulate(map(len, c)), np.int64, len(c))
                starts = np.fromiter((s for s, _ in e.offsets), np.int64, len(e))
                found.update(zip(c, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(c)).tolist()))
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        firsts, rests = [], []
        for text in texts:
            if UNEVEN.search(text):
                parts = SAFE.split(text)
                rests.append(parts[1:])
            else:  # every space has non-space characters on both sides
                parts = text.split(" ")
                rests.append([" " + p for p in parts[1:]])
            firsts.append(parts[0])
        new = set().union(*rests).difference(self.memo)
        learnt = self.learn(list(new))
        if len(self.memo) + len(learnt) > MEMO_PIECES:
            seen = set().union(*rests).intersection(self.memo)
            learnt.update((p, self.memo[p]) for p in seen)
            self.memo = {}
        out = []
        get, more = self.memo.get, learnt.get
        for n, rest in zip(self.lengths(firsts), rests):
            out.append(n + sum(m if (m := get(p)) is not None else more(p) for p in rest))
        for p, n in learnt.items():
            if len(p) <= MEMO_CHARS and len(self.memo) < MEMO_PIECES:
                self.memo[p] = n
        return out


def token_counts(docs: DataFrame, tokenizer_json: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), over: int = 512) -> DataFrame:
    """``keep`` and, of each row's whole text, n_bytes, n_tokens and over_limit (n_tokens > ``over``).

    ``tokenizer_json`` is the tokenizer file's content (of fixed size, broadcast).
    No special tokens are added; special strings inside a text count as the
    library's default has it.  A null text counts as empty: 0 bytes, 0 tokens.
    Rows that repeat are counted each; an empty table gives no rows; other
    columns of the table, whatever their names, are not read.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    plain = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        from rollcall.llm.common import slices
        from rollcall.llm.token_counts import SLICE_BYTES, counter

        own = counter(vocabulary.value)
        for part in slices(batches, "__text", SLICE_BYTES):
            texts = part.column(part.num_columns - 1)
            n = pa.array(own.count(texts.to_pylist()), pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], size, n, pc.greater(n, over)],
                names=[*part.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"],
            )
        own.memo = {}  # an idle worker is to be small

    return plain.mapInArrow(tidy(run), with_results(plain, n_bytes="long", n_tokens="long", over_limit="boolean"))
