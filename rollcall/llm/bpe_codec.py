"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding.

The encoding of a string ends in one *last token*; taken away, what is left is
the encoding of the shorter prefix.  So each trie node (a prefix) needs one
state: its last token.  It is the token that ends the prefix and stands beside
the last token of the rest without a merge reaching across.  The distinct words
of a slice, sorted, are the trie's depth-first order: a word starts from the
states of the prefix that it shares with the word before it, and shared
prefixes are computed once.  A word of any length takes steps in proportion to
its length.

The walk holds for byte-pair models without dropout, byte fallback or prefixes of
continuing parts, whose special strings are taken as they stand; any other file is
left to the library.  Words are found here where the file's normaliser and pattern
are the ones below and the text is plain; other lines are divided by the library.
Words' results are remembered by each task up to a bound in bytes; nothing is
shuffled, and a text is never held to a prefix of it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import modest_batches, tidy, with_results

SLICE_BYTES = 1 << 20
#: What a task remembers of words, in bytes about, and of nodes' states; then it starts afresh.
MEMO_BYTES = 64 << 20
MEMO_STATES = 100_000
#: Longer words are not remembered beyond their slice.
MEMO_CHARS = 64

#: Texts of these characters alone lower-case, normalise and divide alike in
#: Python and in the library: ASCII but its separators, and Latin letters that are composed.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ſ‐-―‘-‟…]*")
#: Digits in two-byte ranges are matched by their own list, as ``\d`` leaves out ``²`` and ``½``.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\xb2\xb3\xb9\xbc\xbd\xbe]+|[\\d\xb2\xb3\xb9\xbc\xbd\xbe]|(?:[^\\s\\w]|_)+")

# The normaliser and the division into words that PLAIN and WORDS stand for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_state: dict = {}


def codec(tokenizer_json: str) -> "Codec":
    key = hash(tokenizer_json)
    if _state.get("key") != key:
        _state.update(key=key, codec=Codec(tokenizer_json))
    return _state["codec"]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def walkable(spec: dict) -> bool:
    """Whether the trie walk, and tokens joined by spaces, give what the library gives for this file."""
    model = spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    specials = all(t["content"] and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    return plain and specials and spec.get("decoder") is None


def divisible(spec: dict) -> bool:
    """Whether PLAIN texts divide by WORDS as by this file's normaliser and pre-tokenizer."""
    normal, before = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if normal.get("normalizers") != NORMALIZERS or len(before) != 2:
        return False
    split, level = before
    same = split.get("type") == "Split" and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
    return same and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")


class Codec:
    """Encodes and decodes whole texts for one tokenizer file."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        self.json, self.own_library = tokenizer_json, None
        self.walks, self.divides = walkable(spec), divisible(spec)
        if not self.walks:
            return
        self.end: str = spec["model"].get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        same = {t: t for t in self.ids}  # each token's text is held once
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(same.get(a, a), same.get(b, b)): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.shown = {t: (f" {i}", f" {t}") for t, i in self.ids.items()}
        #: Tokens that end before a word does; those that end with it, by the letters they take; what a token may begin with.
        self.inner = {t for t in self.ids if t and not (self.end and t.endswith(self.end))}
        self.ending = {t[: -len(self.end)]: t for t in self.ids if t.endswith(self.end)} if self.end else {}
        self.beginnings = {t[:i] for t in (*self.inner, *self.ending) for i in range(len(t) + (t in self.ending))} | {""}
        self.to_letters = {chr(b): x for b, x in enumerate(byte_letters())}
        self.forget()

    @property
    def library(self):
        """The library's tokenizer, made where it is needed."""
        if self.own_library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.own_library = Tokenizer.from_str(self.json)
            self.own_library.no_truncation()
            self.own_library.no_padding()
        return self.own_library

    def forget(self) -> None:
        """Drop what was remembered, so that an idle worker is small."""
        if not self.walks:
            return
        #: Of each token of the vocabulary met, at most: the last merge that makes it.
        self.formed: dict[str, tuple[int, str, str] | None] = {}
        self.start_states()
        self.start_memo({})

    def start_memo(self, words: dict[str, tuple[str, str]]) -> None:
        """Remember these words (ids and tokens of each, every one after a space) and the special strings."""
        words = words | {t: (f" {i}", f" {t}") for t, i in self.special.items()}
        self.ids_of, self.tokens_of = {w: a for w, (a, _) in words.items()}, {w: b for w, (_, b) in words.items()}
        self.memo_bytes = sum(400 + len(w) + len(a) + len(b) for w, (a, b) in words.items())

    # ---- words -------------------------------------------------------------

    def words(self, segment: str) -> list[str]:
        """The pre-tokens of a stretch without special strings; those from the library, in the vocabulary's letters, begin with NUL."""
        if self.divides and PLAIN.fullmatch(segment):
            return WORDS.findall(segment.lower())
        if self.divides and "\n" in segment:  # a line end divides words and is in none
            return [w for line in segment.split("\n") if line for w in self.words(line)]
        normal = self.library.normalizer.normalize_str(segment) if self.library.normalizer else segment
        parts = self.library.pre_tokenizer.pre_tokenize_str(normal) if self.library.pre_tokenizer else [(normal, None)]
        return ["\0" + w for w, _ in parts]

    def spelt(self, word: str) -> str:
        if word[0] == "\0":
            return word[1:]
        return word if word.isascii() else "".join(map(self.to_letters.__getitem__, word.encode().decode("latin-1")))

    # ---- merging -----------------------------------------------------------

    def merged_once(self, symbols: list[str]) -> list[str] | None:
        """The symbols after the merge of lowest rank, wherever it occurs; None if there is none."""
        best = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, 1 << 60))
        if best not in self.rank:
            return None
        out, i = [], 0
        while i < len(symbols):
            both = i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best
            out.append(best[0] + best[1] if both else symbols[i])
            i += 1 + both
        return out

    def symbols(self, token: str) -> list[str]:
        """The single symbols a token is merged from; the word end belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def formation(self, token: str) -> tuple[int, str, str] | None:
        """Rank and halves of the merge that makes ``token`` out of its own symbols; None if none does."""
        if token not in self.formed:
            symbols, made = self.symbols(token), (-1, token, token)
            while len(symbols) > 1:
                halves = symbols
                symbols = self.merged_once(symbols)
                if symbols is None:
                    made = None
                    break
                made = (self.rank.get((halves[0], halves[1]), -1), halves[0], halves[1])
            self.formed[token] = made
        return self.formed[token]

    def beside(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are side by side; without a left one, whether the right one forms at all.

        The merges are taken back, the latest first: at each step the tokens that
        touch must not have a merge that would have come before the one taken back.
        """
        b = self.formation(right)
        if b is None or not left:
            return b is not None
        a, before = self.formation(left), 1 << 60
        while True:
            if self.rank.get((left, right), 1 << 60) < before:
                return False
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:  # of equal merges the left one comes first
                before, left = a[0], a[2]
                a = self.formation(left)
            else:
                before, right = b[0] + 1, b[1]
                b = self.formation(right)

    # ---- the trie ------------------------------------------------------------

    def start_states(self) -> None:
        """Forget all states but that of the root.

        A node's state is the last tokens at its end and at the places before it where a
        token that is still growing may have begun.  Nodes with equal states share a number.
        """
        self.number: dict[tuple[str, tuple[str, ...]], int] = {("", ("",)): 0}
        self.growing, self.lasts = [""], [("",)]
        self.steps: dict[str, list[int]] = {}
        self.closings: dict[tuple[int, str], str] = {}

    def step(self, state: int, letter: str) -> int:
        """The state after one more letter; -1 if no token ends there."""
        text, lasts = self.growing[state] + letter, self.lasts[state]
        for at in range(len(text)):
            token = text[at:]
            if token in self.inner and self.beside(lasts[at], token):
                break
        else:
            return -1
        begin = 0
        while text[begin:] not in self.beginnings:
            begin += 1
        new = (text[begin:], (*lasts[begin:], token))
        number = self.number.setdefault(new, len(self.growing))
        if number == len(self.growing):
            self.growing.append(new[0])
            self.lasts.append(new[1])
        return number

    def closing_token(self, state: int, letter: str) -> str:
        """The last token of a whole word, which holds the word end; empty if there is none."""
        text, lasts = self.growing[state] + letter, self.lasts[state]
        for at in range(len(text)):
            token = self.ending.get(text[at:])
            if token and self.beside(lasts[at], token):
                return token
        return ""

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, by the trie in depth-first order."""
        out: dict[str, list[str]] = {}
        branch, path = "", [0]  # path[d]: state of the first d letters of the branch
        end = self.end
        for word in sorted(words):
            if len(self.growing) > MEMO_STATES:
                self.start_states()
                branch, path = "", [0]
            steps, lasts, closings = self.steps, self.lasts, self.closings
            stop = len(word) - 1 if end else len(word)
            shared, most = 0, min(stop, len(branch), len(path) - 1)
            while shared < most and branch[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            state = path[shared]
            for letter in word[shared:stop]:
                known = steps.get(letter)
                if known is None:
                    known = steps[letter] = {}
                after = known.get(state)
                if after is None:
                    after = known[state] = self.step(state, letter)
                state = after
                if state < 0:
                    break
                path.append(state)
            branch = word[:stop]
            if state < 0:  # a letter that the vocabulary lacks
                out[word] = [t.value for t in self.library.model.tokenize(word)]
                continue
            if end:
                key = (state, word[-1])
                token = closings.get(key)
                if token is None:
                    token = closings[key] = self.closing_token(*key)
                if not token:
                    out[word] = [t.value for t in self.library.model.tokenize(word)]
                    continue
                tokens, at = [token], len(word) - (len(token) - len(end))
            else:
                tokens, at = [], len(word)
            while at:
                token = lasts[path[at]][-1]
                tokens.append(token)
                at -= len(token)
            tokens.reverse()
            out[word] = tokens
        return out

    # ---- texts -------------------------------------------------------------

    def learn(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """For each word: its ids and its tokens, each after a space."""
        spelling = {w: self.spelt(w) for w in words}
        encoded = self.encode_words(set(spelling.values()))
        shown = {}
        for letters, tokens in encoded.items():
            both = [self.shown[t] for t in tokens if t in self.shown]
            shown[letters] = ("".join([a for a, _ in both]), "".join([b for _, b in both]))
        return {word: shown[letters] for word, letters in spelling.items()}

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text: its ids, and its decoded tokens, as strings joined by one space."""
        if not self.walks:
            ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return [(" ".join(map(str, i)), self.decode(i)) for i in ids]
        split = []
        for text in texts:
            if any(s in text for s in self.special):
                split.append([w for s in self.cut.split(text) if s for w in ([s] if s in self.special else self.words(s))])
            else:
                split.append(self.words(text))
        met: set[str] = set().union(*split)
        learnt = self.learn(met.difference(self.ids_of))
        if self.memo_bytes + sum(400 + len(w) + len(a) + len(b) for w, (a, b) in learnt.items()) > MEMO_BYTES:
            self.start_memo({w: (self.ids_of[w], self.tokens_of[w]) for w in met.intersection(self.ids_of)})
        for w, (a, b) in learnt.items():
            self.ids_of[w], self.tokens_of[w] = a, b
            self.memo_bytes += 400 + len(w) + len(a) + len(b)
        ids, tokens = self.ids_of.__getitem__, self.tokens_of.__getitem__
        out = [("".join(map(ids, words))[1:], "".join(map(tokens, words))[1:]) for words in split]
        for w in learnt:
            if len(w) > MEMO_CHARS:
                self.memo_bytes -= 400 + len(w) + len(self.ids_of.pop(w)) + len(self.tokens_of.pop(w))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode; without a decoder, tokens joined by one space and unknown ids left out."""
        return self.library.decode(ids, skip_special_tokens=False)


def encode_decode(docs: DataFrame, tokenizer_json: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """``keep``, n_tokens and the SHA-256 of the ids and of the decoded text of each whole text.

    With ``full`` the ids (array of int) and the decoded text come too.  No
    special tokens are added; special strings in a text become their tokens.  A
    null text counts as empty: no tokens, and the digests of the empty string.
    Repeated rows are encoded each; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    modest_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    plain = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    more = {"ids": "array<int>", "decoded": "string"} if full else {}

    def run(batches):
        from rollcall.llm.bpe_codec import SLICE_BYTES, codec
        from rollcall.llm.common import slices

        own = codec(vocabulary.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in slices(batches, "__text", SLICE_BYTES):
            done = own.encode(part.column(part.num_columns - 1).to_pylist())
            columns = [pa.array([a.count(" ") + 1 if a else 0 for a, _ in done], pa.int64()), pa.array([sha(a) for a, _ in done]), pa.array([sha(b) for _, b in done])]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array([[int(i) for i in a.split()] for a, _ in done], pa.list_(pa.int32())), pa.array([b for _, b in done])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *names])
        own.forget()

    return plain.mapInArrow(tidy(run), with_results(plain, n_tokens="long", ids_sha256="string", decoded_sha256="string", **more))
