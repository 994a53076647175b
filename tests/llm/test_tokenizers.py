import hashlib
import json
import random

import pytest
from helpers import no_docs, odd_docs

tokenizers = pytest.importorskip("tokenizers")

from rollcall.llm import bpe_codec, token_counts  # noqa: E402
from rollcall.llm.queries import tokenizer_file  # noqa: E402

ODD = ["", " ", "  lead", "a  b   c\n\nd ", "x <|endoftext|> y<|endoftext|>z  <|startoftext|>Q", "Σας ΣΑΣ İ ǅ don't it'S ½ ² ١٢ 你好", "é́ é  x \x1c z\x85w \t tab", "ab" * 3000, "_a_b__ 1_000 ªº ŉ ſ µ Ÿ ĳ", "😀😃 a😀b", "ﬁ Ⅷ ㍿ ​zero", "'S 'LL x'd we're", "\n\n", "a \n b", "tab\tb  ", "12345 67", "aaaa aaaaa aaaaaaa"]


def random_texts(n):
    rng = random.Random(3)
    alphabet = "abcdeéßñ ABC  '.,!<|>\n\t0159_你Σ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


def test_counts_equal_the_library():
    spec = tokenizer_file("byte_bpe_50k.json")
    own, lib = token_counts.PieceCounter(spec), tokenizers.Tokenizer.from_str(spec)
    texts = ODD + random_texts(600)
    assert own.count(texts) == [len(lib.encode(t, add_special_tokens=False)) for t in texts]
    assert own.count(texts) == own.count(texts)  # from the memo


def test_codec_equals_the_library():
    spec = tokenizer_file("word_bpe_49k.json")
    own, lib = bpe_codec.Codec(spec), tokenizers.Tokenizer.from_str(spec)
    for t, (ids, decoded) in zip(texts := ODD + random_texts(600), own.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), t
        assert decoded == lib.decode(want, skip_special_tokens=False) == own.decode(want)


def merged(own, word):
    """Byte-pair merging of one word, step by step."""
    symbols = [*word[:-1], word[-1] + own.end]
    while len(symbols) > 1 and (after := own.merged_once(symbols)):
        symbols = after
    return symbols


def test_trie_equals_plain_merging():
    own = bpe_codec.Codec(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(1)
    words = {"".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 15))) for _ in range(3000)}
    assert own.encode_words(words) == {w: merged(own, w) for w in words}


def test_long_words_equal_the_library():
    spec, rng = tokenizer_file("word_bpe_49k.json"), random.Random(2)
    own, lib = bpe_codec.Codec(spec), tokenizers.Tokenizer.from_str(spec)
    letters, ideographs = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0x4E00, 0x9F00)]
    for text in ("".join(rng.choices(letters, k=200_000)), "".join(rng.choices(ideographs, k=50_000)), "".join(rng.choices("ACGT", k=200_000)), "=+/" * 30_000):
        ((ids, decoded),) = own.encode([text])
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("change", ["normalizer", "pre_tokenizer", "decoder", "end", "letters", "model", "special"])
def test_other_files_equal_the_library(change):
    spec = json.loads(tokenizer_file("word_bpe_49k.json"))
    if change == "normalizer":
        spec["normalizer"] = None
    elif change == "pre_tokenizer":
        spec["pre_tokenizer"] = {"type": "WhitespaceSplit"}
    elif change == "decoder":
        spec["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}
    elif change == "end":
        spec = json.loads(tokenizer_file("byte_bpe_50k.json"))
    elif change == "letters":  # a vocabulary without some letter, and no special strings
        spec["added_tokens"] = []
        for token in [t for t in spec["model"]["vocab"] if "q" in t]:
            del spec["model"]["vocab"][token]
        spec["model"]["merges"] = [m for m in spec["model"]["merges"] if "q" not in "".join(m)]
    elif change == "model":
        spec["model"]["unk_token"] = "the</w>"
    else:
        spec["added_tokens"][1]["rstrip"] = True
    spec = json.dumps(spec)
    own, lib = bpe_codec.Codec(spec), tokenizers.Tokenizer.from_str(spec)
    lib.no_truncation()
    for t, (ids, decoded) in zip(texts := ODD[:-1] + random_texts(100) + ["quite a queue, ABC"], own.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), t
        assert decoded == lib.decode(want, skip_special_tokens=False), t


def test_memo_bounds_do_not_change_results(monkeypatch):
    texts = random_texts(200)
    counts, codes = token_counts.PieceCounter(tokenizer_file("byte_bpe_50k.json")), bpe_codec.Codec(tokenizer_file("word_bpe_49k.json"))
    want = counts.count(texts), codes.encode(texts)
    monkeypatch.setattr(token_counts, "MEMO_PIECES", 5)
    for name in ("MEMO_BYTES", "MEMO_STATES", "MEMO_CHARS"):
        monkeypatch.setattr(bpe_codec, name, 5)
    counts, codes = token_counts.PieceCounter(tokenizer_file("byte_bpe_50k.json")), bpe_codec.Codec(tokenizer_file("word_bpe_49k.json"))
    for part in (texts, texts[::-1]):
        assert sorted(counts.count(part)) == sorted(want[0]) and sorted(codes.encode(part)) == sorted(want[1])


def test_over_tables(spark):
    docs = odd_docs(spark)
    spec, spec3 = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
    lib, lib3 = tokenizers.Tokenizer.from_str(spec), tokenizers.Tokenizer.from_str(spec3)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, spec).collect()), key=key)
    n = {t: len(lib.encode(t, add_special_tokens=False)) for _, t in rows}
    assert got == sorted(((i, len(t.encode()), n[t], n[t] > 512) for i, t in rows), key=key)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {t: lib3.encode(t, add_special_tokens=False).ids for _, t in rows}
    got = sorted((tuple(r) for r in bpe_codec.encode_decode(docs, spec3).collect()), key=key)
    assert got == sorted(((i, len(ids[t]), sha(" ".join(map(str, ids[t]))), sha(lib3.decode(ids[t], skip_special_tokens=False))) for i, t in rows), key=key)
    full = bpe_codec.encode_decode(docs, spec3, full=True).where("doc_id = 6").collect()[0]
    assert full.ids == ids["one"] and full.decoded == "one</w>"
    assert token_counts.token_counts(no_docs(spark), spec).count() == 0 and bpe_codec.encode_decode(no_docs(spark), spec3).count() == 0
