import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import no_docs, odd_docs

from rollcall.llm import spelling
from rollcall.llm.common import table
from rollcall.llm.spelling import spelling_forms

LETTERS = "abcdefghijklmnopqrstuvwxyzéß"


def brute(rows, every=199, shortest=6, least=5, times=5):
    """Every word beside all that its one-letter edits can be: (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    holes = defaultdict(set)  # words by what is left without one letter
    for w in n:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
    without = defaultdict(set)
    for (_, hole), ws in holes.items():
        without[hole] |= ws
    out = {}
    for w in n:
        near = {x for i in range(len(w)) for x in holes[i, w[:i] + w[i + 1 :]]} | without.get(w, set()) | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in n}
        near.discard(w)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        good = best is not None and n[best] >= times * n[w]
        out[w] = (best if good else None, n[w], len(near), n[best] if good else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted((w, form, root(w), c, near, form_n) for w, (form, c, near, form_n) in out.items())


def check(df, **options):
    got = sorted(tuple(r) for r in spelling_forms(df, **options).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], **options)
    return got


def test_whole_table(spark):
    got = check(table(spark, "/root/testdata/sf0.01", "documents"))
    assert len(got) > 1000 and any(r[1] for r in got)


def test_odd_texts(spark):
    assert check(odd_docs(spark).repartition(3))
    assert check(no_docs(spark)) == []
    check(odd_docs(spark), every=3, shortest=4, least=1, times=1 + 1)
    with pytest.raises(ValueError):
        spelling_forms(no_docs(spark), shortest=1)


@pytest.mark.parametrize("shard,wide,held", [(20_000, 48, 200_000), (7, 2, 5), (7, 10_000, 200_000), (50, 0, 200_000)])
def test_made_up_words(spark, monkeypatch, shard, wide, held):
    """Chains of variants, many words of one half, and of one half but a letter."""
    rng = random.Random(3)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(6, 12))) for _ in range(40)] + ["internation", "aaaaaaaaaa", "aaaaaaaaa", "ababababab"]
    text = Counter()
    for w in words:
        n = 400
        while n:
            text[w] += n
            i = rng.randrange(len(w))
            w, n = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + rng.choice(LETTERS) + w[i + 1 :]]), n // 5
    for tail in ("".join(rng.choices("abc", k=5)) for _ in range(150)):
        text["prefix" + tail] += rng.choice([1, 5, 30])
        text[tail + "suffixe"] += rng.choice([1, 5, 30])
    runs = list(text.elements())
    rng.shuffle(runs)
    rows = [(i, " ".join(runs[i::60]), "en") for i in range(60)]
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling, "WIDE_ROWS", wide)
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    got = check(spark.createDataFrame(rows, "doc_id long, text string, word string"), least=1, times=2)
    assert max(r[4] for r in got) > 5 and any(r[2] not in (r[0], r[1]) for r in got)  # chains of two steps


def test_one_edit():
    words = ["".join(w) for n in range(5) for w in __import__("itertools").product("ab", repeat=n)]
    far = lambda a, b: len(a) + len(b) if not a or not b else min(far(a[1:], b) + 1, far(a, b[1:]) + 1, far(a[1:], b[1:]) + (a[0] != b[0]))
    far_ = lambda a, b: far(a, b) if a and b else abs(len(a) - len(b))
    for a in words:
        for b in words:
            if len(a) - len(b) in (0, 1):
                assert spelling.one_edit(a, b) == (far_(a, b) == 1), (a, b)
