import duckdb
import pytest
from helpers import no_docs, odd_docs

from rollcall.llm import chat, licenses
from rollcall.llm.common import table

T = "conv_id long, turn long, role string, text string, extra int"


def con(**frames):
    c = duckdb.connect()
    for name, df in frames.items():
        c.register(name, df.toPandas().astype(object).where(lambda x: x.notna(), None) if False else df.toArrow())
    return c


def same(df, c, sql):
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, ((tuple(r[n] for n in names)) for r in df.collect()))) == sorted(map(str, want.fetchall()))


def odd_turns(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "yo", 1), (2, 0, "user", "hi", 1), (3, 0, "user", "hi", 1), (3, 1, "assistant", "yo", 1), (3, 2, "user", "more <|im_end|>", 1)]
    rows += [(4, 5, "user", "hi", 1), (4, 9, "assistant", "yo", 1)]  # other turn numbers, the same turns
    rows += [(5, None, None, None, None), (6, 0, "user", "", None), (7, 0, "user", "tie", 1), (7, 0, "assistant", "tie", 1), (7, 0, "assistant", "tie", 1), (None, 0, "user", "lost", 1), (None, 1, "user", "found", 1)]
    rows += [(8, i, "user", "x" * 50_000, 1) for i in range(3)] + [(9, 0, "user", "hi yo", 1), (10, 0, "user", "hi yo", 1)]
    return spark.createDataFrame(rows, T)


def test_chat_collapses_snapshots(spark):
    got = {r.conv_id: r for r in chat.rendered(odd_turns(spark)).collect()}
    assert set(got) == {3, 5, 6, 7, None, 8, 9}
    assert got[9].copies == 2 and got[3].n_turns == 3 and got[3].rendered.endswith("user\nmore < |im_end|><|im_end|>\n")
    assert chat.rendered(spark.createDataFrame([], T)).count() == 0


@pytest.mark.parametrize("make", [odd_turns, lambda s: table(s, "/root/testdata/sf0.001", "conversations")])
def test_chat_as_sql_says(spark, make):
    df = make(spark)
    same(chat.rendered(df), con(conversations=df), chat.RENDERED_SQL)


@pytest.mark.parametrize("make", [odd_docs, no_docs, lambda s: table(s, "/root/testdata/sf0.001", "documents")])
def test_licences_as_sql_says(spark, make):
    df = make(spark)
    same(licenses.licence_matches(df), con(documents=df), licenses.matches_sql())


def test_licences_in_lines_and_paragraphs(spark):
    mit = licenses.TEMPLATES[2][1]
    broken = mit.replace(" to deal", "\nto deal").replace("without limitation", "without\nlimitation")
    rows = [(1, f"Intro\n\n{broken}\n\nEnd", "RELEASED  under the mit license!"), (2, "released under the license", None)]
    docs = spark.createDataFrame([(i, t + "\n\n" + (u or "")) for i, t, u in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.license) for r in licenses.licence_matches(docs).collect())
    assert got == [(1, "line", "MIT"), (1, "paragraph", "MIT")]


def test_size_bounds_lose_nothing():
    for n in range(1, 120):
        low, high = licenses.size_bounds(n, 0.8)
        ok = [m for m in range(1, 400) if 2 * min(m, n) / (m + n) >= 0.8]
        assert ok[0] >= low and ok[-1] <= high


def test_whole_notices_and_their_versions(spark):
    text = {name: t for name, t in licenses.TEMPLATES[len(licenses.NOTICES) + len(licenses.NAMED) :]}
    lines = lambda t, mark: "\n".join(mark + " ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    marked = lambda name: lines(text[name], " * ")
    rows = [(i, f"code\n *\n{marked(name)}\n */\nmore code") for i, name in enumerate(text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.licence_matches(docs).where("unit = 'paragraph'").collect()}
    assert got == dict(enumerate(text))


def test_sentences_identifiers_and_openings(spark):
    texts = ["Some words first. Released under the MIT License. More of them follow here", "// SPDX-License-Identifier: BSD-3-Clause", "# spdx-license-identifier: CC-BY-SA-4.0", " " * 30 + "Apache License\n" + " " * 20 + "Version 2.0, January 2004\n" + " " * 18 + "http://www.apache.org/licenses/\n\nTERMS", "Nothing here is licensed. Permission was not asked! The software is old"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.number, r.license) for r in licenses.licence_matches(docs).collect())
    assert got == [(0, "sentence", 2, "MIT"), (1, "line", 1, "BSD-3-Clause"), (2, "line", 1, "CC-BY-SA-4.0"), (3, "paragraph", 1, "Apache-2.0")]


def test_every_identifier_matches_itself_alone(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.NAMED)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.licence_matches(docs).collect()}
    assert got == {i: name for i, (name, _) in enumerate(licenses.NAMED)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_tell_tale_words_lose_nothing(threshold):
    """Of each template fewer bigrams are without such a word than any match shares."""
    words = set(licenses.tell_tale_words(licenses.TEMPLATES, threshold))
    assert words and (threshold != 0.8 or len(words) < 60)
    for _, text in licenses.TEMPLATES:
        pairs = licenses.word_bigrams(text)
        without = [p for p in pairs if words.isdisjoint(p.split())]
        for size in range(1, 3 * len(pairs)):  # a unit whose shared bigrams are all without one
            assert 2 * min(len(without), size) < threshold * (size + len(pairs))
