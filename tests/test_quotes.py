"""Records and line numbers as Python's csv and splitlines have them, wherever splits fall."""

import csv
import io
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.operators import screen
from rollcall.sources import lines as L
from rollcall.sources.specs import CONTACTS

HEAD = ",".join(CONTACTS.header)


def as_csv(text):
    """(last line, fields) of each record."""
    reader = csv.reader(text.splitlines(keepends=True))
    return [(reader.line_num, row or [""]) for row in reader]


def ours(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = L.stitched(L.numbered_lines(spark, str(folder))).withColumn("cells", L.cells(F.col("line"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    out = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        out.setdefault(r.file.rpartition("/")[2], []).append((r.line_no, r.cells, r.unclosed))
    return out


PLANTED = {
    "inches.csv": '5" Road,a\nb,6" x 7" yard\nc,d\n"e ""f""","g"\n"h"tail"x",i\n',
    "ends.csv": 'a"",b""\n"""",""\n"x""",y\n,\n"",""\n',
    "over.csv": 'a,"one\ntwo ""2""\n\nthree",b\nx","y\n"p","q\nr","s\nt"\nlast',
    "open.csv": 'a,b\nc,"never\nclosed, here\n',
    "crlf.csv": 'a,"b\r\nc"\r\nd,e\r\n\r\n"f\rg",h\r',
    "ends_of_lines.csv": "a\x0bb,c\n\x0c\nd\x85e f g,\x1ch\x1d,i\x1ej\n\"k\x0bl\",m\nn\x0b",
    "ends_and_feed.csv": "a\x0b\nb\x0c\n",
    "mark.csv": '﻿"a",b\x0b',
    "empty_lines.csv": "\n\n,\n\n",
}


@pytest.mark.parametrize("split", [7, 33, 1 << 20])
def test_planted_records(spark, tmp_path, split):
    for name, text in PLANTED.items():
        (tmp_path / name).write_bytes(text.encode())
    got = ours(spark, tmp_path, split)
    for name, text in PLANTED.items():
        assert [(n, c) for n, c, _ in got[name]] == as_csv(text.removeprefix("﻿")), name
    assert not any(u for rows in got.values() for _, _, u in rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text('ab,"\n\r ', max_size=60) | st.text('a,"\n\x0b\x85', max_size=60), min_size=1, max_size=20), st.sampled_from([5, 16, 50]))
def test_random_records(spark, tmp_path_factory, texts, split):
    folder = tmp_path_factory.mktemp("random")
    for i, text in enumerate(texts):
        (folder / f"t{i}.csv").write_bytes(text.encode())
    got = ours(spark, folder, split)
    for i, text in enumerate(texts):
        assert [(n, c) for n, c, _ in got.get(f"t{i}.csv", [])] == as_csv(text), (text, split)


def test_random_text_in_one_pass(spark):
    """Maps and fields of single lines, many at a time."""
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices('ab,"" ', k=rng.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").select("line", L.cells(F.col("line")).alias("cells"), L.line_map(F.col("line")).alias("f"), L.width(F.col("line")).alias("width")).collect()
    for r in rows:
        assert (r.cells, r.width) == ((row := next(csv.reader([r.line]), []) or [""]), len(row))
        closed = lambda text: len(list(csv.reader([text + "\n", "x\n"]))) - 1
        assert r.f.a == 1 - closed(r.line) and r.f.b == 1 - closed('"' + r.line)


@pytest.mark.parametrize("split", [1 << 16, 1 << 19])
def test_a_quote_that_never_closes(spark, tmp_path, split):
    """What follows a stray quote is staged, and one issue tells of it; of a field of the limit nothing is lost."""
    good = [f"P{i},9{i:09d},Pune,y,{i}" for i in range(200_000)]
    stray = ['"Stray,9000000001,Pune,y,1', 'Q,9000000002,"No end,y', "R,9000000003,6\" Road,y,2"]
    (tmp_path / "a.csv").write_text("\n".join([HEAD, *good[:5], *stray[:1], *good[5:], stray[2], *stray[1:2], *good[:30_000], stray[1], "tail"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        lines = L.stitched(L.numbered_lines(spark, str(tmp_path)))
        got = screen.screened(lines, CONTACTS)
        count = {r.verdict: r["count"] for r in got.groupBy("verdict").count().collect()}
        issues = screen.issues(got, CONTACTS).where("issue_type = 'unclosed_quote'").orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert count == {"staged": 230_001, "unclosed_quote": 2, "wrong_column_count": 1}
    assert [(r.row_number, r.raw_value) for r in issues] == [(7, stray[0]), (200_004, stray[1])]


def test_limits(spark, tmp_path):
    ok = '"' + ("x" * 999 + "\n") * 100 + '",b\nc,d\n'
    (tmp_path / "ok.csv").write_text(ok)
    endless = 'a,"b\n' + 'c","d\n' * 400_000 + "e\nf,g\n"
    (tmp_path / "wide.csv").write_text(endless)
    got = ours(spark, tmp_path, 1 << 17)
    assert [(n, c) for n, c, _ in got["ok.csv"]] == as_csv(ok)
    wide = got["wide.csv"]
    assert len(wide) == 400_003 and all(u for _, _, u in wide)


def test_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert ours(spark, tmp_path, 10) == {}
    assert io.StringIO("") and L.stitched(L.numbered_lines(spark, str(tmp_path))).columns == ["file", "line_no", "line", "unclosed"]


def test_patterns_tell_what_pieces_tell(spark):
    """Every line of up to seven letters of a quote, a comma and a letter, and the ends of lines that may be in one."""
    texts = ["".join(t) for n in range(8) for t in itertools.product('",x', repeat=n)] + ['"\x0b",\u2028"', "x\x85\"", '"\r"', '\n"', '",\n', "x" * 1999 + '"', '"' + "x," * 1500]
    lines = spark.createDataFrame([(t,) for t in texts], "line string")
    got = lines.select("line", L.line_map(F.col("line")).alias("by_pattern"), L._line_map_by_pieces(F.col("line")).alias("by_pieces")).collect()
    assert len(got) == len(texts) and [r.line for r in got if r.by_pattern != r.by_pieces] == []


def test_lines_with_quotes_are_told_without_pieces(spark):
    plan = spark.range(1).select(F.concat(F.lit('"a","'), F.col("id").cast("string"), F.lit('"')).alias("line")).select(F.length("line").alias("n"), L.line_map(F.col("line")).alias("m"))
    assert plan.first().m.asDict() == {"a": 0, "b": 0, "still": False} and "RLIKE" in plan._jdf.queryExecution().optimizedPlan().toString().upper()
