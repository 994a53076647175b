import csv
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from rollcall.jobs import catalog_more, registry
from rollcall.operators import screen
from rollcall.sources import lines as L
from rollcall.sources.specs import CONTACTS

HEAD = ",".join(CONTACTS.header)


def test_numbers_over_many_splits(spark, tmp_path):
    text = "﻿" + "\n".join([HEAD, *(f"P{i},9{i:09d},Pune,y,{i}" for i in range(3000))])
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = L.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in got] == list(range(1, 3002)) and got[0].line == HEAD and got[-1].line.startswith("P2999,")
    assert len({r.block for r in got}) > 5
    L.check_headers(spark.createDataFrame([("f", 1, HEAD)], "file string, line_no long, line string"), CONTACTS)
    with pytest.raises(ValueError):
        L.check_headers(spark.createDataFrame([("f", 1, "x,y")], "file string, line_no long, line string"), CONTACTS)
    with pytest.raises(ValueError):
        L.check_headers(spark.createDataFrame([], "file string, line_no long, line string"), CONTACTS)


def test_multi_line_records_as_csv_reads_them(spark, tmp_path):
    records = [["a", "1"], ['quoted "x", y', "2\nover\nlines"], ["", ""], ["b", "\n\n"], ["c", "3"]] * 60
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records)
    (tmp_path / "m.csv").write_text(out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = L.stitched(L.numbered_lines(spark, str(tmp_path))).withColumn("f", L.fields(F.col("line"), 2)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [list(r.f) for r in got] == records
    reader, ends = csv.reader(io.StringIO(out.getvalue())), []
    for _ in reader:
        ends.append(reader.line_num)
    assert [r.line_no for r in got] == ends


def test_verdicts(spark):
    rows = [HEAD, "A,9000000001,Pune,y,1", ",,,,", "", HEAD, "short,1", "A,1,2,3,4,5", "7,B,9000000001,Pune,y", "8,C,9000000005,Pune,y", "x,y,none,z,w", "E,9000000005,Pune,y,2"]
    lines = spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, line string")
    got = screen.screened(lines, CONTACTS)
    assert {r.line_no: r.verdict for r in got.collect()} == {2: "staged", 3: "blank_row", 4: "blank_row", 5: "repeated_header", 6: "wrong_column_count", 7: "wrong_column_count", 8: "column_shift", 9: "column_shift", 10: "column_shift", 11: "staged"}
    assert [(r.line_no, r.recovered, r.earlier_line) for r in screen.shift_duplicates(got, CONTACTS).collect()] == [(8, "9000000001", 2)]  # line 9's key comes later only
    assert {r.line_no: r.recovered for r in got.where("verdict = 'column_shift'").collect()} == {8: "9000000001", 9: "9000000005", 10: None}
    assert screen.staged(got, CONTACTS).count() == 2
    total = {r.source_file: (r["read"], r.loaded, r.skipped) for r in screen.load_summary(got, "contacts").collect()}
    assert total == {"contacts": (10, 2, 8), "TOTAL": (10, 2, 8)}


def test_lines_of_a_long_text_are_written_by_several_tasks(spark, monkeypatch):
    """No file, and so no task, holds more lines than its bound; numbers go on through more files than names in one digit tell apart."""
    written = []
    monkeypatch.setattr(catalog_more, "LONG_FILE", 40)
    monkeypatch.setattr(catalog_more, "written_lines", lambda s, rows, n, write=catalog_more.written_lines: written.append(write(s, rows, n)) or written[-1])
    removed = catalog_more.tables.removed
    monkeypatch.setattr(catalog_more.tables, "removed", lambda s, path: None)
    folder = "/root/testdata/sf0.001"
    got = registry.queries()["i16_line_ends"](spark, folder).collect()
    found = spark.read.option("lineSep", "\n").text(written[0]).selectExpr("input_file_name() AS f").groupBy("f").count().collect()
    removed(spark, written[0])
    assert len(found) > 11 and max(r["count"] for r in found) <= 40
    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert sorted((r.line_no, r.line) for r in got) == sorted(con.execute(registry.oracle_sql()["i16_line_ends"]).fetchall())


def test_few_files_do_not_make_few_tasks(spark, tmp_path):
    """Lines and records stay in the tasks that read them, though all are of one file."""
    (tmp_path / "one.txt").write_text("".join(f"line {i}\n" for i in range(4000)))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "0"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = L.numbered_lines(spark, str(tmp_path)).select("file", "line_no", "line")
        tasks = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        read, wide = tasks(lines), tasks(L.source_wide(lines, lines))
        assert "SortMergeJoin" not in L.source_wide(lines, lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(read) == sum(wide) == 4000 and len(read) == len(wide) > 4 and max(wide) < 1500
