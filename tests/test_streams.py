"""Rows that arrive in several runs: once for good, and the newest people."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollcall.operators import lookup, people_index
from rollcall.sources import tables, versions
from rollcall.streaming import stream

PEOPLE = "person_id long, full_name string, primary_phone string, primary_email string, source_origin string"
SUBMITTED = "submission_id long, name string, phone string, capture_mode string, content_type string, byte_size long, original_filename string, created_seq long, created_at timestamp"
NOW = datetime(2026, 5, 1, 12)


def people(spark, *rows):
    return spark.createDataFrame([(i, f"P{i}", phone, mail, "csv_merge") for i, phone, mail in rows], PEOPLE)


def submitted(i, phone, seq, at=NOW):
    return (i, "Asha", phone, "record", "audio/wav", 10, "a", seq, at)


def run(spark, folder, rows, number):
    spark.createDataFrame(rows, SUBMITTED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = stream.arriving(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    stream.take_submissions(source, f"{folder}/people", f"{folder}/out", f"{folder}/progress")
    got = spark.read.parquet(f"{folder}/out/attached")
    return sorted([(r.submission_id, r.phone_key, r.person_id % (1 << 40), r.batch) for r in got.collect()], key=str)


def test_each_submission_lands_once_for_good(spark, tmp_path):
    people_index.write_index(people(spark, (1, "9000000001", None), (2, "9000000001", None), (3, "9000000003", None)), f"{tmp_path}/people")
    day = timedelta(days=1)
    first = run(spark, tmp_path, [submitted(1, "9000000001", 1), submitted(2, "+91 9000000007", 2), submitted(3, "9000000008", 3), submitted(None, "9000000007", 4)], 0)
    assert first == sorted([(1, "9000000001", 1, 0), (2, "9000000007", 1, 0), (3, "9000000008", 2, 0), (None, "9000000007", 1, 0)], key=str)
    # Again an hour and forty days later; a new one dated forty days back; a new phone; the row without an id once more and another one.
    again = [submitted(1, "9000000001", 5, NOW + timedelta(hours=1)), submitted(2, "9000000007", 6, NOW + 40 * day), submitted(5, "9000000003", 7, NOW - 40 * day), submitted(6, "9000000009", 8), submitted(None, "9000000007", 4), submitted(None, "9000000007", 9)]
    second = run(spark, tmp_path, again, 1)
    assert second == sorted([*first, (5, "9000000003", 3, 1), (6, "9000000009", 3, 1), (None, "9000000007", 1, 1)], key=str)
    made = spark.read.parquet(f"{tmp_path}/out/made").orderBy("person_id").collect()
    assert [(r.primary_phone, r.person_id - (4 << 40)) for r in made] == [("9000000007", 1), ("9000000008", 2), ("9000000009", 3)]
    assert run(spark, tmp_path, [submitted(6, "9000000009", 8)], 2) == second


def test_a_batch_writes_a_file_a_bucket_of_the_people_it_makes(spark, tmp_path):
    people_index.write_index(people(spark, (1, "9000000001", None)), f"{tmp_path}/people")
    run(spark, tmp_path, [submitted(i, str(9100000000 + i), i) for i in range(2000)], 0)
    files = list((tmp_path / "out" / "made").rglob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/out/made").count() == 2000 and len(files) == len({f.parent for f in files}) == 64


def test_a_batch_finds_the_newest_people(spark, tmp_path):
    schema, root = "row_no long, name string, email string, phone string", f"{tmp_path}/people"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.check_incoming(stream.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), root, f"{tmp_path}/out", f"{tmp_path}/progress")
        return {r.row_no: (r.status, r.person_id, r.index_version) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    people_index.write_index(people(spark, (1, "9000000001", "a@x")), root)
    first = arrive((1, "n", "A@x", None), (2, "n", None, "9000000002"))
    assert first == {1: ("duplicate", 1, 1), 2: ("new", None, 1)}
    people_index.write_index(people(spark, (1, "9000000001", "a@x"), (7, "9000000002", None)), root)
    assert arrive((3, "n", "", "+91 9000000002"), (4, "n", "b@x", "12")) == first | {3: ("duplicate", 7, 2), 4: ("new", None, 2)}


def test_looking_up_does_not_shuffle_people(spark, tmp_path):
    rows = [(i, str(9000000000 + i), f"m{i}@x" if i % 2 else None) for i in range(2000)]
    people_index.write_index(people(spark, *rows), str(tmp_path), buckets=16)
    index = people_index.newest_index(spark, str(tmp_path), 16)
    incoming = spark.range(5000).selectExpr("id AS row_no", "'n' AS name", "concat('M', id, '@X') AS email", "CASE WHEN id % 3 = 0 THEN cast(9000000000 + id AS string) END AS phone")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookup.looked_up_in(incoming, index.table("by_phone"), index.table("by_email"))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Bucketed: true") == 2 and "SortMergeJoin" in plan
    for line, after in zip(plan.splitlines(), plan.splitlines()[1:]):
        assert not ("Exchange" in line and "__known" in line + after)
    want = lookup.looked_up(incoming, people(spark, *rows))
    columns = ["row_no", "status", "matched_on", "person", "note"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    keys = spark.createDataFrame([("9000000005",), (None,), ("nobody",)], "phone_key string")
    near = index.near("by_phone", keys)
    assert 0 < near.count() < 500 and near.where("phone_key = '9000000005'").first().by_phone.person_id == 5
    assert index.near("by_email", spark.createDataFrame([(None,)], "email_key string")).count() == 0
    with pytest.raises(ValueError):
        people_index.newest_index(spark, f"{tmp_path}/none")


def test_a_key_of_very_many_rows_is_not_one_task(spark, tmp_path):
    """A placeholder that nobody has, one that a person has, and few rows of other keys."""
    people_index.write_index(people(spark, *[(i, str(9000000000 + i), f"m{i}@x") for i in range(200)]), str(tmp_path), buckets=16)
    index = people_index.newest_index(spark, str(tmp_path))
    email = "CASE WHEN id % 20 = 0 THEN concat('M', id % 400, '@X') ELSE 'bad' END AS email"
    incoming = spark.range(300_000).selectExpr("id AS row_no", "'n' AS name", email, "CASE WHEN id % 10 = 3 THEN NULL WHEN id % 10 = 7 THEN '9000000150' WHEN id % 2 = 0 THEN '+91 9000000007' ELSE cast(9000000000 + id AS string) END AS phone")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = lookup.looked_up_in(incoming, index.table("by_phone"), index.table("by_email")).selectExpr("row_no", "matched_on", "person.person_id AS person_id", "spark_partition_id() AS task")
        got.write.parquet(f"{tmp_path}/got")
        phones = lookup.looked_up_in(incoming.drop("email"), index.table("by_phone"), index.table("by_email")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    got = spark.read.parquet(f"{tmp_path}/got")
    assert got.count() == 300_000 and max(r["count"] for r in got.groupBy("task").count().collect()) < 40_000
    assert sum(r["count"] for r in phones) == 300_000 and max(r["count"] for r in phones) < 40_000
    known = spark.range(300_000).selectExpr("id AS row_no", "CASE WHEN id % 2 = 0 OR id % 10 = 7 OR (id < 200 AND id % 10 <> 3) THEN 'phone' END AS matched_on", "CASE WHEN id % 10 = 3 THEN NULL WHEN id % 10 = 7 THEN 150 WHEN id % 2 = 0 THEN 7 WHEN id < 200 THEN id END AS person_id")
    assert got.drop("task").exceptAll(known).count() == 0


def test_a_large_batch_is_dealt_out_by_the_buckets(spark, tmp_path):
    """Its tasks are as many as the index has buckets, not as the session has partitions, and people aren't shuffled."""
    rows = [(i, str(9000000000 + i), f"m{i}@x") for i in range(2000)]
    people_index.write_index(people(spark, *rows), f"{tmp_path}/people", buckets=32)
    email = "CASE WHEN id % 7 = 0 THEN '' WHEN id % 2 = 0 THEN concat('M', id % 4000, '@X ') ELSE concat('n', id, '@x') END AS email"
    phone = "CASE WHEN id % 7 = 0 THEN '12' WHEN id % 5 = 0 THEN cast(9100000000 + id AS string) ELSE cast(9000000000 + id % 2000 AS string) END AS phone"
    spark.range(20_000).selectExpr("id AS row_no", "'n' AS name", email, phone).coalesce(1).write.parquet(f"{tmp_path}/in")
    incoming = spark.read.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stream.check_incoming(stream.arriving(spark, f"{tmp_path}/in", incoming.schema), f"{tmp_path}/people", f"{tmp_path}/out", f"{tmp_path}/progress")
        want = lookup.looked_up(incoming, people(spark, *rows)).selectExpr("row_no", "status", "matched_on", "person.person_id AS person_id", "note").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(f"{tmp_path}/out")
    most = max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect())
    assert most < 20_000 / 32 * 1.5
    assert sorted(map(str, got.select("row_no", "status", "matched_on", "person_id", "note").collect())) == sorted(map(str, want))
    index = people_index.newest_index(spark, f"{tmp_path}/people")
    before = len(spark.catalog.listTables())
    assert [t.count() for t in index.nearby(spark.createDataFrame([(r[1], None) for r in rows], "phone_key string, email_key string"))] == [2000, 0]
    assert len(spark.catalog.listTables()) == before  # each batch finds the table that is there


def test_buckets_grow_with_the_people(spark, tmp_path):
    assert [people_index.buckets_for(n) for n in (0, 1 << 21, (1 << 21) + 1, 20_000_000)] == [64, 64, 128, 1024]
    people_index.write_index(people(spark, (1, "9000000001", "a@x")), str(tmp_path))
    assert people_index.newest_index(spark, str(tmp_path)).buckets == 64
    with pytest.raises(ValueError):
        people_index.newest_index(spark, str(tmp_path), 16)


def test_versions_are_whole_or_not_there(spark, tmp_path):
    root = str(tmp_path)
    write = lambda n: versions.as_parquet(spark.range(n))
    assert versions.newest(spark, root) == (0, {})
    assert versions.publish(spark, root, {"a": write(3), "b": write(4)}) == 1
    with pytest.raises(ZeroDivisionError):
        versions.publish(spark, root, {"a": write(9), "b": lambda path: 1 / 0})
    count = lambda name: versions.published(spark, root, name).count()
    assert (count("a"), count("b")) == (3, 4)
    assert versions.publish(spark, root, {"a": write(5)}, carry=("b", "none")) == 2
    old = versions.published(spark, root, "b")
    assert (count("a"), count("b")) == (5, 4)
    assert versions.publish(spark, root, {"a": write(6)}, carry=("b",)) == 3
    assert (count("a"), count("b"), old.count()) == (6, 4, 4)  # a carried table's folder stays
    folders = sorted(p.name for p in tmp_path.iterdir() if p.name[0] == "v")
    assert len(folders) == 3 and [f[:11] for f in folders] == ["v0000000001", "v0000000002", "v0000000003"]  # the killed one is gone
    assert len([p for p in (tmp_path / "manifests").iterdir() if p.suffix == ".json"]) == 2
    with pytest.raises(ValueError):
        versions.published(spark, root, "c")
    tables.removed(spark, root)
    assert not tables.exists(spark, root)
