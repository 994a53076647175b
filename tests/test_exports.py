"""Exports of several files from lines to people, and the results of the known shapes."""

import csv

import pytest
from pyspark.sql import functions as F

from rollcall.jobs import exports
from rollcall.operators import lineage, lookup, screen
from rollcall.sources import lines as L
from rollcall.sources import tables
from rollcall.sources.specs import BRIDGE, CONTACTS, GIGS


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerows(rows)


def known_shapes(tmp_path):
    """42 + 32 + 31 lines: two pairs of one phone, a blank, a rotated and a repeated header line, five names in two exports."""
    pairs = {29: 23, 35: 25}  # data row -> the earlier row of the same person
    mail, phone = lambda i: f"user{i}@mail.example.org", lambda i: str(9000000000 + i)
    bridge = [list(BRIDGE.header)]
    for i in range(42):
        own = pairs.get(i, i)
        email = mail(23) if i == 29 else "alt." + mail(25) if i == 35 else mail(i)
        bridge.append([f"P. {own}" if i in pairs else f"Person Number {own}", email, ("0", "+91", "")[i % 3] + phone(own), "Pune", "4.2", "4.2" if i % 2 else str(400000 + i), "2026-01-05", "n8n, SQL"])
    gigs = [list(GIGS.header)]
    for line in range(2, 34):
        if line == 12:
            gigs.append([""] * 6)
        elif line == 20:
            seven = gigs[6]
            gigs.append([seven[-1], *seven[:-1]])
        else:
            matched = line < 18
            gigs.append([mail(line).upper() if matched else f"gig{line}@other.example", f"Person Number {line}" if matched else f"Freelancer {line}", "1415/hr" if line % 2 else "15k/month", "Noida" if line in (6, 8) else "pune ", "ACTIVE", "n8n, web scraping"])
    contacts, alike = [list(CONTACTS.header)], {28: 18, 29: 19, 30: 21, 31: 22, 32: 23}
    for line in range(2, 33):
        if line == 16:
            contacts.append(list(CONTACTS.header))
        elif line in alike:
            contacts.append([f"FREELANCER {alike[line]}", f"+91-8{line:09d}", "Pune", "Yes", "3"])
        else:
            contacts.append([f"Person Number {line}", f"91{phone(line + 9)}" if line + 9 not in pairs else phone(41), "Delhi" if line in (4, 7, 15, 19) else "Pune", "No", "2"])
    for name, rows in (("bridge", bridge), ("gigs", gigs), ("contacts", contacts)):
        write(tmp_path / name, "export.csv", rows)
    return {name: str(tmp_path / name) for name in ("bridge", "gigs", "contacts")}


def test_known_shapes(spark, tmp_path):
    built = exports.rebuild(spark, **known_shapes(tmp_path))
    read = {n: screen.load_summary(e.rows, n).where("source_file <> 'TOTAL'").first() for n, e in built.exports.items()}
    assert [(r["read"], r.loaded, r.skipped) for r in read.values()] == [(42, 42, 0), (32, 30, 2), (31, 30, 1)]
    ingest = sorted((i.source_file, i.row_number, i.issue_type, i.severity) for e in built.exports.values() for i in e.issues().collect())
    assert ingest == [("contacts", 16, "repeated_header", "skipped"), ("gigs", 12, "blank_row", "skipped"), ("gigs", 20, "column_shift", "flagged")]
    assert "line 7" in built.exports["gigs"].issues().where("row_number = 20").first().action_taken
    m = built.merged
    seeds = {r.source_file: r.n for r in m.links().where("match_method = 'seed'").groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    assert m.people().count() == 60 and seeds == {"bridge": 40, "gigs": 15, "contacts": 5}
    methods = {r.match_method: r.n for r in m.links().groupBy("match_method").agg(F.count("*").alias("n")).collect()}
    assert methods == {"seed": 60, "exact_email": 15, "exact_phone": 27}
    assert sorted((r.source_a_row, r.source_b_row) for r in m.lookalikes().collect()) == [(18, 28), (19, 29), (21, 30), (22, 31), (23, 32)]
    issues = {r.issue_type: r.n for r in m.issues().groupBy("issue_type").agg(F.count("*").alias("n")).collect()}
    assert issues == {"duplicate_person_merged": 2, "city_conflict_across_sources": 6, "name_only_match_not_merged": 5}
    assert sorted((r.source_file, r.line_no) for r in m.city_conflicts().collect()) == [("contacts", 4), ("contacts", 7), ("contacts", 15), ("contacts", 19), ("gigs", 6), ("gigs", 8)]
    kept = {r.full_name: r.primary_email for r in m.people().where("full_name in ('Person Number 23', 'Person Number 25')").collect()}
    assert kept == {"Person Number 23": "user23@mail.example.org", "Person Number 25": "user25@mail.example.org"}
    clean = tables.violations(m.people(), m.skills(), m.links(), m.issues())
    assert {r.n for r in clean.collect()} == {0}
    assert [r.person_id for r in lineage.find_person(m.people(), "  PERSON number 7").collect()] == [(1 << 40) + 9]


def shifted(name, phone):
    return ["7", name, phone, "Pune", "y"]


def test_files_keep_their_own_keys_and_lines(spark, tmp_path):
    head = list(CONTACTS.header)
    write(tmp_path / "c", "a.csv", [head, ["A", "9000000001", "Pune", "y", "1"], ["two\nlines", "9000000002", "Pune", "y", "1"], shifted("A", "9000000001")])
    write(tmp_path / "c", "b.csv", [head, ["B", "9000000003", "Pune", "y", "1"], shifted("A", "9000000001"), ["B", "9000000001", "Pune", "y", "1"]])
    got = exports.read_export(spark, str(tmp_path / "c"), CONTACTS)
    issues = sorted((r.file[-5:], r.row_number, r.action_taken) for r in got.issues().collect())
    assert issues == [("a.csv", 5, "skipped: turned left by one it would repeat line 2"), ("b.csv", 3, "skipped: turned left by one it would be well-formed")]
    staged = sorted((r.line_no, r.file[-5:], r.file_line, r.full_name) for r in got.staged.collect())
    assert staged == [(2, "a.csv", 2, "A"), (4, "a.csv", 4, "two\nlines"), (7, "b.csv", 2, "B"), (9, "b.csv", 4, "B")]


def test_an_empty_file_is_an_error(spark, tmp_path):
    write(tmp_path / "c", "a.csv", [list(CONTACTS.header), ["A", "9000000001", "Pune", "y", "1"]])
    (tmp_path / "c" / "b.csv").write_text("")
    lines = L.numbered_lines(spark, str(tmp_path / "c"))
    assert sorted(r.header_ok for r in L.header_mismatches(lines, CONTACTS, L.input_files(spark, str(tmp_path / "c"))).collect()) == [False, True]
    with pytest.raises(ValueError):
        exports.read_export(spark, str(tmp_path / "c"), CONTACTS)


def test_batches_without_a_key_column(spark):
    people = spark.createDataFrame([(1, "A", "9000000001", "a@x", "csv_merge")], "person_id long, full_name string, primary_phone string, primary_email string, source_origin string")
    with pytest.raises(ValueError):
        lookup.looked_up(spark.createDataFrame([("A",)], "name string"), people)
    one = lookup.looked_up(spark.createDataFrame([("A", "A@X"), ("B", None), ("C", "")], "name string, email string"), people)
    assert sorted((r.name, r.status, r.matched_on, r.note) for r in one.collect()) == [("A", "duplicate", "email", None), ("B", "rejected", None, "neither phone nor email"), ("C", "new", None, "no usable key")]
