from rollcall.operators.resolve import STEP, dense_ids, resolve
from rollcall.sources.specs import BRIDGE, CONTACTS, GIGS

B = "line_no long, " + ", ".join(f"{c} string" for c in BRIDGE.columns)
G = "line_no long, " + ", ".join(f"{c} string" for c in GIGS.columns)
C = "line_no long, " + ", ".join(f"{c} string" for c in CONTACTS.columns)


def tables(spark, b=(), g=(), c=()):
    return spark.createDataFrame(list(b), B), spark.createDataFrame(list(g), G), spark.createDataFrame(list(c), C)


def bridge(line, name, email, phone, city="Pune", ctc="4.2", skills="SQL"):
    return (line, name, email, phone, city, "3", ctc, "2026-01-05", skills)


def test_duplicate_group_keeps_longest_name_shortest_email_first_line(spark):
    b = [bridge(2, "R. Verma", "alt.r@x", "09000000001", "Pune", "4.2", "SQL"), bridge(3, "Rohit Verma", "r@x", "+91 9000000001", "Noida", "5.5", "Python")]
    m = resolve(*tables(spark, b))
    p = m.people().collect()
    assert [(r.full_name, r.primary_email, r.city, r.ctc_annual_inr) for r in p] == [("Rohit Verma", "r@x", "Pune", 420000)]
    assert {r.skill for r in m.skills().collect()} == {"SQL"}  # the first line's only
    assert sorted((r.source_row_number, r.match_method) for r in m.links().collect()) == [(2, "seed"), (3, "exact_phone")]
    d = m.merged_duplicates().collect()[0]
    assert d.raw_value == "line 2: R. Verma | line 3: Rohit Verma" and (d.names, d.emails) == (2, 2)


def test_email_index_last_primary_beats_first_secondary(spark):
    b = [bridge(2, "A", "s@x", "9000000001"), bridge(3, "A", "a@xx", "9000000001"), bridge(4, "B", "s@x", "9000000002"), bridge(5, "C", "s@x", "9000000003"), bridge(6, "D", "longer@x", "9000000004"), bridge(7, "D", "d@x", "9000000004"), bridge(8, "E", "longer@x", "short"), bridge(9, "E2", "e@x", "9000000005"), bridge(10, "E2", "zzlonger@x", "9000000005")]
    got = {r.email_key: r.person_id - STEP for r in resolve(*tables(spark, b)).index.collect()}
    assert got["s@x"] == 5  # the last group that has it as primary
    assert got["longer@x"] == 8 and got["zzlonger@x"] == 9 and got["d@x"] == 6


def test_last_line_wins_even_with_null_and_orphans_stay_apart(spark):
    b = [bridge(2, "A", "a@x", "9000000001", "Pune")]
    g = [(2, "A@X ", "A", "10/hr", "Noida", "active", "sql"), (3, "a@x", "A", "per day", "Pune", "paused", ""), (4, "o@x", "Same", "1k/month", "Pune", "on leave", ""), (5, "o@x", "Same", "2/hr", "Pune", "", "")]
    c = [(2, "same", "9000000009", "Pune", "y", "3"), (3, "SAME ", "9000000009", "Pune", "no", "x"), (4, "", "none", "", "maybe", "")]
    m = resolve(*tables(spark, b, g, c))
    a = {r.person_id: r for r in m.people().collect()}
    assert (a[STEP + 2].rate_amount, a[STEP + 2].status) == (None, "paused")
    assert len(a) == 1 + 2 + 3
    assert [(r.source_a_row, r.source_b_row) for r in m.lookalikes().orderBy("source_a_row").collect()] == [(4, 2), (5, 2)]
    assert [(r.source_file, r.line_no) for r in m.city_conflicts().collect()] == [("gigs", 2)]
    assert sorted((r.line_no, r.column_name) for r in m.unparsed().collect()) == [(3, "rate"), (4, "Verified"), (4, "status")]
    assert m.links().count() == 1 + 4 + 3


def test_order_and_partitions_do_not_matter(spark):
    b = [bridge(i, f"N{i % 7}" * (1 + i % 3), f"e{i % 11}@x", f"90000000{i % 5:02d}") for i in range(2, 40)]
    t = tables(spark, b)
    one = sorted(map(str, resolve(*t).people().collect()))
    two = sorted(map(str, resolve(*(x.repartition(7).orderBy("line_no", ascending=False) for x in t)).people().collect()))
    assert one == two


def test_empty_tables_and_dense_ids(spark):
    m = resolve(*tables(spark))
    assert m.people().count() == 0 and m.issues().count() == 0
    ids = dense_ids(spark.createDataFrame([(9,), (3,), (7,)], "person_id long")).collect()
    assert {r.person_id: r.dense_id for r in ids} == {3: 1, 7: 2, 9: 3}


def test_hot_phone_is_one_person(spark):
    b = [bridge(i, "Hot", f"h{i}@x", "0000000000") for i in range(2, 500)]
    m = resolve(*tables(spark, b))
    assert m.people().count() == 1 and m.merged_duplicates().collect()[0].lines == 498
