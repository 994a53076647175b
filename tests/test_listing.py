"""The listing has every accepted submission."""

import duckdb

from rollcall.jobs import registry

DIR = "/root/testdata/sf0.001"


def test_listing_has_every_accepted_submission(spark):
    """Row by row as its SQL says with the page size left out."""
    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.queries()["a08_listing"](spark, DIR)
    want = con.execute(registry.oracle_sql()["a08_listing"].replace(" ORDER BY created_seq DESC, submission_id DESC LIMIT 200", ""))
    names = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    assert len(want) > 200
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == want
