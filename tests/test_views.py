"""Views hold all that their tables hold."""

from pyspark.sql import functions as F

from rollcall.functions.normalise import phone_key
from rollcall.jobs.views import view

DIR = "/root/testdata/sf0.01"


def test_every_line_item_is_an_incoming_row(spark):
    assert view(spark, DIR, "incoming").count() == spark.read.parquet(f"{DIR}/lineitem.parquet").count() == 60_000


def test_submitted_phones_grow_with_events(spark):
    """About as many phones for each event at any size, some of them held by people and some submitted several times."""

    def phones(sf):
        keys = view(spark, f"/root/testdata/sf{sf}", "submissions").select(phone_key(F.col("phone")).alias("k")).where("k is not null")
        return keys.groupBy("k").count()

    small, large = phones("0.001").count(), phones("0.01").count()
    assert large > 2600 and 8 < large / small < 12
    assert phones("0.01").where("count > 1").count() > 100
    assert phones("0.01").where("k < '9000001500'").count() > 100
