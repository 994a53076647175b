"""The lookup and the intake over rows that arrive, with a batch's results left in a folder.

People are known by a published index (:mod:`rollcall.operators.people_index`): each
micro-batch takes its newest version and reads the buckets that the batch's keys fall into; a large
one meets all of them bucket by bucket.  Every
batch writes partitions of its own number, so one that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollcall.functions.normalise import email_key, phone_key
from rollcall.operators import intake, lookup
from rollcall.operators.people_index import newest_index
from rollcall.sources.tables import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of the phones of people that the stream has made.
MADE_BUCKETS = 64
MADE = "person_id long, full_name string, primary_phone string, source_origin string, batch long, bucket int"


def arriving(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _run(rows: DataFrame, batch: Callable[[DataFrame, int], None], progress: str) -> None:
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def _write(df: DataFrame, number: int, path: str, *by: str) -> None:
    df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)


def check_incoming(incoming: DataFrame, index_root: str, sink: str, progress: str, buckets: int | None = None) -> None:
    """Look up what has arrived, each batch in the newest people, and leave the answers in ``sink``; a restart goes on where it stopped."""
    spark = incoming.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        index = newest_index(spark, index_root, buckets)
        keys = lookup.with_both_columns(rows).select(phone_key(F.col("phone")).alias("phone_key"), email_key(F.col("email")).alias("email_key"))
        checked = lookup.looked_up_in(rows, *index.nearby(keys)).select("row_no", "name", "phone", "email", "status", "matched_on", F.col("person.person_id").alias("person_id"), "note")
        _write(checked.withColumn("index_version", F.lit(index.version)), number, sink)

    _run(incoming, batch, progress)


def landed_once(submissions: DataFrame) -> DataFrame:
    """The submissions whose id has never landed, however long ago, and however late they are.

    The ids that have landed are the state of the stream (no watermark, so none is given up),
    kept by key in RocksDB on the executors' disks and in the checkpoint folder.  A row
    without an id is known by all that it holds.
    """
    submissions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = F.coalesce(F.col("submission_id").cast("string"), F.concat(F.lit(" "), F.sha2(F.to_json(F.struct(*submissions.columns)), 256)))
    return submissions.withColumn("__landed", own).dropDuplicates(["__landed"]).drop("__landed")


def _made_near(spark: SparkSession, folder: str, phones: DataFrame, number: int) -> DataFrame:
    """The people made by earlier batches, of the buckets that the phones fall into."""
    if not exists(spark, f"{folder}/made"):
        return spark.createDataFrame([], MADE)
    hit = [r.b for r in phones.select(made_bucket("phone_key").alias("b")).distinct().collect()]  # MADE_BUCKETS numbers at most
    return spark.read.schema(MADE).parquet(f"{folder}/made").where((F.col("batch") < number) & F.col("bucket").isin(hit))


def made_bucket(phone: str):
    return F.pmod(F.hash(phone), F.lit(MADE_BUCKETS)).cast("int")


def take_submissions(submissions: DataFrame, index_root: str, folder: str, progress: str, buckets: int | None = None) -> None:
    """Attach submissions as they arrive; each lands once and for good.

    A batch looks its phones up in the index and among the people that earlier batches made, reading
    only the buckets that they fall into, and numbers the people that it makes on from where
    the batch before it stopped.
    """
    spark = submissions.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        accepted = intake.validated(rows).where("reason is null").persist()
        phones = accepted.select("phone_key").distinct().persist()
        known = newest_index(spark, index_root, buckets).near("by_phone", phones).select("phone_key", F.col("by_phone.person_id").alias("known"))
        made_before = _made_near(spark, folder, phones, number).select(F.col("primary_phone").alias("phone_key"), F.col("person_id").alias("known"))
        lowest = known.unionByName(made_before).groupBy("phone_key").agg(F.min("known").alias("known"))
        start = 0
        if exists(spark, f"{folder}/counts"):  # a row a batch
            start = spark.read.schema("upto long, batch long").parquet(f"{folder}/counts").where(F.col("batch") < number).agg(F.max("upto")).first()[0] or 0
        attached, made = intake.attach_known(accepted, lowest, start=start)
        made_by_bucket = made.drop("raw_value").withColumn("bucket", made_bucket("primary_phone")).repartition(MADE_BUCKETS, "bucket")  # a file a bucket
        _write(made_by_bucket, number, f"{folder}/made", "bucket")
        _write(attached.select("submission_id", "phone_key", "person_id"), number, f"{folder}/attached")
        _write(made.agg((F.count("*") + start).alias("upto")), number, f"{folder}/counts")
        for df in (accepted, phones):
            df.unpersist()

    _run(landed_once(submissions), batch, progress)
