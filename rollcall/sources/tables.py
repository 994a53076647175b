"""Written tables: idempotent writes by phase, integrity checks, durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where both are one process.

    Elsewhere executors wouldn't see a machine-local folder: without the setting that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-shared-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; who takes one removes it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    system, at = file_system(spark, path)
    return system.exists(at)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder, if it is there, on whatever file system it is."""
    system, at = file_system(spark, folder)
    system.delete(at, True)


def _checkpoints(spark: SparkSession) -> None:
    """Name the checkpoint folder, if none is named yet."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that it can't come out differently twice."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


#: Jobs that are handed to Spark side by side.
SIDE_BY_SIDE = 4


def side_by_side(spark: SparkSession, jobs: Iterable[Callable[[], Any]]) -> list[Any]:
    """What each of ``jobs`` returns, in their order; they don't depend on each other, so Spark plans and runs several at once.

    All are ended when this returns; the first error, if any, is raised then.
    """
    _checkpoints(spark)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [one.result() for one in running]


def write_phase(issues: DataFrame, path: str, phase: str) -> None:
    """Replace what this phase owns and nothing else; running it again changes nothing."""
    issues.withColumn("phase", F.lit(phase)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase").parquet(path)


def violations(people: DataFrame, skills: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """Rule, n: rows that break allowed values, uniqueness, keys or references; rules that hold have 0."""
    broken = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    outside = lambda df, column, *allowed: df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    checks = [
        ("person.ctc_source_unit", outside(people, "ctc_source_unit", "lpa", "absolute")),
        ("person.rate_period", outside(people, "rate_period", "hourly", "monthly")),
        ("person.source_origin", people.where(~F.coalesce(F.col("source_origin").isin("csv_merge", "audio_app"), F.lit(False)))),
        ("link.match_method", links.where(~F.coalesce(F.col("match_method").isin("seed", "exact_phone", "exact_email"), F.lit(False)))),
        ("link.row_unique", twice(links, "source_file", "source_row_number")),
        ("link.person_exists", links.join(people.select("person_id"), "person_id", "left_anti")),
        ("skill.unique", twice(skills, "person_id", "skill")),
        ("skill.person_exists", skills.join(people.select("person_id"), "person_id", "left_anti")),
        ("issue.severity", outside(issues, "severity", "skipped", "flagged", "repaired")),
        ("person.id_unique", twice(people, "person_id")),
    ]
    out = None
    for rule, df in checks:
        one = broken(rule, df)
        out = one if out is None else out.unionByName(one)
    return out
