"""People by phone and by email, written once and looked up many times.

Both tables are bucketed by their key, a file a bucket, and published by version; the number of
buckets grows with the people, so that what a bucket's task holds doesn't.
A large batch is joined bucket by bucket, so people are never shuffled and the tasks are as many as the buckets, whatever
the session's number is; a small one reads only the files of the buckets that its keys fall into.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.lookup import key_index
from rollcall.sources import versions
from rollcall.sources.tables import file_system

#: Buckets at least, and the people from which on there are more, twice as many each time.
BUCKETS, BUCKET_PEOPLE = 64, 1 << 15
PERSON = "struct<person_id:bigint,full_name:string,source_origin:string>"
KEYS = {"by_phone": ("primary_phone", "phone_key"), "by_email": ("primary_email", "email_key")}


def buckets_for(people: int) -> int:
    """A power of two with at most ``BUCKET_PEOPLE`` people a bucket, on average."""
    return max(BUCKETS, 1 << (max(people - 1, 0) // BUCKET_PEOPLE).bit_length())


def write_index(people: DataFrame, root: str, buckets: int | None = None) -> int:
    """Publish the people (person_id, full_name, primary_phone, primary_email, source_origin) as a new version of the index.

    Tables bear the number of their buckets in their name; without ``buckets`` the people are counted for it.
    """
    buckets = buckets or buckets_for(people.count())

    def bucketed(name: str) -> versions.Writer:
        column, key = KEYS[name]
        rows = key_index(people, column, key, name).repartition(buckets, key)
        return lambda path: _table(rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path))

    return versions.publish(people.sparkSession, root, {f"{name}-{buckets}": bucketed(name) for name in KEYS})


def _table(writer) -> None:
    writer.saveAsTable(_new_name())


def _new_name() -> str:
    return f"rollcall_index_{uuid.uuid4().hex}"


@dataclass
class PeopleIndex:
    """One version of the index; what it holds doesn't change."""

    spark: SparkSession
    version: int
    folders: dict[str, str]
    buckets: int

    def table(self, name: str) -> DataFrame:
        """by_phone or by_email, as a table that joins on its key need not shuffle; the same one each time."""
        _, key = KEYS[name]
        own = f"rollcall_index_{hashlib.sha256(self.folders[name].encode()).hexdigest()[:32]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {own} ({key} STRING, {name} {PERSON}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folders[name]}'")
        return self.spark.table(own)

    def near(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that the column of ``keys`` falls into; all, as :meth:`table`, if these are more than half."""
        return self._of(name, self._hit((name,), keys)[name])

    def nearby(self, keys: DataFrame) -> list[DataFrame]:
        """:meth:`near` of both tables; ``keys`` is read once and may hold a key many times."""
        hit = self._hit(tuple(KEYS), keys)
        return [self._of(name, hit[name]) for name in KEYS]

    def _hit(self, names: tuple[str, ...], keys: DataFrame) -> dict[str, set[int]]:
        """The buckets that the keys of each table fall into; at most ``buckets`` numbers a table come to the driver."""
        bucket = lambda key: F.when(F.col(key).isNotNull(), F.pmod(F.hash(key), F.lit(self.buckets)))
        of = [F.struct(F.lit(name).alias("name"), bucket(KEYS[name][1]).alias("b")) for name in names]
        found = keys.select(F.inline(F.array(*of))).where("b is not null").distinct().collect()
        return {name: {r.b for r in found if r.name == name} for name in names}

    def _of(self, name: str, hit: set[int]) -> DataFrame:
        if 2 * len(hit) > self.buckets:
            return self.table(name)
        _, key = KEYS[name]
        system, at = file_system(self.spark, self.folders[name])
        files = [s.getPath().toString() for s in system.listStatus(at)]
        wanted = [f for f in files if (b := bucket_of(f)) is not None and b in hit]
        schema = f"{key} string, {name} {PERSON}"
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)


def bucket_of(file: str) -> int | None:
    """The bucket that Spark wrote into a file, by its name."""
    name = file.rpartition("/")[2]
    part = name.partition(".")[0].rpartition("_")[2]
    return int(part) if name.startswith("part-") and part.isdigit() else None


def newest_index(spark: SparkSession, root: str, buckets: int | None = None) -> PeopleIndex:
    """The newest whole version; ``buckets``, if given, is the number that it must have."""
    version, tables = versions.newest(spark, root)
    if not version:
        raise ValueError(f"{root}: no index has been published")
    found = {name: int(number) for name, _, number in (table.rpartition("-") for table in tables)}
    if buckets and set(found.values()) != {buckets}:
        raise ValueError(f"{root}: version {version} has {found}, not {buckets} buckets")
    return PeopleIndex(spark, version, {name: tables[f"{name}-{number}"] for name, number in found.items()}, found["by_phone"])
