"""Tables of a run published together: readers see all of a version or none of it.

Each version's tables are written to a new folder; then a manifest that names
every table's folder is written aside and renamed to its number.  A run that stops before the rename leaves
the version before it as it was.  One publisher at a time is taken for granted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from rollcall.sources.tables import file_system, removed, side_by_side

#: A table's writer: given the folder, it writes the table there.
Writer = Callable[[str], None]


def _manifests(spark: SparkSession, root: str) -> dict[int, str]:
    """Manifest by version."""
    system, at = file_system(spark, f"{root}/manifests")
    if not system.exists(at):
        return {}
    names = {s.getPath().getName(): s.getPath().toString() for s in system.listStatus(at)}
    return {int(name.removesuffix(".json")): path for name, path in names.items() if name.endswith(".json") and name[0] != "."}


def newest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The number of the newest whole version and its tables' folders; 0 and none before the first."""
    found = _manifests(spark, root)
    if not found:
        return 0, {}
    version = max(found)
    text = spark.read.text(found[version], wholetext=True).first()[0]
    return version, {name: f"{root}/{folder}" for name, folder in json.loads(text).items()}


def publish(spark: SparkSession, root: str, writers: dict[str, Writer], carry: Iterable[str] = (), keep: int = 2) -> int:
    """Write the tables of a new version and publish it; ``carry`` names tables that stay those of the version before.

    Folders that the last ``keep`` versions don't name are removed after that, so a reader has until the version
    after the next to end.
    """
    last, before = newest(spark, root)
    version = last + 1
    folder = f"v{version:010d}-{uuid.uuid4().hex}"
    tables = {name: before[name].removeprefix(f"{root}/") for name in carry if name in before}
    side_by_side(spark, [partial(write, f"{root}/{folder}/{name}") for name, write in writers.items()])
    tables |= {name: f"{folder}/{name}" for name in writers}
    system, aside = file_system(spark, f"{root}/manifests/.{folder}")
    out = system.create(aside)
    out.write(bytearray(json.dumps(tables, indent=1).encode()))
    out.close()
    _, final = file_system(spark, f"{root}/manifests/{version:010d}.json")
    if system.exists(final) or not system.rename(aside, final):
        raise RuntimeError(f"{root}: version {version} is there already; nothing was published")
    _swept(spark, root, keep)
    return version


def _swept(spark: SparkSession, root: str, keep: int) -> None:
    found = _manifests(spark, root)
    held = set()
    for version in sorted(found)[-keep:]:
        text = spark.read.text(found[version], wholetext=True).first()[0]
        held |= {path.partition("/")[0] for path in json.loads(text).values()}
    for version in sorted(found)[:-keep]:
        removed(spark, found[version])
    system, at = file_system(spark, root)
    for status in system.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("v") and name not in held:
            removed(spark, status.getPath().toString())


def as_parquet(df: DataFrame, *by: str) -> Writer:
    """Writes ``df`` as Parquet, in folders by the columns ``by``."""
    return lambda path: (df.write.partitionBy(*by) if by else df.write).parquet(path)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest version."""
    version, tables = newest(spark, root)
    if name not in tables:
        raise ValueError(f"{root}: version {version} has no table {name}")
    return spark.read.parquet(tables[name])
