"""Exports of several files, end to end: lines, headers, records, screening, merge, written issues."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import screen
from rollcall.operators.resolve import Resolved, resolve
from rollcall.sources import lines as L
from rollcall.sources import tables, versions
from rollcall.sources.specs import BRIDGE, CONTACTS, GIGS, ExportSpec


@dataclass
class Export:
    """rows: the screened records of all files of one export; staged: those that stand, numbered through the files."""

    spec: ExportSpec
    rows: DataFrame
    staged: DataFrame

    def issues(self) -> DataFrame:
        return screen.issues(self.rows, self.spec)


def read_export(spark: SparkSession, path: str, spec: ExportSpec) -> Export:
    """The files below ``path``; an empty file, or one with another header, is an error.

    The numbered lines and the screened records are written once: every result reads them from there.
    """
    lines = tables.durable(L.numbered_lines(spark, path))
    L.check_headers(lines, spec, L.input_files(spark, path))
    rows = tables.durable(screen.screened(L.stitched(lines), spec))
    return Export(spec, rows, L.source_wide(screen.staged(rows, spec), lines))


@dataclass
class Rebuilt:
    """The exports by name, and what they merge into."""

    exports: dict[str, Export]
    merged: Resolved

    def places(self) -> DataFrame:
        """source_file, source_row_number (through the files), file, file_line of every staged record."""
        out = None
        for name, export in self.exports.items():
            one = export.staged.select(F.lit(name).alias("source_file"), F.col("line_no").alias("source_row_number"), "file", "file_line")
            out = one if out is None else out.unionByName(one)
        return out

    def ingest_issues(self) -> DataFrame:
        out = None
        for export in self.exports.values():
            one = export.issues()
            out = one if out is None else out.unionByName(one)
        return out

    def write_issues(self, path: str) -> None:
        """The issues of both phases; a rerun replaces its own rows only."""
        tables.write_phase(self.ingest_issues(), path, "ingest")
        tables.write_phase(self.merged.issues(), path, "merge")

    def _merge_tables(self) -> dict[str, DataFrame]:
        m = self.merged
        return {"people": m.people(), "links": m.links(), "skills": m.skills(), "candidates": m.lookalikes(), "issues_merge": m.issues()}

    def _ingest_tables(self) -> dict[str, DataFrame]:
        return {"issues_ingest": self.ingest_issues()} | {f"staged_{name}": e.staged for name, e in self.exports.items()}

    def publish(self, root: str) -> int:
        """W1, the whole write: people, links, skills, candidates, staged rows and issues of both phases, published together as the next version of ``root``."""
        found = self._merge_tables() | self._ingest_tables()
        return versions.publish(self.merged.bridge.sparkSession, root, {name: versions.as_parquet(df) for name, df in found.items()})

    def publish_merge(self, root: str) -> int:
        """What a merge owns, published anew; ingestion's tables stay those of the version before."""
        writers = {name: versions.as_parquet(df) for name, df in self._merge_tables().items()}
        return versions.publish(self.merged.bridge.sparkSession, root, writers, carry=self._ingest_tables())


def rebuild(spark: SparkSession, bridge: str, gigs: str, contacts: str) -> Rebuilt:
    """The whole rebuild from three folders of export files."""
    files = ((BRIDGE, bridge), (GIGS, gigs), (CONTACTS, contacts))
    found = tables.side_by_side(spark, [partial(read_export, spark, path, spec) for spec, path in files])
    return Rebuilt({e.spec.name: e for e in found}, resolve(*(e.staged for e in found)).settled())
