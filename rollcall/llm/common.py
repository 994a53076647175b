"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session, wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_rollcall_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / "rollcall_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._rollcall_shipped = True


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, as texts are long; a setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark alone."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a folder of our own serves only where driver and executors are one process.

    Elsewhere executors wouldn't see a machine-local folder: without the setting that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder of :func:`scratch`, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ..., and the new name of each (of equal names the first).

    Operators that add columns of their own work on these names, so that no name of
    a table, whatever it holds, clashes with theirs; ``toDF(*docs.columns)`` gives the old names back.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {c: n for c, n in reversed(list(zip(docs.columns, names)))}


def bucket_of(column: Column | str, n: Column | int) -> Column:
    """A bucket in ``[0, n)`` from a hash of ``column``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.xxhash64(column), F.lit(n) if isinstance(n, int) else n)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def with_results(rows: DataFrame, **results: str) -> T.StructType:
    """The schema of ``rows`` without ``__text``, and results (name = type) after it."""
    kept = [f for f in rows.schema if f.name != "__text"]
    return T.StructType([*kept, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in results.items())])


def give_back() -> None:
    """Return freed memory to the system: workers stay between tasks, and what they keep counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, without searches for cycles (none are made), giving freed memory back at its end."""

    def inner(batches):
        from rollcall.llm.common import give_back

        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            give_back()

    return inner


def slices(batches, size_of: str, max_bytes: int):
    """Cut Arrow batches into slices of about ``max_bytes`` of column ``size_of`` each.

    A row is never divided; a row larger than ``max_bytes`` makes a slice alone.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(size_of))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
