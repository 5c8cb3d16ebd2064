"""Helpers the operators share: shared folders, written tables, code that travels with a task, row keys."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Let the worker functions of a module travel with the task; executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is absent, as in local tests, a temporary folder of this machine stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: it cuts the lineage and is computed once, so lost executors cost a re-read."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the folder of a frame made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def _carried(column: str, columns: list[str]) -> str:
    """The name under which a column stands beside ``row_key``: its own, unless that is row_key."""
    if column.lower() != "row_key":
        return column
    taken, name = {c.lower() for c in columns}, "_own_row_key"
    while name in taken:
        name = "_" + name
    return name


def with_row_key(docs: DataFrame) -> DataFrame:
    """All columns and ``row_key``, a content locator (file and row in it) that is the same in every scan.

    A frame that is not a plain scan is written to the shared folder first, and that table is scanned. A column of the
    frame that has this name is carried under another one; ``without_rows`` gives the name back.
    """
    key = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("row_key")
    plain = [F.col(f"`{c}`").alias(_carried(c, docs.columns)) for c in docs.columns]
    try:
        return docs.select(*plain, key)
    except AnalysisException:
        return written(docs, "rows").select(*plain, key)


def without_rows(keyed: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose row_key is not in ``gone``."""
    return keyed.join(gone.select("row_key"), "row_key", "left_anti").select(
        *[F.col(f"`{_carried(c, columns)}`").alias(c) for c in columns])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, however often later expressions name them.

    The generator is a barrier: the optimizer would otherwise copy an expensive expression into each use.
    """
    packed = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", packed)


def give_back() -> None:
    """Return freed memory to the system. A worker process outlives its task and would keep it beside the next stage's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """The function of a task over batches, followed by ``give_back``."""
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let the session send at most ``rows`` rows to Python at once.

    Whole texts make batches of the usual 10,000 rows tens of megabytes, held by the JVM, in flight and by the worker, for each
    task; what the allocators have once taken stays with them for the stages to come.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def slices(batch, limit: int = 1 << 20, column: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch that hold about ``limit`` bytes of text each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype("int64"))
    start, rows = 0, len(ends)
    while start < rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start = stop
