"""Helpers that several operators share: column picking, shared checkpoints, Arrow iteration."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Name this package's folder to Python workers, for where it is installed there by path only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by Spark's own reader."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts empty: extra columns, whatever their names, go no further."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with marks in front until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``. Only where there is no
    other machine (a local master: tests) and it is unset, a folder of this one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if held.isEmpty():
        if not named and not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        swept(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def swept(spark: SparkSession, path: str) -> None:
    """The path goes when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut lineage with a table in the shared folder, of which later readers take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    swept(spark, path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, by: str, codec: str = "zstd") -> DataFrame:
    """A table in the shared folder, in as many buckets by a column as shuffles have partitions: what needs the rows of
    a bucket together finds them so."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", codec).saveAsTable(name)
    swept(spark, path)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
    return found


@contextlib.contextmanager
def set_to(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session while a table is written."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A materialized table in no more partitions than its rows need, so that small ones don't cost many small tasks and files."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def pieces(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, list]]:
    """A column's values in runs of about so many bytes, with their bounds; a longer value is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, side="right")))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """This process's free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function over batches, after which a worker that lives on gives its free memory back."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Large dictionaries of words make the collector of reference cycles slow, and there are no cycles here."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
