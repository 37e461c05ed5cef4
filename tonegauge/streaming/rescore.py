"""Scores for threads that grow: each batch of new messages rescores the threads it touches.

Scoring a message needs the thread's earlier messages, so the store keeps messages
in buckets by a hash of the thread; a micro-batch reads only the buckets of the threads
it touches and writes these threads' rows. Of a message that comes again (same thread
and ord) the row of the latest batch counts. A batch that is run again writes the same
rows to the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.score import MESSAGES, score_threads


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON files of messages."""
    return spark.readStream.schema(MESSAGES).json(path)


def start(messages: DataFrame, history: str, results: str, checkpoint: str, business_day_end: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append messages to ``history`` and write the touched threads' scores to ``results/batch=N`` (parquet)."""
    return messages.writeStream.foreachBatch(_batch(history, results, business_day_end)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Buckets of the history and the results; a batch's file count, and the share of the history that one thread's batch reads.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("thread_id"), F.lit(BUCKETS)).cast("int")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one of the latest batch (of several there, the largest in all columns)."""
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    order = F.struct("batch", F.xxhash64(*[F.to_json(F.struct(*others))]))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("row")).select(*keys, "row.*")


def _batch(history: str, results: str, business_day_end: str | None) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/batch={number}")
        new = spark.read.parquet(f"{history}/batch={number}")
        touched = new.select("thread_id").distinct()
        buckets = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if not buckets:
            return
        known = spark.read.option("basePath", history).parquet(f"{history}/batch=*").where((F.col("batch") <= number) & F.col("bucket").isin(buckets)).drop("bucket")
        threads = _newest(known.join(touched, "thread_id", "left_semi"), ["thread_id", "ord"])
        scored = score_threads(threads, business_day_end).withColumn("bucket", _bucket())
        scored.write.mode("overwrite").partitionBy("bucket").parquet(f"{results}/batch={number}")

    return run


def latest(spark: SparkSession, results: str, threads: list[str] | None = None) -> DataFrame:
    """Each message's newest scores; of some threads alone, only their buckets are read."""
    d = spark.read.option("basePath", results).parquet(f"{results}/batch=*")
    if threads is not None:
        wanted = spark.createDataFrame([(t,) for t in threads], "thread_id string")
        d = d.where(F.col("bucket").isin([r[0] for r in wanted.select(_bucket()).distinct().collect()])).join(F.broadcast(wanted), "thread_id", "left_semi")
    newest = d.groupBy("thread_id").agg(F.max("batch").alias("batch"))
    return d.join(newest, ["thread_id", "batch"]).drop("batch", "bucket")
