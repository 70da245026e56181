"""Incremental resume as a stream: files of rows arrive, keys that have a row already are left out, the rest is appended.

What has been seen is the state of a streaming aggregation, one small record per key in the state store: a batch reads and writes the
state of its own keys, not what earlier batches have put out.  All rows of a batch carry the batch's time, so a key whose first and
last time are the same is new.  Each micro-batch is written into its own folder, named by its number, so a batch that is played again
after a failure replaces itself.

Defined results: a key that comes twice within a batch keeps its row with the smallest order; null keys are a key; no file, no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import fresh_path


def take_up(spark: SparkSession, source: str, target: str, schema, keys: list[str], order: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Run all that is available of a stream of Parquet files into ``target``."""
    names = [f.name for f in schema]
    rest = [order, *[c for c in names if c not in (*keys, order)]]

    def batch(rows: DataFrame, number: int) -> None:
        new = rows.where(F.col("_first") == F.col("_last")).select(*keys, "_row.*").select(*names)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).withColumn("_at", F.current_timestamp())
    seen = stream.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min(F.struct(*rest)).alias("_row"))
    query = seen.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def replay_batches(spark: SparkSession, rows: DataFrame, keys: list[str], order: str, files: int = 2) -> DataFrame:
    """Feed a table as a stream of so many arrivals, each a range of ``order``, and read back what was taken up."""
    source, target, state = (fresh_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows
    step = (high - low) // files + 1
    for k in range(files):
        rows.where((F.col(order) >= low + k * step) & (F.col(order) < low + (k + 1) * step)).write.mode("append").parquet(source)
        take_up(spark, source, target, rows.schema, keys, order, state, files_per_batch=1_000)
    return spark.read.schema(rows.schema).parquet(target).select(*rows.columns)
