"""Ledgers as idempotent sinks: a batch that is replayed after a failure changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.slices import first_new


def merge_batch(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Writes a batch's first row of each key that no earlier batch has, and how many rows were inserted and skipped.

    A batch has a folder of its own below rows and counts, and looks at earlier ones only, so writing it again gives the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = f"{path}/rows"
        there = spark.read.parquet(rows).filter(F.col("batch") < number) if number else batch.limit(0)
        first_new(there, batch, keys, order).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        written = spark.read.parquet(f"{rows}/batch={number}").agg(F.count("*").alias("inserted"))
        counts = written.join(batch.agg(F.count("*").alias("_n"))).select("inserted", (F.col("_n") - F.col("inserted")).alias("skipped"))  # a row each
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return merge


def fingerprinted(df: DataFrame) -> DataFrame:
    """Adds the hash of a row's content, as the key of a ledger without other keys."""
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256))


def ledger(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """A stream's rows merged below ``path``; read ``rows`` and ``counts`` there."""
    return df.writeStream.foreachBatch(merge_batch(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
