"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, its source's target over its source's
size. Expected copies are prefix-summed within the source, one random offset is added, and a
document is emitted once for every integer boundary that its interval crosses.

The prefix sum never gathers a source: documents are dealt to hash buckets of about
``rows_per_bucket`` rows; a small table of rows per (source, bucket) gives each bucket's offset, and
only the rank within a bucket needs its rows together. Within a bucket documents are ordered by
size, so that the words taken stay near the target; of equal sizes by the id's hash, the id and the text's hash, so that
the copies of different texts under one id don't depend on how rows are stored.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a
source of size 0 takes nothing; an empty table gives an empty result; repeated rows are separate
documents, and equal rows may take copies that differ by one. Columns not named are left out of the
decisions, and carried along by :func:`mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(value: Column) -> Column:
    """The first 32 bits of the MD5 of a string, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0
) -> DataFrame:
    """Targets of sources from rows (source, source_size): one row a source, so windows over it are small.

    A target is the source's weight times a common level, but at most ``max_repeat`` times its size.
    In order of size over weight, sources below the level are a prefix; the first source that isn't
    fixes the level.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    x = x.withColumn("_full", F.col("_cap") / F.col("_w"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    x = x.withColumn("_level", left / weight_left)
    x = x.withColumn("_capped", F.col("_full") < F.col("_level"))
    first = F.min(F.when(~F.col("_capped"), F.struct("_full", "_level"))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * first["_level"])
    return x.select("source", "source_size", target.alias("target"))


def _ranked(
    rows: DataFrame, facts: DataFrame, n_buckets: int, rows_per_source: DataFrame, seed: int, max_repeat: float
) -> DataFrame:
    """rows with _source, _size, _h, _id; adds source_size, target, copies."""
    bucket = (F.col("_h") % F.lit(n_buckets)).alias("_bucket")
    cells = facts.select("_source", bucket).groupBy("_source", "_bucket").count()
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    cells = cells.join(rows_per_source, cells["_source"].eqNullSafe(rows_per_source["source"])).select(
        F.col("_source").alias("_cell_source"), F.col("_bucket").alias("_cell_bucket"), "_before", "source_size", "target"
    )
    within = Window.partitionBy("_source", "_bucket").orderBy("_size", "_h", "_id", "_t")
    rows = rows.select("*", bucket).withColumn("_rank", F.row_number().over(within))
    rows = rows.join(
        cells,
        F.col("_source").eqNullSafe(F.col("_cell_source")) & (F.col("_bucket") == F.col("_cell_bucket")),
    )
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    offset = hash32(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))) / F.lit(4294967296.0)
    rank = F.col("_rank") + F.col("_before")
    crossed = F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))
    return rows.withColumn("_copies", F.least(crossed, F.lit(int(max_repeat))))


def _plan(docs: DataFrame, rows: DataFrame | None, **how) -> DataFrame:
    id_col, source_col, text_col = how["id_col"], how["source_col"], how["text_col"]
    keys = [
        docs[id_col].alias("_id"), docs[source_col].alias("_source"), word_count(docs[text_col]).alias("_size"),
        hash32(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("_h"), F.xxhash64(docs[text_col]).alias("_t"),
    ]
    facts = written(docs.select(*keys), "mix-sizes")
    sizes = facts.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, how["weights"], how["share"], how["max_repeat"])
    n_buckets = max(1, -(-facts.count() // how["rows_per_bucket"]))
    rows = facts if rows is None else rows.select(F.struct(*rows.columns).alias("_row"), *keys)
    return _ranked(rows, facts, n_buckets, targets, how["seed"], how["max_repeat"])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 20,
    rows_per_bucket: int = 8192,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its size in words, its source's size and target, its copies and words taken."""
    x = _plan(docs, None, weights=weights, share=share, max_repeat=max_repeat, seed=seed, rows_per_bucket=rows_per_bucket, id_col=id_col, source_col=source_col, text_col=text_col)
    return x.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target",
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 20,
    rows_per_bucket: int = 8192,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    x = _plan(docs, docs, weights=weights, share=share, max_repeat=max_repeat, seed=seed, rows_per_bucket=rows_per_bucket, id_col=id_col, source_col=source_col, text_col=text_col)
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return x.filter(F.col("_copies") > 0).select("_row", again).select("_row.*")
