"""What chance does to a pattern or a column: exact permutations over partitions.

A random choice of exactly n of N rows needs no shuffle of rows: chunks get their shares of n from the multivariate
hypergeometric distribution, and each chunk then chooses that many of its own rows. Both draws come from a seed,
the round and the chunk, so reruns agree, however the rows are stored.

A permuted column needs rows in another order: rows are numbered by a keyed hash, and the row at each place of one
order gets the value at that place of another. Hashes are even, so blocks of them are too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scans import cut, null_safe_join, number


def _rng(seed: int, *what) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(repr(x).encode()) for x in what)])


def chosen_sums(values: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each size the sum of that many values, chosen at random without repetition; of the smaller part, where that is what stays."""
    n, whole = len(values), values.sum()
    out = np.empty(len(sizes))
    for k, size in enumerate(sizes):
        few = min(size, n - size)
        some = values[rng.choice(n, few, replace=False, shuffle=False)].sum() if few else 0.0
        out[k] = some if few == size else whole - some
    return out


def chance_sums(df: DataFrame, by: Sequence[str], value: str, hit: str, seq: str = "seq", rounds: int = 1000, seed: int = 42, chunk_rows: int = 131_072) -> DataFrame:
    """(by, round, chosen, sum): for every round the sum of as many random rows of a key as match its pattern.

    Rows without a value are left out; one whose hit is null doesn't match. Chunks are dealt by the hash of ``seq``, of
    ``chunk_rows`` rows about, and only they and their shares, ``rounds`` numbers each, are held.
    """
    keys = df.select(*by).schema.fields
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(seq).alias("_seq"), F.col(value).cast("double").alias("_v"), F.coalesce(F.col(hit), F.lit(False)).alias("_hit"))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / chunk_rows).alias("_chunks"))
    rows = null_safe_join(rows, sizes, by).withColumn("_chunk", F.pmod(F.xxhash64("_seq"), F.col("_chunks"))).drop("_chunks")
    facts = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"), F.count_if("_hit").alias("_hits"))
    name = lambda frame: tuple(frame[k].iloc[0] for k in by)

    def share(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("_chunk", kind="stable").reset_index(drop=True)
        rng = _rng(seed, "shares", *name(chunks))
        drawn = rng.multivariate_hypergeometric(chunks["_n"].to_numpy(), int(chunks["_hits"].sum()), rounds, method="marginals")
        return chunks[[*by, "_chunk"]].assign(_shares=list(drawn.T.astype("int64")))

    shares = facts.groupBy(*by).applyInPandas(share, T.StructType([*keys, T.StructField("_chunk", T.LongType()), T.StructField("_shares", T.ArrayType(T.LongType()))]))
    result = T.StructType([*keys, T.StructField("chosen", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def draw(chunk: pa.Table, share: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("_seq", "ascending"), ("_v", "ascending")])
        sizes = np.array(share["_shares"][0].as_py())
        rng = _rng(seed, "rows", *(chunk[k][0].as_py() for k in by), chunk["_chunk"][0].as_py())
        sums = chosen_sums(chunk["_v"].to_numpy(), sizes, rng)
        return chunk.slice(0, 1).select(by).append_column("chosen", pa.array([sizes])).append_column("sums", pa.array([sums]))

    # Side by side: a join would put a copy of the shares on every row.
    drawn = rows.drop("_hit").groupBy(*by, "_chunk").cogroup(shares.groupBy(*by, "_chunk")).applyInArrow(draw, result)
    each = drawn.select(*by, F.posexplode(F.arrays_zip("chosen", "sums")).alias("round", "_x"))
    return each.groupBy(*by, "round").agg(F.sum("_x.chosen").alias("chosen"), F.sum("_x.sums").alias("sum"))


def permutation_p(df: DataFrame, by: Sequence[str], value: str, hit: str, seq: str = "seq", rounds: int = 1000, seed: int = 42, chunk_rows: int = 131_072) -> DataFrame:
    """(by, gap, p), how often the means of a random part of the pattern's size and of the rest differ as much as the pattern's.

    An empty side has mean 0.
    """
    v = F.col(value)
    matched = F.coalesce(F.col(hit), F.lit(False)) & v.isNotNull()
    mean = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    own = df.groupBy(*by).agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.count_if(matched).alias("_n1"), F.sum(F.when(matched, v)).alias("_s1"))
    gap = lambda s1: mean(s1, F.col("_n1")) - mean(F.col("_s") - s1, F.col("_n") - F.col("_n1"))
    own = own.withColumn("gap", gap(F.coalesce("_s1", F.lit(0.0))))
    x = null_safe_join(chance_sums(df, by, value, hit, seq, rounds, seed, chunk_rows), own, by).withColumn("_chance", gap(F.col("sum")))
    # Sums in another order differ in their last digits, so a split that is the pattern's own counts as equal.
    far = F.abs("_chance") >= F.abs("gap") * (1 - 1e-12)
    return x.groupBy(*by).agg(F.first("gap").alias("gap"), (F.count_if(far) / rounds).alias("p"))


def keyed_hash(*parts: Column | str) -> Column:
    """32 bits of the MD5 of parts (columns or their names) joined by colons, the same in any SQL engine."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 8), 16, 10).cast("long")


def permutation_importance(
    df: DataFrame, features: Sequence[str], predict: Callable[[Mapping[str, Column]], Column], label: str, row: str = "seq", repeats: int = 5, seed: int = 42, blocks: int = 256, unimportant: float = 0.005,
) -> DataFrame:
    """For each feature how far a model's accuracy falls when the feature's values are permuted over all rows.

    ``predict`` makes the model's answer of the features' columns. ``row`` names rows; with equal names the order of equal hashes is
    open. Returns (feature, baseline, mean_decrease, std_decrease, is_important, rank, normalised, unimportant):
    the mean and population deviation over the repeats, whether the mean is the larger, places by the mean, the
    mean over the largest one (over 0.001 at least), and whether it is small. An empty table gives no rows.
    """
    width = (1 << 32) // blocks
    known = df.select(F.col(row).alias("_row"), F.col(label).alias("_label"), *[F.col(f).alias(f"_f_{f}") for f in features])
    base = number(known.withColumn("_h", keyed_hash(F.lit(seed), "_row")), [], ("_h", "_row"), width).drop("_h", "_n")
    base = cut(base)  # both sides of the join, and the baseline
    answer = lambda columns: F.coalesce((predict(columns) == F.col("_label")).cast("double"), F.lit(0.0))
    own = {f: F.col(f"_f_{f}") for f in features}
    baseline = base.agg(F.avg(answer(own)).alias("baseline"))
    rounds = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(r).alias("_r"), F.lit(seed + r * 1000 + j + 1).alias("_seed")) for j in range(len(features)) for r in range(repeats)])
    dealt = base.withColumn("_round", F.explode(rounds)).select("*", "_round.*").drop("_round")
    values = F.coalesce(*[F.when(F.col("_j") == j, F.col(f"_f_{f}").cast("double")) for j, f in enumerate(features)])
    others = dealt.select("_j", "_r", "_row", values.alias("_other"), keyed_hash("_seed", "_row").alias("_h"))
    others = number(others, ["_j", "_r"], ("_h", "_row"), width).select("_j", "_r", "_i", "_other")
    x = dealt.join(others, ["_j", "_r", "_i"])
    swapped = {f: F.when(F.col("_j") == j, F.col("_other")).otherwise(F.col(f"_f_{f}")) for j, f in enumerate(features)}
    fallen = x.groupBy("_j", "_r").agg(F.avg(answer(swapped)).alias("_accuracy")).crossJoin(F.broadcast(baseline))  # one row
    names = F.array(*[F.lit(f) for f in features])
    drop = F.col("baseline") - F.col("_accuracy")
    out = fallen.groupBy(F.element_at(names, F.col("_j") + 1).alias("feature"), "baseline").agg(F.avg(drop).alias("mean_decrease"), F.stddev_pop(drop).alias("std_decrease"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("mean_decrease"), "feature"))  # a row a feature
    most = F.greatest(F.max("mean_decrease").over(Window.partitionBy()), F.lit(0.001))
    return out.withColumns({
        "is_important": F.col("mean_decrease") > F.col("std_decrease"), "rank": place, "normalised": F.col("mean_decrease") / most,
        "unimportant": F.col("mean_decrease") <= unimportant,
    })
