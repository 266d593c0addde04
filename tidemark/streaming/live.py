"""Live forms of the batch operators, on Structured Streaming.

Sources are ordered within a key; ``lateness`` bounds how far behind a row may come. Each function takes
and returns a streaming DataFrame; run on all rows at once they give the batch operators' rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollups import quality

SIGNALS = ("dropped", "queue_pct", "reconnects", "drain_s", "primary_offline_s", "max_offline_s", "primary_eps")

TICK_SCHEMA = "ts_event long, seq long, symbol long, stream string, price double, qty double"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Typed ticks from a folder of Parquet files; the rate limit takes the place of dropping under pressure."""
    return spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_time(df: DataFrame, lateness: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis("ts_event")).withWatermark("event_time", lateness)


def last_of_slot(df: DataFrame, width_ms: int, lateness: str = "1 minute") -> DataFrame:
    """The last row of each symbol in each slot, once the watermark has passed it."""
    x = with_time(df, lateness).groupBy(F.window("event_time", f"{width_ms} milliseconds"), "symbol").agg(F.max(F.struct("ts_event", "seq", "price")).alias("_l"))
    return x.select(F.floor(F.unix_millis("window.start") / width_ms).alias("slot"), "symbol", "_l.*")


def quality_windows(df: DataFrame, width: str = "15 minutes", lateness: str = "1 minute") -> DataFrame:
    """T4: counts and peaks of each window."""
    x = with_time(df, lateness).groupBy(F.window("event_time", width), "stream").agg(F.count("*").alias("n"), F.max("price").alias("peak"))
    return x.select(F.unix_millis("window.start").alias("start"), "stream", "n", "peak")


def silence_counts(df: DataFrame, by: Sequence[str], silence: str = "30 seconds", width: str = "15 minutes", slide: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """T4: (by, start, end, silences): how often a source fell silent within each sliding window, without windows of none.

    A source is silent once ``silence`` has passed since its last row, so its sessions end where silences begin; these ends are counted
    by a second window behind the first. The watermark closes both, and drops their state. A source that has not come back is silent too.
    """
    s = with_time(df, lateness).groupBy(F.session_window("event_time", silence).alias("session"), *by).agg(F.count("*").alias("_n"))
    x = s.groupBy(F.window(F.window_time("session"), width, slide).alias("_w"), *by).agg(F.count("*").alias("silences"))
    return x.select(*by, F.unix_millis("_w.start").alias("start"), F.unix_millis("_w.end").alias("end"), "silences")


def graded_windows(df: DataFrame, by: Sequence[str], signals: Mapping[str, Column], width: str = "15 minutes", lateness: str = "1 minute") -> DataFrame:
    """T4: (by, start, n, quality, reasons) of each tumbling window, once the watermark has passed it.

    ``signals`` are aggregates by the names that :func:`tidemark.operators.rollups.quality` takes; those that are missing
    count as it says for absent ones. The grade is the batch form's own rule, so that both agree on the same rows.
    """
    unknown = set(signals) - set(SIGNALS)
    if unknown:
        raise ValueError(f"no signal {sorted(unknown)}")
    x = with_time(df, lateness).groupBy(F.window("event_time", width).alias("_w"), *by).agg(F.count("*").alias("n"), *[c.alias(f"_{name}") for name, c in signals.items()])
    grade, why = quality(*[F.col(f"_{name}") if name in signals else F.lit(None).cast("double") for name in SIGNALS])
    return x.select(*by, F.unix_millis("_w.start").alias("start"), "n", grade.alias("quality"), why.alias("reasons"))


def without_repeats(df: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """A repeated (ts_event, seq) within the watermark comes once."""
    return with_time(df, lateness).dropDuplicatesWithinWatermark(["ts_event", "seq"]).drop("event_time")


def _stateful(df: DataFrame, by: Sequence[str], out: str, state: str, step) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts_event", "seq"], kind="stable")
        found, now = step(rows, held.get if held.exists else None)
        held.update(now)
        yield found

    return df.groupBy(*by).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


#: Groups of symbols whose states lie together: a call to Python costs milliseconds, and a symbol has few rows a batch.
BUCKETS = 512


def _by_symbol(df: DataFrame, out: str, step: Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], tuple[pd.DataFrame, np.ndarray]]) -> DataFrame:
    """A step over the rows of many symbols, each in order, with one number of state a symbol.

    The step gets the rows, where a symbol's begin and end, and the symbols' numbers (NaN for a new one); it gives rows and the numbers after them.
    Symbols without a name are one symbol, in a bucket of its own.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        name = rows["symbol"].fillna(0).to_numpy("int64")
        order = np.lexsort((rows["seq"].to_numpy(), rows["ts_event"].to_numpy(), name))
        rows, name = rows.iloc[order].reset_index(drop=True), name[order]
        edge = name[1:] != name[:-1]
        first, last = np.r_[True, edge], np.r_[edge, True]
        names, numbers = (np.frombuffer(x, t) for x, t in zip(held.get if held.exists else (b"", b""), ("int64", "float64"), strict=True))
        own = name[first]
        known = np.isin(own, names)
        before = np.full(len(own), np.nan)
        before[known] = numbers[np.searchsorted(names, own[known])]
        found, now = step(rows, first, last, before)
        quiet = ~np.isin(names, own)
        names, numbers = np.r_[names[quiet], own], np.r_[numbers[quiet], now]
        order = np.argsort(names)
        held.update((names[order].tobytes(), numbers[order].astype("float64").tobytes()))
        yield found

    bucket = F.when(F.col("symbol").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)))
    return df.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(run, out, "names binary, numbers binary", "append", GroupStateTimeout.NoTimeout)


def numbered(df: DataFrame) -> DataFrame:
    """T5: a sequence number per symbol, from 1, and the time in nanoseconds."""

    def step(rows: pd.DataFrame, first: np.ndarray, last: np.ndarray, before: np.ndarray):
        at, key = np.arange(1, len(rows) + 1), np.cumsum(first) - 1
        number = at - np.flatnonzero(first)[key] + np.nan_to_num(before).astype("int64")[key]
        return rows[["symbol", "ts_event", "seq"]].assign(number=number, ts_ns=rows["ts_event"] * 1_000_000), number[last]

    return _by_symbol(df, "symbol long, ts_event long, seq long, number long, ts_ns long", step)


def changed(df: DataFrame) -> DataFrame:
    """A symbol's row only where its price differs from the one before."""

    def step(rows: pd.DataFrame, first: np.ndarray, last: np.ndarray, before: np.ndarray):
        price = rows["price"].to_numpy("float64")
        earlier = np.r_[np.nan, price[:-1]]
        earlier[first] = before
        return rows.loc[price != earlier, ["symbol", "ts_event", "seq", "price"]], price[last]

    return _by_symbol(df, "symbol long, ts_event long, seq long, price double", step)


def live_ema(df: DataFrame, n: int = 14) -> DataFrame:
    """The recursive average of price by stream, null until n rows have come."""
    alpha = 2.0 / (n + 1)

    def step(rows: pd.DataFrame, held):
        value, count = held or (None, 0)
        out = []
        for p in rows["price"]:
            value, count = p if value is None else value + alpha * (p - value), count + 1
            out.append(value if count >= n else None)
        return rows[["stream", "ts_event", "seq"]].assign(ema=pd.Series(out, rows.index, dtype="float64")), (float(value), count)

    return _stateful(df, ["stream"], "stream string, ts_event long, seq long, ema double", "value double, n long", step)


def heartbeats(df: DataFrame, silence: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    """Sessions of a stream without a longer silence; their ends are where a source goes offline."""
    x = with_time(df, lateness).groupBy(F.session_window("event_time", silence), "stream").agg(F.count("*").alias("n"))
    return x.select("stream", F.unix_millis("session_window.start").alias("first_ms"), F.unix_millis("session_window.end").alias("offline_at_ms"), "n")


def spool(df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("stream",)):
    """K1: files partitioned by key, committed atomically, resumed from the checkpoint."""
    return df.writeStream.partitionBy(*by).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")
