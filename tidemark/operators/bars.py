"""Time buckets and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket(ts: Column, width_ms: int, mode: str = "floor") -> Column:
    """The bucket's first millisecond; ``round`` centres buckets on multiples, half to even."""
    if mode == "floor":
        return (ts - F.pmod(ts, F.lit(width_ms))).cast("long")
    if mode == "round":
        return (F.rint(ts / F.lit(float(width_ms))) * width_ms).cast("long")
    raise ValueError(f"unknown mode {mode!r}")


def ohlcv(df: DataFrame, width_ms: int, price: str = "price", volume: Column | None = None, by: tuple[str, ...] = ("symbol",), mode: str = "floor") -> DataFrame:
    """Open, high, low, close, volume and count of each bucket; ties in time are ordered by seq."""
    at = F.struct("ts_event", "seq")
    return df.groupBy(*by, bucket(F.col("ts_event"), width_ms, mode).alias("bucket")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(volume if volume is not None else F.lit(1.0)).alias("volume"), F.count("*").alias("trade_count"),
    )


def rebucket(bars: DataFrame, fine_ms: int, coarse_ms: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars from bars; a width that isn't a larger multiple is refused."""
    if coarse_ms <= fine_ms or coarse_ms % fine_ms:
        raise ValueError(f"can't make bars of {coarse_ms} ms from bars of {fine_ms} ms")
    return bars.groupBy(*by, bucket(F.col("bucket"), coarse_ms).alias("_b")).agg(
        F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
    ).withColumnRenamed("_b", "bucket")


def resample(df: DataFrame, width_ms: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return df.groupBy(*by, bucket(F.col("ts_event"), width_ms).alias("bucket")).agg(
        F.max_by("price", F.struct("ts_event", "seq")).alias("last"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("deviation"), F.count("*").alias("n")
    )


def spread_bars(q: DataFrame, width_ms: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    s = F.col("ask_price") - F.col("bid_price")
    return q.groupBy(*by, bucket(F.col("ts_event"), width_ms).alias("bucket")).agg(
        F.avg(s).alias("avg_spread"), F.min(s).alias("min_spread"), F.max(s).alias("max_spread"), (F.avg(s / F.col("mid")) * 100).alias("avg_spread_pct")
    )


def imbalance_bars(q: DataFrame, width_ms: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return q.groupBy(*by, bucket(F.col("ts_event"), width_ms).alias("bucket")).agg(
        F.sum("bid_qty").alias("bid_qty"), F.sum("ask_qty").alias("ask_qty"), (F.sum("bid_qty") - F.sum("ask_qty")).alias("difference"), F.count("*").alias("n")
    )


def last_of_slot(df: DataFrame, width_ms: int, values: list[str]) -> DataFrame:
    """The last row of each symbol in each slot."""
    last = F.max(F.struct("ts_event", "seq", *values)).alias("_l")
    return df.groupBy(F.floor(F.col("ts_event") / width_ms).alias("slot"), "symbol").agg(last).select("slot", "symbol", "_l.*")


def _rows(by: list[str], n: int):
    return Window.partitionBy(*by).orderBy("bucket").rowsBetween(1 - n, 0)


def bar_volatility(bars: DataFrame, n: int, by: list[str]) -> DataFrame:
    last = F.lag("close").over(Window.partitionBy(*by).orderBy("bucket"))
    x = bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))
    w = _rows(by, n)
    mid, dev = F.avg("close").over(w), F.stddev_samp("close").over(w)
    return x.withColumns({"atr": F.avg("true_range").over(w), "bb_mid": mid, "bb_upper": mid + 2 * dev, "bb_lower": mid - 2 * dev})


def bar_momentum(bars: DataFrame, n: int, by: list[str]) -> DataFrame:
    """No loss gives no RSI here."""
    o = Window.partitionBy(*by).orderBy("bucket")
    change = F.coalesce(F.col("close") - F.lag("close").over(o), F.lit(0.0))
    x = bars.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0)), "_old": F.lag("close", n).over(o)})
    up, down = F.avg("_up").over(_rows(by, n)), F.avg("_down").over(_rows(by, n))
    return x.withColumns({
        "rsi": 100 - 100 / (1 + F.try_divide(up, down)), "macd": F.avg("close").over(_rows(by, 12)) - F.avg("close").over(_rows(by, 26)),
        "momentum": F.col("close") - F.col("_old"), "roc": F.try_divide(F.col("close") - F.col("_old"), "_old") * 100,
    }).drop("_up", "_down", "_old")


def bar_volume(bars: DataFrame, n: int, by: list[str]) -> DataFrame:
    o = Window.partitionBy(*by).orderBy("bucket")
    money = F.col("close") * F.col("volume")
    vwap = lambda w: F.try_divide(F.sum(money).over(w), F.sum("volume").over(w))
    return bars.withColumns({
        "hl_spread": F.col("high") - F.col("low"), "vwap": vwap(o), "rolling_vwap": vwap(_rows(by, n)), "dollar_volume": money,
        "volume_delta": F.col("volume") - F.lag("volume").over(o),
    })
