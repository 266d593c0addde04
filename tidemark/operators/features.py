"""Rolling features of a quote stream.

A feature is null until its window holds exactly its number of values, and standard deviations are of
the population. Windows are rows within a group in the order (ts_event, seq). Where a feature leaves
values out (null returns, spreads that aren't positive), its window goes by the running count of those that
are known, so nothing is joined back. Recursive averages run in groups, vectorised, in the group's order.
A group may be a block of a key (see ``scans.in_blocks``), which is how a key with most rows is spread.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scans import null_safe_join, window_sums
from .temporal import asof_each

ORDER = ("ts_event", "seq")
STABILITY = {"volatility_ratio": 0.4, "trend_strength": 0.4, "spread_ratio": 0.2}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def ordered(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*ORDER)


def full(value: Column, over: Column, n: int, by: Sequence[str]) -> Column:
    """An aggregate ``over`` the last n rows, null where there are fewer or where a value is null."""
    w = ordered(by).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, over.over(w))


def with_returns(q: DataFrame, by: Sequence[str]) -> DataFrame:
    """The relative change of mid, null at the start and after a mid that isn't positive."""
    last = F.lag("mid").over(ordered(by))
    return q.withColumn("return_1", F.when(last > 0, (F.col("mid") - last) / last))


def stateless(q: DataFrame) -> DataFrame:
    """W1, W2, W15 and the size imbalance."""
    total = F.col("bid_qty") + F.col("ask_qty")
    micro = (F.col("bid_price") * F.col("ask_qty") + F.col("ask_price") * F.col("bid_qty")) / total
    return q.withColumns({
        "mid_price": F.col("mid"), "spread": F.col("ask_price") - F.col("bid_price"),
        "microprice": F.when(total == 0, F.col("mid")).otherwise(micro),
        "imbalance": F.when(total != 0, (F.col("bid_qty") - F.col("ask_qty")) / total),
    })


def last_known(q: DataFrame, by: Sequence[str], value: Column, columns: Callable[[Callable[[Column, int], Column]], dict[str, Column]]) -> DataFrame:
    """Adds columns over the last n rows where ``value`` is known, null elsewhere and until there are n.

    ``columns`` gets a function of an aggregate of _v (the value) and n.
    """
    x = q.withColumn("_v", value)
    x = x.withColumn("_k", F.count("_v").over(ordered(by)))

    def over(aggregate: Column, n: int) -> Column:
        w = Window.partitionBy(*by).orderBy("_k").rangeBetween(1 - n, 0)
        return F.when(F.col("_v").isNotNull() & (F.col("_k") >= n), aggregate.over(w))

    return x.withColumns(columns(over)).drop("_v", "_k")


def volatility(q: DataFrame, by: Sequence[str], n: int = 20, name: str = "volatility") -> DataFrame:
    """Deviation of the last n returns that aren't null."""
    return last_known(q, by, F.col("return_1"), lambda over: {name: over(F.stddev_pop("_v"), n)})


def rsi(q: DataFrame, by: Sequence[str], n: int = 14) -> DataFrame:
    """Simple averages of gains and losses; 100 without losses, then 0 without gains."""
    change = F.col("mid") - F.lag("mid").over(ordered(by))
    x = q.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0)), "_known": change})
    x = x.withColumns({"_up": F.when(F.col("_known").isNotNull(), F.col("_up")), "_down": F.when(F.col("_known").isNotNull(), F.col("_down"))})
    up, down = full(F.col("_up"), F.avg("_up"), n, by), full(F.col("_down"), F.avg("_down"), n, by)
    x = x.withColumns({"_gain": up, "_loss": down})
    value = F.when(F.col("_loss") == 0, 100.0).when(F.col("_gain") == 0, 0.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide("_gain", "_loss")))
    return x.withColumn("rsi", F.when(F.col("_gain").isNotNull(), value)).drop("_up", "_down", "_known", "_gain", "_loss")


def atr(q: DataFrame, by: Sequence[str], n: int = 14) -> DataFrame:
    """Average of the larger of spread and the move of mid."""
    move = F.abs(F.col("mid") - F.lag("mid").over(ordered(by)))
    x = q.withColumn("_tr", F.when(move.isNotNull(), F.greatest(F.col("ask_price") - F.col("bid_price"), move)))
    return x.withColumn("atr", full(F.col("_tr"), F.avg("_tr"), n, by)).drop("_tr")


def roc(q: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """Percent change over n rows."""
    old = F.lag("mid", n).over(ordered(by))
    return q.withColumn("roc", F.when(old > 0, (F.col("mid") - old) / old * 100))


def volatility_regime(q: DataFrame, by: Sequence[str], short: int = 20, long: int = 100) -> DataFrame:
    """The ratio of short to long deviation of returns, clamped to [0, 5] (1 where the long one is
    0), and its class: 0 below a half, 2 above 2, else 1."""
    x = last_known(q, by, F.col("return_1"), lambda over: {"_short": over(F.stddev_pop("_v"), short), "_long": over(F.stddev_pop("_v"), long)})
    ratio = F.when(F.col("_long") == 0, 1.0).otherwise(F.try_divide("_short", "_long"))
    ratio = F.when(F.col("_long").isNotNull(), ratio)
    regime = F.when(ratio < 0.5, 0).when(ratio > 2, 2).when(ratio.isNotNull(), 1)
    return x.withColumns({"volatility_ratio": clamp(ratio, 0, 5), "regime_volatility": regime}).drop("_short", "_long")


def spread_ratio(q: DataFrame, by: Sequence[str], n: int = 100) -> DataFrame:
    """The spread over its mean of the last n positive ones, clamped to [0, 5], and its class."""
    width = F.col("ask_price") - F.col("bid_price")
    x = last_known(q, by, F.when(width > 0, width), lambda over: {"_r": F.col("_v") / over(F.avg("_v"), n)})
    regime = F.when(F.col("_r") < 0.5, 0).when(F.col("_r") > 2, 2).when(F.col("_r").isNotNull(), 1)
    return x.withColumns({"spread_ratio": clamp(F.col("_r"), 0, 5), "regime_spread": regime}).drop("_r")


def bollinger_position(q: DataFrame, by: Sequence[str], n: int = 20, k: float = 2.0) -> DataFrame:
    """Where mid stands between its bands, in [0, 1]; one half where they meet."""
    x = q.withColumns({"_m": full(F.col("mid"), F.avg("mid"), n, by), "_d": full(F.col("mid"), F.stddev_pop("mid"), n, by)})
    at = F.try_divide(F.col("mid") - F.col("_m") + k * F.col("_d"), 2 * k * F.col("_d"))
    value = F.when(F.col("_d") == 0, 0.5).otherwise(clamp(at, 0, 1))
    return x.withColumn("bollinger_pos", F.when(F.col("_d").isNotNull(), value)).drop("_m", "_d")


def return_momentum(q: DataFrame, by: Sequence[str], n: int = 20, weighted: bool = True) -> DataFrame:
    """The sum of the last n returns, or of their signs, over the sum of their sizes, 0 where all are 0."""
    move = F.col("return_1") if weighted else F.signum("return_1")
    x = last_known(q, by, move, lambda over: {"_s": over(F.sum("_v"), n), "_a": over(F.sum(F.abs("_v")), n)})
    value = F.when(F.col("_a") == 0, 0.0).otherwise(F.try_divide("_s", "_a"))
    return x.withColumn("return_momentum", F.when(F.col("_a").isNotNull(), value)).drop("_s", "_a")


def micro_reversion(q: DataFrame, by: Sequence[str], n: int = 50) -> DataFrame:
    """The mean of 1 for a change of sign of consecutive returns, 0 for the same sign, one half where one is 0."""
    before = F.last("return_1", ignorenulls=True).over(ordered(by).rowsBetween(Window.unboundedPreceding, -1))
    flip = F.signum("return_1") * F.signum(before)
    flipped = F.when(flip < 0, 1.0).when(flip > 0, 0.0).when(flip.isNotNull(), 0.5)
    return last_known(q, by, flipped, lambda over: {"micro_reversion": over(F.avg("_v"), n)})


def quote_intensity(q: DataFrame, by: Sequence[str], n: int = 20, ranks: int = 200) -> DataFrame:
    """Events a second over n events, as the share of the last ``ranks`` values that are no larger.

    A span that isn't positive gives null and takes no place among the values.
    """
    span = F.col("ts_event") - F.lag("ts_event", n - 1).over(ordered(by))
    x = last_known(q, by, F.when(span > 0, n / (span / 1000.0)), lambda over: {"_last": over(F.collect_list("_v"), ranks), "_rate": F.col("_v")})
    return x.withColumn("quote_intensity", F.size(_no_larger(F.col("_last"), F.col("_rate"))) / F.lit(float(ranks))).withColumn(
        "quote_intensity", F.when(F.col("_last").isNotNull(), F.col("quote_intensity"))
    ).drop("_last", "_rate")


def _all_known(names: Sequence[str]) -> Column:
    """True where all are known, else null."""
    return F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in names]), lambda c: c), True)


def regime_stability(q: DataFrame, by: Sequence[str], n: int = 100, parts: Mapping[str, float] = STABILITY) -> DataFrame:
    """A weighted mean of 1 - min(variance / 0.67, 1) of the named columns over n rows where all are known."""

    def columns(over: Callable) -> dict[str, Column]:
        steady = lambda c: 1 - F.least(over(F.var_pop(F.when(F.col("_v"), F.col(c))), n) / 0.67, F.lit(1.0))
        total = sum((w * steady(c) for c, w in parts.items()), F.lit(0.0))
        return {"regime_stability": F.when(over(F.count("_v"), n).isNotNull(), total)}

    return last_known(q, by, _all_known(list(parts)), columns)


def _no_larger(values: Column, than: Column) -> Column:
    return F.filter(values, lambda v: v <= than)


def behavior_divergence(q: DataFrame, by: Sequence[str]) -> DataFrame:
    """W26."""
    return q.withColumn("behavior_divergence", (F.col("return_momentum") - F.col("liquidity_pressure")) / 2)


def compression_score(q: DataFrame, by: Sequence[str], n: int = 50, regime: float = 0.4, spread: float = 0.3, low: float = 0.3) -> DataFrame:
    """A low volatility ratio, a narrowing spread, and how few of the last n volatilities are no larger, of rows where all three are known."""
    parts = ("volatility_ratio", "spread_compression", "volatility")
    x = last_known(q, by, _all_known(parts), lambda over: {"_last": over(F.collect_list(F.when(F.col("_v"), F.col("volatility"))), n)})
    rank = F.size(_no_larger(F.col("_last"), F.col("volatility"))) / F.lit(float(n))
    score = regime * clamp(2 - F.col("volatility_ratio"), 0, 1) + spread * (F.col("spread_compression") + 1) / 2 + low * (1 - rank)
    return x.withColumn("volatility_compression_score", F.when(F.col("_last").isNotNull(), score)).drop("_last")


def baseline_actions(q: DataFrame, by: Sequence[str], threshold: float, max_bps: float) -> DataFrame:
    """Adds position (held before the row: 1, 0, -1), action, reason and confidence of the momentum baseline.

    Rows have mid_price, spread and return_1. A wide spread does nothing; momentum beyond the threshold enters from flat and leaves the other side.
    The position needs no row by row fold: two like signals in a row, or the first one, fix a side; until the next such pair, signals of that side
    hold it and others leave it. So it follows from the last signal and the last that fixed a side. Unknown returns signal nothing.
    """
    o = ordered(by)
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    wide = F.coalesce(F.col("spread") / F.col("mid_price") * 10_000 > max_bps, F.lit(False))
    signal = F.when(~wide & (F.col("return_1") > threshold), 1).when(~wide & (F.col("return_1") < -threshold), -1)
    x = q.withColumns({"_wide": wide, "_sig": signal}).withColumn("_was", F.last("_sig", ignorenulls=True).over(before))
    x = x.withColumn("_fixed", F.when(F.col("_was").isNull() | (F.col("_was") == F.col("_sig")), F.col("_sig")))
    x = x.withColumn("_side", F.last("_fixed", ignorenulls=True).over(before))
    sig, size = F.col("_sig"), F.least(F.lit(1.0), F.abs("return_1") / threshold)
    x = x.withColumn("position", F.when(F.col("_side") == F.col("_was"), F.col("_side")).otherwise(0))
    held = F.col("position")
    acts = F.coalesce(sig != held, F.lit(False))  # a signal of the side that is held changes nothing
    action = F.when(acts & (held == 1), "EXIT_LONG").when(acts & (held == -1), "EXIT_SHORT").when(acts & (sig == 1), "LONG").when(acts, "SHORT").otherwise("FLAT")
    reason = F.when(F.col("_wide"), "spread_too_wide").when(acts & (held != 0), "momentum_reversal").when(held == 1, "holding_long").when(held == -1, "holding_short").when(sig == 1, "positive_momentum")
    reason = reason.when(sig == -1, "negative_momentum").otherwise("no_signal")
    return x.withColumns({"action": action, "reason": reason, "confidence": F.when(acts, size)}).drop("_wide", "_sig", "_was", "_fixed", "_side")


def recursive(q: DataFrame, by: Sequence[str], names: Sequence[str], fold: Callable[[pd.DataFrame], dict[str, pd.Series]]) -> DataFrame:
    """Adds columns that a fold computes from a group in order; groups are the unit of recursion, such as a symbol's day."""
    from pyspark.sql import types as T

    schema = T.StructType([*q.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(ORDER), kind="stable").reset_index(drop=True)
        return group.assign(**fold(group))[[f.name for f in schema]]

    return q.groupBy(*by).applyInPandas(run, schema)


def ema(x: pd.Series, alpha: float, count: int = 1) -> pd.Series:
    """Seeded by the first value; null where fewer than ``count`` values have come. Nulls leave the state as it is."""
    known = x.dropna()
    out = known.ewm(alpha=alpha, adjust=False).mean()
    out.iloc[: count - 1] = float("nan")
    return out.reindex(x.index)


def span(n: int) -> float:
    return 2.0 / (n + 1)


def trend_fold(g: pd.DataFrame) -> dict[str, pd.Series]:
    """Averages of mid, their slope, and the strength and class of the trend."""
    import numpy as np

    mid = g["mid"]
    e14, fast, slow = ema(mid, span(14), 14), ema(mid, span(10), 10), ema(mid, span(30), 30)
    raw14, raw_fast = ema(mid, span(14)), ema(mid, span(10))
    slope = (e14 - raw14.shift(5)) / 5
    slope[: 18] = float("nan")
    sep = (fast - slow) / slow
    rise = (raw_fast - raw_fast.shift(4)) / raw_fast.shift(4)
    strength = np.tanh(100 * (0.7 * sep + 0.3 * rise)).where(mid.notna().cumsum() >= 35)
    move = fast - raw_fast.shift(1)
    regime = pd.Series(np.where((fast > slow) & (move > 1e-4), 1.0, np.where((fast < slow) & (move < -1e-4), -1.0, 0.0)), mid.index).where(slow.notna())
    return {"ema": e14, "ema_slope": slope, "trend_strength": strength, "regime_trend": regime}


def imbalance_fold(g: pd.DataFrame) -> dict[str, pd.Series]:
    """Averages of imbalance, of spread, and the acceleration of the first."""
    import numpy as np

    x, spread = g["imbalance"], g["spread"]
    smooth = ema(x, span(10))
    change = ema(smooth - smooth.shift(1), span(5))
    short, long = ema(spread, span(10), 10), ema(spread, span(50), 50)
    return {
        "imbalance_ema": ema(x, span(20), 20), "liquidity_pressure": ema(x, span(10), 10),
        "spread_compression": (1 - short / long).clip(-1, 1), "imbalance_acceleration": np.tanh(100 * change).where(x.notna().cumsum() >= 15),
    }


def complete(q: DataFrame, enabled: Sequence[str]) -> DataFrame:
    """The vector rule: a row leaves only when every enabled feature is known."""
    return q.dropna(subset=list(enabled))


def model_features(df: DataFrame, by: Sequence[str], unit_ms: int = 1000, horizons: Sequence[int] = (1, 5, 10, 30), window: int = 10, ahead: int = 10, warm_up: int = 30) -> DataFrame:
    """Log returns over some horizons (in units, against the last row at or before), volatility, imbalance, microprice and label.

    Volatility: population deviation of the first horizon's returns from ``window`` units back up to the row
    itself in the order (ts_event, seq), of two values at least. Label: whether the first mid at or after
    ``ahead`` units is higher. Rows in the first ``warm_up`` units of a group, or with any value missing, are left out.
    """
    q = df.select(*by, "ts_event", "seq", "mid", "bid_price", "ask_price", "bid_qty", "ask_qty")
    base = q.select(*by, "ts_event", "seq", "mid")
    x = asof_each(q, base, by, "mid", {f"_p{h}": -h * unit_ms for h in horizons})
    x = asof_each(x, base, by, "mid", {"_next": ahead * unit_ms}, True)
    names = [f"log_return_{h}" for h in horizons]
    x = x.withColumns({n: F.log(F.col("mid") / F.col(f"_p{h}")) for n, h in zip(names, horizons, strict=True)})
    same = Window.partitionBy(*by, "ts_event").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(names[0])

    parts = {"_c": F.when(r.isNotNull(), 1.0), "_s": r, "_q": r * r}
    earlier = window_sums(x.select(*by, "ts_event", *[c.alias(k) for k, c in parts.items()]), by, {k: F.sum(k) for k in parts}, {f"_early{k}": (k, -window * unit_ms, -1) for k in parts})
    x = null_safe_join(x, earlier.drop(*parts), [*by, "ts_event"])
    n, s, s2 = (F.coalesce(F.col(f"_early{k}"), F.lit(0.0)) + F.coalesce(F.sum(c).over(same), F.lit(0.0)) for k, c in parts.items())
    size = F.col("bid_qty") + F.col("ask_qty")
    x = x.withColumns({
        "volatility": F.when(n >= 2, F.sqrt(F.greatest(s2 / n - (s / n) * (s / n), F.lit(0.0)))),
        "imbalance": F.try_divide(F.col("bid_qty") - F.col("ask_qty"), size),
        "microprice": F.try_divide(F.col("bid_price") * F.col("ask_qty") + F.col("ask_price") * F.col("bid_qty"), size),
        "label": (F.col("_next") > F.col("mid")).cast("int"),
        "_first": F.min("ts_event").over(Window.partitionBy(*by)),
    })
    kept = [*names, "volatility", "imbalance", "microprice", "label"]
    return x.filter(F.col("ts_event") >= F.col("_first") + warm_up * unit_ms).select(*by, "ts_event", "seq", *kept).dropna(subset=kept)


def live_features(df: DataFrame, by: Sequence[str], unit_ms: int = 1000) -> DataFrame:
    """Log returns over one and five units, imbalance, and the number of earlier rows less than or exactly one unit ago; eight places, null is 0."""
    x = asof_each(df, df.select(*by, "ts_event", "seq", "mid"), by, "mid", {"_p1": -unit_ms, "_p5": -5 * unit_ms})
    earlier = window_sums(x, by, {"_n": F.count("*")}, {"_early": ("_n", -unit_ms, -1)}).drop("_n")
    x = null_safe_join(x, earlier, [*by, "ts_event"])
    same = F.row_number().over(Window.partitionBy(*by, "ts_event").orderBy("seq")) - 1
    values = {f"f_log_return_{h}": F.log(F.col("mid") / F.col(f"_p{h}")) for h in (1, 5)}
    values["f_imbalance"] = F.try_divide(F.col("bid_qty") - F.col("ask_qty"), F.col("bid_qty") + F.col("ask_qty"))
    x = x.withColumns({n: F.coalesce(F.round(v, 8), F.lit(0.0)) + 0.0 for n, v in values.items()})
    return x.withColumn("f_intensity", F.coalesce("_early", F.lit(0.0)).cast("long") + same).select(*by, "ts_event", "seq", *values, "f_intensity")
