"""Pattern scans and the checks a found pattern has to pass: out of sample, walk forward, decay, regimes, score.

A pattern's trades are a column ``r``: the forward return in the pattern's direction, null where it isn't
active. Windows of rows are numbered within a key in the order (ts_event, seq); a row in several windows
is exploded into them, and windows that aren't full are left out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import clamp
from .rollups import first_of
from .scans import at_home, in_blocks, memory, null_safe_join, number, value_counts
from .stats import index_quantile, pearson

EVENTS_PER_YEAR = 7_200_000


def sharpe(value: Column) -> Column:
    """Annualised mean over population deviation; 0 without values or variance."""
    flat = F.coalesce(F.min(value) == F.max(value), F.lit(True))
    return F.when(flat, 0.0).otherwise(F.try_divide(F.avg(value), F.stddev_pop(value)) * float(EVENTS_PER_YEAR) ** 0.5)


def _matched(df: DataFrame, hits: Sequence[Column], returns: Sequence[str], regime: str) -> DataFrame:
    """A row per match, scope (all, or the row's regime) and horizon with a known return; rows without a match give none."""
    scopes = F.array(F.lit("all"), F.concat(F.lit("regime "), F.col(regime).cast("string")))
    known = F.filter(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).alias("value")) for h in returns]), lambda s: s["value"].isNotNull())
    x = df.select(F.explode(F.array_compact(F.array(*hits))).alias("m"), scopes.alias("scopes"), known.alias("known"))
    x = x.select("m.*", F.explode("scopes").alias("scope"), "known")
    return x.select("feature", "op", "bound", "scope", F.explode("known").alias("k")).select("feature", "op", "bound", "scope", "k.*")


def _cells(x: DataFrame) -> DataFrame:
    key = ["feature", "op", "bound", "scope", "horizon"]
    sums = x.groupBy(*key).agg(F.count("*").alias("support"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return sums.join(index_quantile(x, key, "value", 0.5).withColumnRenamed("quantile", "median"), key)


def threshold_scan(df: DataFrame, features: Sequence[str], returns: Sequence[str], regime: str, thresholds: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Forward returns where a feature is above a threshold or below its negative, over all rows and by regime.

    The median is the upper one. All matches count.
    """
    hits = []
    for f in features:
        for t in thresholds:
            for op, bound, hit in ((">", t, F.col(f) > t), ("<", -t, F.col(f) < -t)):
                hits.append(F.when(hit, F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), F.lit(float(bound)).alias("bound"))))
    return _cells(_matched(df, hits, returns, regime))


def quantile_scan(df: DataFrame, features: Sequence[str], returns: Sequence[str], regime: str, q: float = 0.1) -> DataFrame:
    """As M19, outside the features' own sorted[floor(q n)] and sorted[floor((1 - q) n)]; these bounds are one row a feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("s")).select("s.*")
    low, high = index_quantile(long, ["feature"], "x", q), index_quantile(long, ["feature"], "x", 1 - q)
    sides = low.select("feature", F.lit("<").alias("op"), F.col("quantile").alias("bound")).unionByName(high.select("feature", F.lit(">").alias("op"), F.col("quantile").alias("bound")))
    one = sides.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("feature", "op"), "bound"))).alias("_bounds"))  # two entries a feature
    x = df.join(F.broadcast(one))
    at = lambda f, op: F.try_element_at("_bounds", F.lit(f + op))
    hits = []
    for f in features:
        for op, hit in (("<", F.col(f) < at(f, "<")), (">", F.col(f) > at(f, ">"))):
            hits.append(F.when(hit, F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), at(f, op).alias("bound"))))
    return _cells(_matched(x, hits, returns, regime))


def kept_patterns(patterns: DataFrame, support: int = 30, mean: float = 0.0005) -> DataFrame:
    """M22."""
    return patterns.filter((F.col("support") >= support) & (F.abs("mean") >= mean))


def edge_statistics(patterns: DataFrame) -> DataFrame:
    """What to expect of a pattern from its mean and deviation."""
    ratio = F.when(F.col("std") == 0, 0.0).otherwise(F.try_divide("mean", "std"))
    return patterns.withColumns({
        "win_rate": clamp(0.5 + 0.5 * F.tanh(ratio), 0.3, 0.9), "max_drawdown": 2 * F.col("std"),
        "max_loss": F.abs("mean") + 2 * F.col("std"), "tail_risk": 3 * F.col("std"),
    })


def out_of_sample(df: DataFrame, by: Sequence[str], train: float = 0.7, min_sharpe: float = 0.5, max_loss: float = 0.5) -> DataFrame:
    """The first ``train`` of the rows against the rest."""
    x = number(df, by)
    inside = F.col("_i") < F.floor(F.col("_n") * train)
    a, b = F.when(inside, F.col("r")), F.when(~inside, F.col("r"))
    x = x.groupBy(*by).agg(sharpe(a).alias("is_sharpe"), sharpe(b).alias("oos_sharpe"), F.count(a).alias("is_trades"), F.count(b).alias("oos_trades"))
    lost = F.when(F.col("is_sharpe") == 0, 0.0).otherwise(F.try_divide(F.col("is_sharpe") - F.col("oos_sharpe"), F.abs("is_sharpe")))
    x = x.withColumn("degradation", lost)
    parts = F.least(F.lit(1.0), F.col("oos_sharpe") / min_sharpe) + F.greatest(F.lit(0.0), 1 - F.col("degradation") / max_loss) + F.least(F.lit(1.0), F.col("oos_trades") / 30)
    return x.withColumns({"oos_passed": (F.col("oos_sharpe") >= min_sharpe) & (F.col("degradation") <= max_loss), "oos_confidence": parts / 3})


def walk_forward(df: DataFrame, by: Sequence[str], size: int = 5000, step: int = 1000, min_positive: float = 0.6) -> DataFrame:
    """Sharpe ratios of overlapping windows: their share above 0, slope and deviation."""
    i = F.col("_i")
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / step)).cast("long")
    x = number(df, by).withColumn("_k", F.sequence(first, F.floor(i / step).cast("long"), F.lit(1).cast("long")))
    x = x.filter(first <= F.floor(i / step)).select(*by, "r", "_n", F.explode("_k").alias("_k")).filter(F.col("_k") * step + size <= F.col("_n"))
    w = x.groupBy(*by, "_k").agg(sharpe(F.col("r")).alias("_s"))
    out = w.groupBy(*by).agg(
        F.count("*").alias("windows"), F.avg((F.col("_s") > 0).cast("int")).alias("positive_fraction"),
        F.coalesce(F.regr_slope("_s", "_k"), F.lit(0.0)).alias("sharpe_trend"), F.stddev_pop("_s").alias("consistency"),
    )
    return out.withColumn("wf_passed", (F.col("positive_fraction") >= min_positive) & (F.col("sharpe_trend") >= -0.5))


def decay(df: DataFrame, by: Sequence[str], size: int = 1000, max_rate: float = -0.001, max_psi: float = 0.25) -> DataFrame:
    """The slope of mean returns over windows that don't overlap, and the drift of regimes from the first quarter of rows to the last."""
    x = number(df, by)
    w = x.withColumn("_k", F.floor(F.col("_i") / size)).filter((F.col("_k") + 1) * size <= F.col("_n"))
    w = w.groupBy(*by, "_k").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("_m"))
    w = w.groupBy(*by).agg(F.count("*").alias("_w"), F.coalesce(F.regr_slope("_m", "_k"), F.lit(0.0)).alias("decay_rate"))
    q = F.floor(F.col("_n") / 4)
    c = x.withColumn("_q", q).groupBy(*by, "regime").agg(
        F.count_if(F.col("_i") < q).alias("_a"), F.count_if(F.col("_i") >= F.col("_n") - q).alias("_b"), F.max("_q").alias("_q")
    ).filter("_a > 0 or _b > 0")
    k = F.count("*").over(Window.partitionBy(*by))
    p1, p2 = (F.col("_a") + 1) / (F.col("_q") + k), (F.col("_b") + 1) / (F.col("_q") + k)
    c = c.select(*by, ((p1 - p2) * F.log(p1 / p2)).alias("_t")).groupBy(*by).agg(F.abs(F.sum("_t")).alias("psi"))
    out = w.join(c, list(by), "left").withColumn("psi", F.when(F.col("_w") < 2, 0.0).otherwise(F.coalesce("psi", F.lit(0.0))))
    out = out.withColumn("half_life", F.when(F.col("decay_rate") < 0, F.lit(0.6931471805599453) / F.abs("decay_rate")))
    return out.withColumn("decay_passed", (F.col("decay_rate") >= max_rate) & (F.col("psi") < max_psi)).drop("_w")


def regime_selectivity(df: DataFrame, by: Sequence[str], targets: Sequence[int], min_trades: int = 20, min_sharpe: float = 0.3, min_gap: float = 0.2) -> DataFrame:
    """Mean Sharpe ratio in the target regimes against the others; regimes with few trades are left out."""
    g = df.groupBy(*by, "regime").agg(sharpe(F.col("r")).alias("_s"), F.count("r").alias("_n"))
    target = F.col("regime").isin(list(targets))
    mean = lambda c: F.coalesce(F.avg(F.when(c & (F.col("_n") >= min_trades), F.col("_s"))), F.lit(0.0))
    x = g.groupBy(*by).agg(mean(target).alias("target_sharpe"), mean(~target).alias("other_sharpe"))
    x = x.withColumn("selectivity", F.col("target_sharpe") - F.col("other_sharpe"))
    return x.withColumn("regime_passed", (F.col("target_sharpe") >= min_sharpe) & (F.col("selectivity") >= min_gap))


def edge_score(df: DataFrame, by: Sequence[str], targets: Sequence[int], window: int = 5000, step: int = 1000, decay_window: int = 1000) -> DataFrame:
    """The weighted score of M27 to M30 and of the number of trades, and what it recommends.

    A key with too few rows for a window has no walk-forward or decay result, and scores 0 or 1 there.
    """
    x = out_of_sample(df, by).join(walk_forward(df, by, window, step), list(by), "left")
    x = x.join(decay(df, by, decay_window), list(by), "left").join(regime_selectivity(df, by, targets), list(by), "left")
    trend = F.when(F.col("sharpe_trend") >= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 + F.col("sharpe_trend")))
    steady = F.when(F.col("consistency") < 1, 1.0).otherwise(1 / (1 + F.col("consistency")))
    gated = lambda ok, v: F.when(F.coalesce(F.col(ok), F.lit(False)), v).otherwise(0.0)
    total = (
        0.30 * gated("oos_passed", clamp(F.col("oos_confidence"), 0, 1))
        + 0.25 * gated("wf_passed", (F.col("positive_fraction") + trend + steady) / 3)
        + 0.20 * F.when(F.coalesce("decay_passed", F.lit(True)), 1.0).otherwise(0.0)
        + 0.15 * gated("regime_passed", (F.least(F.lit(1.0), F.col("selectivity")) + F.least(F.lit(1.0), F.col("target_sharpe"))) / 2)
        + 0.10 * F.least(F.lit(1.0), (F.col("is_trades") + F.col("oos_trades")) / 100)
    )
    x = x.select(*by, total.alias("score"))
    return x.withColumn("recommendation", first_of((F.col("score") >= 0.5, "VALIDATED"), (F.col("score") >= 0.4, "MARGINAL"), default="REJECTED"))


def four_tests(t_p: Column, permutation_p: Column, sharpe_ratio: Column, regimes_hold: Column, tests: int = 1, p_max: float = 0.05, min_sharpe: float = 0.5) -> tuple[Column, Column]:
    """The share of four tests passed, and the recommendation; p values are held to p_max over the number of patterns tested.

    A permutation test that wasn't run (null) counts as passed.
    """
    bar = p_max / max(1, tests)
    passed = [F.coalesce(t_p < bar, F.lit(False)), F.coalesce(permutation_p < bar, F.lit(True)), F.coalesce(sharpe_ratio >= min_sharpe, F.lit(False)), F.coalesce(regimes_hold, F.lit(True))]
    score = sum((p.cast("int") for p in passed), F.lit(0)) / 4
    return score, first_of((score >= 0.75, "ACCEPT"), (score >= 0.5, "WEAK"), default="REJECT")


def regimes_hold(df: DataFrame, by: Sequence[str], regime: str, value: str, hit: str, min_sharpe: float = 0.5) -> DataFrame:
    """Whether a pattern's Sharpe ratio reaches ``min_sharpe`` in every regime that it matches in; true where it matches in none."""
    matched = df.filter(F.col(hit) & F.col(value).isNotNull()).groupBy(*by, regime).agg(sharpe(F.col(value)).alias("_sharpe"))
    held = matched.groupBy(*by).agg(F.bool_and(F.col("_sharpe") >= min_sharpe).alias("_held"))
    return df.select(*by).distinct().join(held, list(by), "left").select(*by, F.coalesce("_held", F.lit(True)).alias("regimes_hold"))


def _running(trades: DataFrame, by: Sequence[str], pnl: str) -> DataFrame:
    """trades, wins, avg_return and losses_in_row after each trade."""
    v, i = F.col(pnl), F.col("_i")
    x = number(trades, by, sums={"wins": (v > 0).cast("long"), "_sum": v})
    x = x.withColumn("_stop", F.when(~F.coalesce(v < 0, F.lit(False)), i))
    last = number(x.drop("_i", "_n"), by, highest={"_stop": F.col("_stop")})
    return last.withColumns({
        "trades": i + 1, "wins": F.coalesce("wins", F.lit(0)), "avg_return": F.col("_sum") / (i + 1), "losses_in_row": i - F.coalesce("_stop", F.lit(-1)),
    }).drop("_sum", "_stop")


def running_stats(trades: DataFrame, by: Sequence[str], pnl: str = "pnl", confidence: float = 0.5) -> DataFrame:
    """After each trade, a key's trades, wins, losses in a row, mean return, health, and whether it is retired. Trades have a pnl."""
    x = _running(trades, by, pnl)
    health = 0.5 * clamp(2 * F.col("wins") / F.col("trades"), 0, 1) + 0.3 * confidence + 0.2 * F.least(F.lit(1.0), F.col("trades") / 100)
    bad = (F.col("trades") > 50) & (F.col("avg_return") < -0.001)
    x = x.withColumn("health", health)
    first = x.filter(bad).groupBy(*by).agg(F.min("_i").alias("_bad"))
    x = null_safe_join(x, first, by, "left")
    return x.withColumn("retired", F.coalesce(F.col("_i") >= F.col("_bad"), F.lit(False))).drop("_bad", "_i", "_n")


#: Fixed values of the live learning loop.
LEARNING = {"alpha": 0.05, "min_trades": 30, "confidence_drop": 0.15, "losses": 10, "win_rate_drop": 0.1}


def live_confidence(trades: DataFrame, by: Sequence[str], pnl: str = "pnl", start: Column | float = 0.5, baseline_confidence: Column | float | None = None, baseline_win_rate: Column | float | None = None, rules: Mapping[str, float] = LEARNING) -> DataFrame:
    """After each trade a key's confidence, and its alerts against a baseline.

    From trade ``min_trades`` on, confidence moves to 1 for a win and to 0 else by ``alpha``. The average is a chain of affine
    maps: what is left of the start falls with the number of moves, and the moves themselves are a weighted sum within a
    block and the memory before it. An unknown baseline gives no alerts of its kind, as no baseline gives none at all.
    """
    alpha, warm = float(rules["alpha"]), int(rules["min_trades"])
    rest = 1 - alpha
    back = memory(alpha)
    size = max(back, int(500 / -math.log(rest)) - back)  # powers over a block stay within a double
    x = in_blocks(_running(trades, by, pnl), by, before=back, size=size)
    i, moved = F.col("_i"), F.col("_i") >= warm - 1
    at = i - F.col("_blk") * size + back
    up = Window.partitionBy(*by, "_blk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    moves = F.sum(F.when(moved & (F.col(pnl) > 0), alpha * F.pow(F.lit(rest), -at)).otherwise(0.0)).over(up) * F.pow(F.lit(rest), at)
    left = F.pow(F.lit(rest), F.greatest(i - (warm - 2), F.lit(0)))
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("double")
    x = at_home(x.withColumn("confidence", as_column(start) * left + moves))
    win_rate = F.col("wins") / F.col("trades")
    alerts = [
        F.when(as_column(baseline_confidence) - F.col("confidence") > rules["confidence_drop"], "CONFIDENCE_DROP"),
        F.when((as_column(baseline_confidence).isNotNull() | as_column(baseline_win_rate).isNotNull()) & (F.col("losses_in_row") >= rules["losses"]), "CONSECUTIVE_LOSSES"),
        F.when((F.col("trades") >= warm) & (as_column(baseline_win_rate) - win_rate > rules["win_rate_drop"]), "WINRATE_DROP"),
    ]
    return x.withColumn("alerts", F.array_compact(F.array(*alerts)))


def outcome_importance(trades: DataFrame, by: Sequence[str], feature: str, pnl: str) -> DataFrame:
    """A feature's importance for outcomes: correlation, its rough p, and the normalised difference of winners and losers.

    p is a table of four steps over |t| (fixed values).
    """
    x = trades.filter(F.col(feature).isNotNull())
    won = F.col(pnl) > 0
    side = lambda f, c: f(F.when(c, F.col(feature)))
    x = x.groupBy(*by).agg(
        F.count("*").alias("n"), pearson(F.col(feature), F.col(pnl)).alias("correlation"), side(F.avg, won).alias("_mw"), side(F.avg, ~won).alias("_ml"),
        side(F.var_pop, won).alias("_vw"), side(F.var_pop, ~won).alias("_vl"),
    )
    r = F.col("correlation")
    t = F.abs(r * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - r * r)))
    p = F.when(F.col("n") < 3, 1.0).when(t > 2.6, 0.01).when(t > 2.0, 0.05).when(t > 1.5, 0.15).otherwise(0.5)
    effect = F.try_divide(F.abs(F.col("_mw") - F.col("_ml")), F.sqrt((F.col("_vw") + F.col("_vl")) / 2))
    x = x.withColumns({"p": p, "shift": F.coalesce(F.least(F.lit(1.0), effect / 0.8), F.lit(0.0))})
    total = 0.5 * F.abs(r) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("p")) + 0.2 * F.col("shift")
    return x.withColumn("importance", F.least(F.lit(1.0), total)).drop("_mw", "_ml", "_vw", "_vl")


def quartile_win_rates(trades: DataFrame, by: Sequence[str], feature: str, pnl: str) -> DataFrame:
    """Win rates by quartile of floor(n / 4) rows, the rest in the last; none for fewer than four rows. Ties are cut by (ts_event, seq)."""
    rows = trades.filter(F.col(feature).isNotNull())
    places = value_counts(rows, by, feature).select(*by, F.col("_value").alias(feature), "before", F.col("total"))
    # Equal values are numbered by time among themselves, from where their value begins.
    x = null_safe_join(number(rows, [*by, feature]), places, [*by, feature]).filter("total >= 4")
    quartile = F.least(F.lit(3), F.floor((F.col("before") + F.col("_i")) / F.floor(F.col("total") / 4)))
    return x.withColumn("quartile", quartile).groupBy(*by, "quartile").agg(F.count("*").alias("n"), F.avg((F.col(pnl) > 0).cast("int")).alias("win_rate"))


def alpha_score(importance: Column, correlation: Column, psi: Column) -> Column:
    """M13."""
    return 0.4 * importance + 0.3 * correlation + 0.3 * (1 - F.least(psi / 0.5, F.lit(1.0)))


def split_drift(df: DataFrame, split: str, label: str, limit: float = 0.05) -> DataFrame:
    """M9: label shares of every pair of splits; drift where they differ by more than the limit."""
    c = df.groupBy(split, label).count()
    names = c.select(split).distinct().join(c.select(label).distinct())  # splits by labels, both few
    c = names.join(c, [split, label], "left").fillna(0, ["count"])
    c = c.withColumn("_s", F.col("count") / F.sum("count").over(Window.partitionBy(split)))
    a = c.select(label, F.col(split).alias("a"), F.col("_s").alias("_x"))
    b = c.select(label, F.col(split).alias("b"), F.col("_s").alias("_y"))
    x = a.join(b, label).filter(F.col("a") < F.col("b"))
    return x.select("a", "b", label, F.abs(F.col("_x") - F.col("_y")).alias("difference"), (F.abs(F.col("_x") - F.col("_y")) > limit).alias("drift"))


def window_psi(df: DataFrame, by: Sequence[str], value: str, window_ms: int, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Stability of each time window against the first, which starts at the key's least time; bins span the first's range.

    A last row that stands alone exactly at a window's start is no window.
    """
    ends = df.groupBy(*by).agg(F.min("ts_event").alias("_t0"), F.max("ts_event").alias("_t1"))
    x = df.join(ends, list(by)).withColumn("window", F.floor((F.col("ts_event") - F.col("_t0")) / window_ms))
    x = x.filter(F.col("_t0") + F.col("window") * window_ms < F.col("_t1"))
    r = x.filter("window = 0").groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0))
    c = x.join(r, list(by)).withColumn("_bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).groupBy(*by, "window", "_bin").count()
    grid = c.select(*by, "window").distinct().withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    c = grid.join(c, [*by, "window", "_bin"], "left").fillna(0, ["count"])
    c = c.withColumn("_p", F.greatest(F.col("count") / F.sum("count").over(Window.partitionBy(*by, "window")), F.lit(floor)))
    base = c.filter("window = 0").select(*by, "_bin", F.col("_p").alias("_b"))
    x = c.filter("window > 0").join(base, [*by, "_bin"])
    return x.groupBy(*by, "window").agg(F.sum((F.col("_p") - F.col("_b")) * F.log(F.col("_p") / F.col("_b"))).alias("psi"))
