"""Quality windows, funnels, summaries and classifications: conditional counts and ordered conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """The name of the first condition that holds; null conditions don't."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


# Fixed values of the window rules.
QUEUE_FULL_PCT, PRIMARY_OFFLINE_S, OFFLINE_S, DRAIN_S, RECONNECTS = 90, 600, 180, 180, 5
RELAX_OFFLINE_S, HEALTHY_EPS, HEALTHY_QUEUE_PCT = 300, 100, 50


def quality(dropped: Column, queue_pct: Column, reconnects: Column, drain_s: Column, primary_offline_s: Column, max_offline_s: Column, primary_eps: Column) -> tuple[Column, Column]:
    """A window's quality and the reasons against it.

    Drops, a full queue or a long outage of the primary venue are BAD, which is relaxed to DEGRADED where nothing was
    dropped, no venue was out for five minutes and the queue had room. DEGRADED becomes GOOD where the
    primary venue was healthy. Absent signals count as 0, an absent rate as unhealthy.
    """
    dropped, queue_pct, reconnects, drain_s, primary_offline_s, max_offline_s = (
        F.coalesce(c, F.lit(0)) for c in (dropped, queue_pct, reconnects, drain_s, primary_offline_s, max_offline_s)
    )
    bad = {"dropped_events": dropped > 0, "queue_pct_peak": queue_pct >= QUEUE_FULL_PCT, "primary_offline": primary_offline_s > PRIMARY_OFFLINE_S}
    degraded = {"max_offline": max_offline_s > OFFLINE_S, "drain_mode": drain_s > DRAIN_S, "reconnects": reconnects >= RECONNECTS}
    is_bad = bad["dropped_events"] | bad["queue_pct_peak"] | bad["primary_offline"]
    is_degraded = degraded["max_offline"] | degraded["drain_mode"] | degraded["reconnects"]
    relaxed = (dropped == 0) & (max_offline_s < RELAX_OFFLINE_S) & (queue_pct < QUEUE_FULL_PCT)
    healthy = (primary_offline_s == 0) & (dropped == 0) & (queue_pct < HEALTHY_QUEUE_PCT) & F.coalesce(primary_eps > HEALTHY_EPS, F.lit(False))
    state = first_of((is_bad & ~relaxed, "BAD"), ((is_bad | is_degraded) & ~healthy, "DEGRADED"), default="GOOD")
    why = [F.when(c, F.lit(n)) for n, c in bad.items()] + [F.when(~is_bad & c, F.lit(n)) for n, c in degraded.items()]
    return state, F.array_compact(F.array(*why))


def day_quality(windows: DataFrame, by: Sequence[str], per_day: int = 96) -> DataFrame:
    """The day's state from its windows; too few of them make it PARTIAL."""
    n = lambda s: F.count_if(F.col("quality") == s)
    x = windows.groupBy(*by).agg(F.count("*").alias("windows"), n("BAD").alias("bad"), n("DEGRADED").alias("degraded"))
    return x.withColumn("day_quality", first_of((F.col("windows") < per_day, "PARTIAL"), (F.col("bad") > 0, "BAD"), (F.col("degraded") >= 5, "DEGRADED"), default="GOOD"))


def completed_dates(parts: DataFrame, date: str, done: Column) -> DataFrame:
    """Dates all of whose parts are done."""
    return parts.groupBy(date).agg(F.bool_and(done).alias("_all")).filter("_all").select(date)


def coverage(df: DataFrame, day: str, source: str, wanted: int) -> DataFrame:
    """Sources present a day, and whether all are."""
    return df.groupBy(day).agg(F.countDistinct(source).alias("present")).withColumn("full", F.col("present") >= wanted)


def sliding_lists(df: DataFrame, by: Sequence[str], day: str, n: int, lookback: int | None = None, last: int | None = None) -> DataFrame:
    """Every n days that follow each other in a key's list of days; of its last ``lookback`` days only, and only the ``last`` such runs, if asked for."""
    d = df.select(*by, day).distinct()
    if lookback is not None:
        d = d.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day)))).filter(F.col("_back") <= lookback).drop("_back")
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(1 - n, 0)
    x = d.select(*by, F.min(day).over(w).alias("first_day"), F.col(day).alias("last_day"), F.count("*").over(w).alias("_n")).filter(F.col("_n") == n).drop("_n")
    if last is not None:
        x = x.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("last_day")))).filter(F.col("_back") <= last).drop("_back")
    return x


def state_times(df: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """Of each state its rows, their share, the gaps that followed them and their mean; a gap counts for the state before it. A null state is one of its own."""
    gap = F.lead("ts_event").over(Window.partitionBy(*by).orderBy("ts_event", "seq")) - F.col("ts_event")
    x = df.withColumn("_gap", gap).groupBy(*by, state).agg(F.count("*").alias("n"), F.count("_gap").alias("gaps"), F.avg("_gap").alias("avg_ms"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def cell_summary(windows: DataFrame, by: Sequence[str], target: int, least_median: float = 2.0, least_p10: float = 1.5, least_rate: float = 0.8) -> DataFrame:
    """A cell's windows (verdict, mean) together: counts of verdicts, median, tenth percentile (the value at floor((n - 1) / 10)) and least mean, and whether it is promising.

    Promising: as many windows as were wanted, none without support, median, percentile and share of DIRECTIONAL windows high enough. A cell
    has as many means as there are windows in the calendar, so they are sorted within its row.
    """
    n = lambda v: F.count_if(F.col("verdict") == v)
    x = windows.groupBy(*by).agg(
        F.count("*").alias("windows"), n("DIRECTIONAL").alias("directional"), n("ANTI_EDGE").alias("anti_edge"), n("NO_EDGE").alias("no_edge"), n("INSUFFICIENT_SUPPORT").alias("insufficient"),
        F.coalesce(F.median("mean"), F.lit(0.0)).alias("median_mean"), F.sort_array(F.collect_list("mean")).alias("_means"), F.coalesce(F.min("mean"), F.lit(0.0)).alias("min_mean"),
    )
    p10 = F.coalesce(F.get("_means", F.floor((F.size("_means") - 1) * 0.1).cast("int")), F.lit(0.0))
    x = x.withColumns({"p10_mean": p10, "directional_rate": F.col("directional") / F.col("windows")}).drop("_means")
    good = (F.col("median_mean") >= least_median) & (F.col("p10_mean") >= least_p10) & (F.col("directional_rate") >= least_rate)
    return x.withColumn("promising", (F.col("windows") == target) & (F.col("insufficient") == 0) & good)


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """First, last, extremes, mean and change; the change is null where the first is 0."""
    at = F.struct("ts_event", "seq")
    x = df.groupBy(*by).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    return x.withColumn("change_bps", F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 10000)


def funnel(df: DataFrame, stage: str, outcome: str) -> DataFrame:
    """A stage's total and its outcomes."""
    n = lambda s: F.count_if(F.col(outcome) == s).alias(s)
    return df.groupBy(stage).agg(F.count("*").alias("total"), n("pass"), n("reject"), n("skip"))


def reasons(df: DataFrame, stage: str, reason: str) -> DataFrame:
    """Counts by reason, UNKNOWN without one."""
    return df.groupBy(stage, F.coalesce(reason, F.lit("UNKNOWN")).alias("reason")).agg(F.count("*").alias("n"))


def decisions(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """When a decision was first seen, and its outcome: the last event strictly later than that, if there is one."""
    x = df.groupBy(key).agg(F.min("ts_event").alias("first_seen"), F.max(F.struct("ts_event", "seq", outcome)).alias("_l"), F.count("*").alias("events"))
    return x.select(key, "first_seen", "events", F.when(F.col("_l.ts_event") > F.col("first_seen"), F.col(f"_l.{outcome}")).alias("final_outcome"))


def pnl_state(pnl: Column, small: float = 1e-9) -> Column:
    return first_of((pnl.isNull(), "UNKNOWN"), (pnl > small, "GAIN"), (pnl < -small, "LOSS"), default="FLAT")


def bias(gains: Column, losses: Column, flats: Column) -> Column:
    """The state with the unique largest count, else MIXED."""
    return first_of(((gains > losses) & (gains > flats), "GAIN"), ((losses > gains) & (losses > flats), "LOSS"), ((flats > gains) & (flats > losses), "FLAT"), default="MIXED")


def half_up(x: Column, places: int = 0) -> Column:
    """Halves go up, toward positive infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


def slippage(df: DataFrame, by: Sequence[str], expected: Column, got: Column, notional: Column, side: Column) -> DataFrame:
    """Whole basis points against the trader, their mean and their mean weighted by notional."""
    bps = half_up((got / expected - 1) * 10000) * side
    x = df.select(*by, bps.alias("_b"), notional.alias("_w"))
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_b").alias("avg_bps"), F.max("_b").alias("worst_bps"), F.try_divide(F.sum(F.col("_b") * F.col("_w")), F.sum("_w")).alias("weighted_bps"))


def longest_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], hit: Column) -> DataFrame:
    """Each key's longest run of rows in order for which ``hit`` holds."""
    o = Window.partitionBy(*by).orderBy(*order)
    x = df.select(*by, *order, hit.cast("int").alias("_h")).withColumn("_island", F.sum(1 - F.col("_h")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*by, "_island").agg(F.sum("_h").alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("longest"))


def slo(value: Column, target: Column, warning: Column, at_least: Column) -> Column:
    """MET, WARNING or BREACHED; ``at_least`` says which side of the target is good."""
    met = F.when(at_least, value >= target).otherwise(value <= target)
    near = F.when(at_least, value >= warning).otherwise(value <= warning)
    return first_of((met, "MET"), (near, "WARNING"), default="BREACHED")


def transitions(df: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """Changes of state, their counts, and the mean time that the state left had lasted."""
    o = Window.partitionBy(*by).orderBy("ts_event", "seq")
    x = df.withColumn("_from", F.lag(state).over(o)).filter(F.col("_from").isNull() | (F.col("_from") != F.col(state)))
    x = x.withColumn("_since", F.lag("ts_event").over(o)).filter("_from is not null")
    return x.groupBy(*by, F.concat("_from", F.lit("->"), F.col(state)).alias("transition")).agg(F.count("*").alias("n"), F.avg(F.col("ts_event") - F.col("_since")).alias("avg_ms"))


def costs(df: DataFrame, hours: Column, rate: Column, *scopes: str) -> DataFrame:
    """Cost to six places, over all and by each scope, in one pass of grouping sets."""
    x = df.withColumn("_cost", F.round(hours * rate, 6))
    sets = [[], *[[s] for s in scopes]]
    out = x.groupingSets(sets, *scopes).agg(F.sum("_cost").alias("cost"), F.count("*").alias("jobs"), F.grouping_id(*scopes).alias("_g"))
    return out.withColumn("cost", F.round("cost", 4)).drop("_g")
