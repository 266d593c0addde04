"""Result sheets, rolling performance, lifecycle rules and status chains: windows within a key and ordered conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rollups import first_of


def places8(x: Column) -> Column:
    """Half up to eight places; what isn't finite is 0."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(fine, F.floor(x * 1e8 + 0.5) / 1e8).otherwise(0.0)


def result_sheet(trips: DataFrame, curve: DataFrame, by: Sequence[str], capital: float) -> DataFrame:
    """One row a key from round trips (entry_ts, exit_ts, pnl, fee) and its equity curve (ts_event, seq, equity).

    The drawdown is relative to the running peak, which starts at the capital, and is at most 0; ``sharpe_like`` is the
    return over its size. Exposure is the time held over the time that the curve spans (0 for one point).
    Keys without a curve have no row; without trips, their figures are 0.
    """
    o = Window.partitionBy(*by).orderBy("ts_event", "seq")
    peak = F.greatest(F.max("equity").over(o.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float(capital)))
    c = curve.withColumn("_dd", (F.col("equity") - peak) / peak)
    c = c.groupBy(*by).agg(F.max_by("equity", F.struct("ts_event", "seq")).alias("_end"), F.least(F.min("_dd"), F.lit(0.0)).alias("_dd"), (F.max("ts_event") - F.min("ts_event")).alias("_span"))
    t = trips.groupBy(*by).agg(
        F.count("*").alias("_n"), F.avg((F.col("pnl") > 0).cast("int")).alias("_wins"), F.avg("pnl").alias("_avg"), F.sum(F.col("exit_ts") - F.col("entry_ts")).alias("_held"), F.sum("fee").alias("_fees")
    )
    x = c.join(t, list(by), "left").fillna(0, ["_n", "_wins", "_avg", "_held", "_fees"])
    gain = F.col("_end") - capital
    held = F.when(F.col("_n") > 0, F.expr("_held div _n") / 1000).otherwise(0.0)
    figures = {
        "equity_end": F.col("_end"), "pnl_abs": gain, "pnl_pct": gain / capital, "max_drawdown_pct": F.col("_dd"), "win_rate": F.col("_wins"), "avg_trade_pnl": F.col("_avg"), "avg_holding_sec": held,
        "fees_total": F.col("_fees"), "exposure_pct": F.try_divide(F.col("_held").cast("double"), F.col("_span")), "sharpe_like": F.try_divide(gain / capital, F.abs("_dd")),
    }
    return x.select(*by, F.col("_n").alias("trades"), *[places8(v).alias(k) for k, v in figures.items()])


def research_metrics(trades: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Total, wins, losses (all that aren't wins) and the largest fall of the summed pnl below its peak, which starts at 0."""
    up = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("_sum", F.sum("pnl").over(up))
    x = x.withColumn("_fall", F.greatest(F.max("_sum").over(up), F.lit(0.0)) - F.col("_sum"))
    wins = F.count_if(F.col("pnl") > 0)
    return x.groupBy(*by).agg(
        F.sum("pnl").alias("total_return"), F.greatest(F.max("_fall"), F.lit(0.0)).alias("max_drawdown"), F.count("*").alias("trades"), wins.alias("wins"), (F.count("*") - wins).alias("losses"),
        (wins / F.count("*")).alias("win_rate"),
    )


def rolling_performance(runs: DataFrame, by: Sequence[str], now: Column, days: int) -> DataFrame:
    """Over runs (completed_at, run_id, return_pct, sharpe, win_rate, drawdown_pct, trades) of the last days.

    Loss days: the most dates in a streak of losing runs, where any other run ends the streak. Missing ratios don't count in
    their means (0 without any); a missing drawdown is 0.
    """
    x = runs.filter(F.col("completed_at") >= now - F.make_interval(days=F.lit(days)))
    o = Window.partitionBy(*by).orderBy("completed_at", "run_id")
    loss = F.coalesce(F.col("return_pct") < 0, F.lit(False))
    x = x.withColumn("_streak", F.sum((~loss).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    days_of = F.when(loss, F.to_date("completed_at"))
    parts = x.groupBy(*by, "_streak").agg(
        F.count_distinct(days_of).alias("_days"), F.count("*").alias("_n"), F.sum("trades").alias("_trades"), F.sum("return_pct").alias("_r"), F.sum("sharpe").alias("_s"), F.count("sharpe").alias("_ns"),
        F.sum("win_rate").alias("_w"), F.count("win_rate").alias("_nw"), F.max(F.coalesce("drawdown_pct", F.lit(0.0))).alias("_dd"), F.count_if(F.col("return_pct") > 0).alias("_up"),
    )
    mean = lambda a, n: F.coalesce(F.try_divide(F.sum(a), F.sum(n)), F.lit(0.0))
    return parts.groupBy(*by).agg(
        F.sum("_n").alias("total_runs"), F.sum("_trades").alias("total_trades"), mean("_r", "_n").alias("avg_return"), mean("_s", "_ns").alias("avg_sharpe"), mean("_w", "_nw").alias("avg_win_rate"),
        F.max("_dd").alias("max_drawdown_pct"), F.max("_days").alias("loss_days"), (F.sum("_up") / F.sum("_n")).alias("positive_fraction"),
    )


# Fixed values of the lifecycle: what a stage asks of a strategy that is to enter it.
STAGES = ("CANDIDATE", "PAPER", "CANARY", "SHADOW", "LIVE")
ENTRY = {
    "CANDIDATE": {"runs": 1, "days": 0, "sharpe": 0.5, "drawdown": 5, "trades": 10},
    "PAPER": {"runs": 5, "days": 3, "sharpe": 0.3, "drawdown": 10, "win_rate": 0.35, "trades": 50},
    "CANARY": {"runs": 10, "days": 7, "sharpe": 0.3, "drawdown": 8, "win_rate": 0.35, "approval": True},
    "SHADOW": {"runs": 20, "days": 14, "sharpe": 0.3, "drawdown": 10, "consistency": 0.6, "approval": True},
    "LIVE": {},
}


def promotion(metrics: DataFrame, stages: Sequence[str] = STAGES, entry: Mapping[str, Mapping] = ENTRY) -> DataFrame:
    """(target_stage, promote, failed, needs_approval) for rows of ``rolling_performance`` with stage and days_in_stage.

    The next stage's limits hold; a stage without its own takes those of the current one, but for runs and days.
    The last stage, and one that isn't known, has no target and isn't promoted.
    """
    nxt = dict(zip(stages, stages[1:], strict=False))
    limits = {s: (entry[t] or {k: v for k, v in entry[s].items() if k not in ("runs", "days")}) for s, t in nxt.items()}
    stage = F.col("stage")

    def limit(name: str) -> Column:
        out = F.lit(None).cast("double")
        for s, rules in limits.items():
            if name in rules:
                out = F.when(stage == s, F.lit(float(rules[name]))).otherwise(out)
        return out

    checks = (
        ("runs", F.col("total_runs") < limit("runs")), ("days", F.col("days_in_stage") < limit("days")), ("sharpe", F.col("avg_sharpe") < limit("sharpe")), ("drawdown", F.col("max_drawdown_pct") > limit("drawdown")),
        ("win_rate", F.col("avg_win_rate") < limit("win_rate")), ("trades", F.col("total_trades") < limit("trades")), ("consistency", F.col("positive_fraction") < limit("consistency")),
    )
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    target = first_of(*[(stage == s, t) for s, t in nxt.items()])
    approval = stage.isin([s for s, rules in limits.items() if rules.get("approval")])
    x = metrics.withColumns({"target_stage": target, "failed": F.when(target.isNotNull(), F.array_join(failed, ",")).otherwise("path")})
    return x.withColumns({"promote": F.col("failed") == "", "needs_approval": F.coalesce(approval & F.col("target_stage").isNotNull(), F.lit(False))})


# Fixed values of the lifecycle: when a strategy goes back or out.
RETIRE_SHARPE, RETIRE_DRAWDOWN, RETIRE_HEALTH, DEMOTE_LOSS_DAYS = -0.5, 2.0, 0.2, 5


def demotion(metrics: DataFrame, stages: Sequence[str] = STAGES, entry: Mapping[str, Mapping] = ENTRY) -> DataFrame:
    """(demote, to_stage, severity, why) for rows of ``rolling_performance`` with stage, backtest_drawdown and edge_health.

    Out at once (RETIRE): a Sharpe below -0.5, a drawdown over twice the backtest's (where that is known and not 0), an edge's health below 0.2. Back one
    stage (DEMOTE), from the first stage out: more than five loss days, or a Sharpe below what the stage asks. A retired or unknown
    stage has nowhere to step back to; unknown figures break no rule. The first rule that holds is ``why``; without one severity is WARNING.
    """
    stage, prev = F.col("stage"), dict(zip(stages[1:], stages, strict=False))
    back = first_of(*[(stage == s, prev.get(s, "RETIRED")) for s in stages])
    least = F.lit(None).cast("double")
    for s, rules in entry.items():
        if "sharpe" in rules:
            least = F.when(stage == s, F.lit(float(rules["sharpe"]))).otherwise(least)
    base = F.col("backtest_drawdown")
    out = ((F.col("avg_sharpe") < RETIRE_SHARPE, "sharpe_catastrophic"), ((base != 0) & (F.col("max_drawdown_pct") > base * RETIRE_DRAWDOWN), "drawdown"), (F.col("edge_health") < RETIRE_HEALTH, "edge_decay"))
    step = ((back.isNotNull() & (F.col("loss_days") > DEMOTE_LOSS_DAYS), "loss_days"), (back.isNotNull() & (F.col("avg_sharpe") < least), "sharpe"))
    x = metrics.withColumn("why", first_of(*out, *step))
    retire = F.col("why").isin([n for _, n in out])
    x = x.withColumn("to_stage", F.when(retire, "RETIRED").when(F.col("why").isNotNull(), back))
    return x.withColumns({"demote": F.col("why").isNotNull(), "severity": first_of((F.col("to_stage") == "RETIRED", "RETIRE"), (F.col("why").isNotNull(), "DEMOTE"), default="WARNING")})


def _early(single: Column, fees: Column, funding: Column, unsupported: str, partial: str) -> list[tuple[Column, str]]:
    gaps = ["NO_FUNDING_EVENTS_OBSERVED", "RUN_WINDOW_UNAVAILABLE", "FUNDING_COST_PARTIAL_MARK_MISSING"]
    return [(~single, unsupported), (fees == "NO_FILL_ACTIVITY", "NO_FILL_ACTIVITY"), (F.coalesce(fees != "FILL_FEE_BACKED", F.lit(True)), "GROSS_ONLY_FEE_PARTIAL"), (funding.isin(gaps), partial)]


def cost_status(single: Column, fees: Column, funding: Column, direction: Column, mark: Column) -> Column:
    """How far a ledger's costs are backed."""
    return first_of(
        *_early(single, fees, funding, "MULTI_SYMBOL_UNSUPPORTED", "NET_FEE_BACKED_FUNDING_PARTIAL"), (direction == "FLAT", "NET_FEE_BACKED_CLOSED_FUNDING_AWARE"),
        (mark.isNotNull(), "NET_FEE_BACKED_MARK_TO_MARKET_FUNDING_AWARE"), default="NET_FEE_BACKED_MARK_PRICE_UNAVAILABLE_FUNDING_AWARE",
    )


def profit_status(single: Column, fees: Column, funding: Column, direction: Column, net: Column, exit_fee: Column) -> Column:
    """What a ledger's profit is net of."""
    return first_of(
        *_early(single, fees, funding, "PROFITABILITY_UNSUPPORTED_MULTI_SYMBOL", "PROFITABILITY_PARTIAL_FUNDING_MISSING"), (direction == "FLAT", "NET_AFTER_FEES_AND_FUNDING"),
        (net.isNull(), "PROFITABILITY_PARTIAL_MARK_PRICE_UNAVAILABLE"), (exit_fee.isNotNull(), "NET_MARK_TO_MARKET_AFTER_FEES_FUNDING_AND_EXIT_ESTIMATE"), default="NET_MARK_TO_MARKET_AFTER_FEES_AND_FUNDING",
    )


def with_grid(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Each row once for every combination of parameters, with its number ``combo`` (the last name varies fastest)."""
    n = 1
    for name, values in grid.items():
        df = df.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1)))).withColumn(name, F.element_at(F.array(*map(F.lit, values)), F.col("_at") + 1))
        df = df.withColumn("combo", F.col("_at") if n == 1 else F.col("combo") * len(values) + F.col("_at")).drop("_at")
        n *= len(values)
    return df
