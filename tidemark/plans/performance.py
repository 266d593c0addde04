"""Queries over result sheets, rolling performance, lifecycle rules and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import performance as p
from ..sources.events import TICKS_SQL, table, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
O_SQL = "PARTITION BY symbol ORDER BY ts_event, seq"
TRIPS_SQL = f"{TICKS_SQL}, trips AS (SELECT * FROM (SELECT symbol, seq, lag(ts_event) OVER ({O_SQL}) AS entry_ts, ts_event AS exit_ts, price - lag(price) OVER ({O_SQL}) AS pnl, price * 0.001 AS fee FROM ticks) WHERE pnl IS NOT NULL)"


def trips(spark, sf_dir):
    """A symbol's ticks as round trips: entered at one, left at the next."""
    o = Window.partitionBy("symbol").orderBy("ts_event", "seq")
    x = ticks(spark, sf_dir).select("symbol", "seq", F.lag("ts_event").over(o).alias("entry_ts"), F.col("ts_event").alias("exit_ts"), (F.col("price") - F.lag("price").over(o)).alias("pnl"), (F.col("price") * 0.001).alias("fee"))
    return x.filter("pnl is not null")


@CAT.add("A41_result_sheet", f"""WITH {TRIPS_SQL}, e AS (SELECT *, 1000 + sum(pnl) OVER w AS equity FROM trips WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(1000, max(equity) OVER (PARTITION BY symbol ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
s AS (SELECT symbol, count(*) AS trades, arg_max(equity, (exit_ts, seq)) AS fin, least(min((equity - peak) / peak), 0) AS dd, avg((pnl > 0)::INT) AS wins, avg(pnl) AS av, sum(exit_ts - entry_ts)::BIGINT AS held, sum(fee) AS fees, max(exit_ts) - min(exit_ts) AS span FROM k GROUP BY 1)
SELECT symbol, trades, round(fin, 6) AS equity_end, round(fin - 1000, 6) AS pnl_abs, round((fin - 1000) / 1000, 6) AS pnl_pct, round(dd, 6) AS max_drawdown_pct, round(wins, 6) AS win_rate, round(av, 6) AS avg_trade_pnl,
round((held // trades) / 1000, 6) AS avg_holding_sec, round(fees, 6) AS fees_total, round(CASE WHEN span > 0 THEN held / span ELSE 0 END, 6) AS exposure_pct, round(CASE WHEN dd <> 0 THEN (fin - 1000) / 1000 / abs(dd) ELSE 0 END, 6) AS sharpe_like FROM s""")
def a41(spark, sf_dir):
    t = trips(spark, sf_dir)
    up = Window.partitionBy("symbol").orderBy("exit_ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    curve = t.select("symbol", F.col("exit_ts").alias("ts_event"), "seq", (1000 + F.sum("pnl").over(up)).alias("equity"))
    return rounded(p.result_sheet(t, curve, ["symbol"], 1000))


@CAT.add("A42_research_metrics", f"""WITH {TRIPS_SQL}, c AS (SELECT *, sum(pnl) OVER w AS c FROM trips WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY symbol ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING)) - c AS fall FROM c)
SELECT symbol, round(sum(pnl), 6) AS total_return, round(greatest(max(fall), 0), 6) AS max_drawdown, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses, round(avg((pnl > 0)::INT), 6) AS win_rate FROM k GROUP BY 1""")
def a42(spark, sf_dir):
    return rounded(p.research_metrics(trips(spark, sf_dir), ["symbol"], ["exit_ts", "seq"]))


RUNS_SQL = """runs AS (SELECT o_custkey, o_orderkey AS run_id, o_orderdate::TIMESTAMP AS completed_at, o_totalprice / 150001.0::DOUBLE - 1 AS return_pct, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 200003.0::DOUBLE END AS sharpe,
CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 500009.0::DOUBLE END AS win_rate, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 40009.0::DOUBLE END AS drawdown_pct, o_orderkey % 40 AS trades FROM orders),
k AS (SELECT *, sum((return_pct >= 0)::INT) OVER (PARTITION BY o_custkey ORDER BY completed_at, run_id ROWS UNBOUNDED PRECEDING) AS streak FROM runs WHERE completed_at >= (SELECT max(completed_at) FROM runs) - INTERVAL 1500 DAY),
days AS (SELECT o_custkey, max(d) AS loss_days FROM (SELECT o_custkey, streak, count(DISTINCT completed_at::DATE) FILTER (WHERE return_pct < 0) AS d FROM k GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT o_custkey, count(*) AS total_runs, sum(trades)::BIGINT AS total_trades, avg(return_pct) AS avg_return, coalesce(avg(sharpe), 0) AS avg_sharpe, coalesce(avg(win_rate), 0) AS avg_win_rate, max(coalesce(drawdown_pct, 0)) AS max_drawdown_pct,
max(loss_days) AS loss_days, avg((return_pct > 0)::INT) AS positive_fraction FROM k JOIN days USING (o_custkey) GROUP BY 1)"""


def performance(spark, sf_dir):
    """Orders as a customer's runs, over 1500 days up to the last one. Divisors are prime to ten, so that rounding meets no ties."""
    o, price, st = table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderstatus")
    runs = o.select(
        "o_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("completed_at"), (price / 150_001 - 1).alias("return_pct"), F.when(st != "P", price / 200_003).alias("sharpe"),
        F.when(st != "O", price / 500_009).alias("win_rate"), F.when(price > 100_000, price / 40_009).alias("drawdown_pct"), (F.col("o_orderkey") % 40).alias("trades"),
    )
    return p.rolling_performance(runs, ["o_custkey"], o.agg(F.max(F.col("o_orderdate").cast("timestamp"))).scalar(), 1500)


@CAT.add("A44_rolling_performance", f"""WITH {RUNS_SQL} SELECT o_custkey, total_runs, total_trades, round(avg_return, 6) AS avg_return, round(avg_sharpe, 6) AS avg_sharpe, round(avg_win_rate, 6) AS avg_win_rate, round(max_drawdown_pct, 6) AS max_drawdown_pct,
loss_days, round(positive_fraction, 6) AS positive_fraction FROM m""")
def a44(spark, sf_dir):
    return rounded(performance(spark, sf_dir))


@CAT.add("X14_promotion", f"""WITH {RUNS_SQL}, g AS (SELECT *, ['CANDIDATE', 'PAPER', 'CANARY', 'SHADOW', 'LIVE'][o_custkey % 5 + 1] AS stage, o_custkey % 21 AS days FROM m),
l(stage, target, runs, min_days, sharpe, dd, win, trades, cons, approval) AS (VALUES ('CANDIDATE', 'PAPER', 5, 3, 0.3, 10, 0.35, 50, NULL, false), ('PAPER', 'CANARY', 10, 7, 0.3, 8, 0.35, NULL, NULL, true),
('CANARY', 'SHADOW', 20, 14, 0.3, 10, NULL, NULL, 0.6, true), ('SHADOW', 'LIVE', NULL, NULL, 0.3, 10, NULL, NULL, 0.6, true)),
f AS (SELECT o_custkey, g.stage, target, approval, CASE WHEN target IS NULL THEN 'path' ELSE concat_ws(',', CASE WHEN total_runs < runs THEN 'runs' END, CASE WHEN days < min_days THEN 'days' END, CASE WHEN avg_sharpe < sharpe THEN 'sharpe' END,
CASE WHEN max_drawdown_pct > dd THEN 'drawdown' END, CASE WHEN avg_win_rate < win THEN 'win_rate' END, CASE WHEN total_trades < l.trades THEN 'trades' END, CASE WHEN positive_fraction < cons THEN 'consistency' END) END AS failed FROM g LEFT JOIN l ON g.stage = l.stage)
SELECT o_custkey, stage, target AS target_stage, failed, failed = '' AS promote, coalesce(approval, false) AS needs_approval FROM f""")
def x14(spark, sf_dir):
    stages = F.array(*map(F.lit, p.STAGES))
    x = performance(spark, sf_dir).withColumns({"stage": F.element_at(stages, (F.col("o_custkey") % 5 + 1).cast("int")), "days_in_stage": F.col("o_custkey") % 21})
    return p.promotion(x).select("o_custkey", "stage", "target_stage", "failed", "promote", "needs_approval")


@CAT.add("X14_demotion", f"""WITH {RUNS_SQL}, g AS (SELECT *, ['CANDIDATE', 'PAPER', 'CANARY', 'SHADOW', 'LIVE', 'RETIRED'][o_custkey % 6 + 1] AS stage, o_custkey % 7 AS base, CASE WHEN o_custkey % 13 > 1 THEN (o_custkey % 11) / 10 END AS health, avg_sharpe - (o_custkey % 4) * 0.43::DOUBLE AS sharpe FROM m),
l(stage, back, least) AS (VALUES ('CANDIDATE', 'RETIRED', 0.5), ('PAPER', 'CANDIDATE', 0.3), ('CANARY', 'PAPER', 0.3), ('SHADOW', 'CANARY', 0.3), ('LIVE', 'SHADOW', NULL)),
w AS (SELECT o_custkey, g.stage, back, CASE WHEN sharpe < -0.5::DOUBLE THEN 'sharpe_catastrophic' WHEN base <> 0 AND max_drawdown_pct > base * 2 THEN 'drawdown' WHEN health < 0.2::DOUBLE THEN 'edge_decay' WHEN back IS NOT NULL AND loss_days > 5 THEN 'loss_days' WHEN back IS NOT NULL AND sharpe < least THEN 'sharpe' END AS why FROM g LEFT JOIN l ON g.stage = l.stage),
t AS (SELECT *, CASE WHEN why IN ('sharpe_catastrophic', 'drawdown', 'edge_decay') THEN 'RETIRED' WHEN why IS NOT NULL THEN back END AS to_stage FROM w)
SELECT o_custkey, stage, to_stage, why, why IS NOT NULL AS demote, CASE WHEN to_stage = 'RETIRED' THEN 'RETIRE' WHEN why IS NOT NULL THEN 'DEMOTE' ELSE 'WARNING' END AS severity FROM t""")
def x14_demotion(spark, sf_dir):
    key = F.col("o_custkey")
    x = performance(spark, sf_dir).withColumns({
        "stage": F.element_at(F.array(*map(F.lit, (*p.STAGES, "RETIRED"))), (key % 6 + 1).cast("int")), "backtest_drawdown": key % 7, "edge_health": F.when(key % 13 > 1, (key % 11) / 10),
        "avg_sharpe": F.col("avg_sharpe") - (key % 4) * 0.43,
    })
    return p.demotion(x).select("o_custkey", "stage", "to_stage", "why", "demote", "severity")


@CAT.add("X8b_ledger_status", """WITH t AS (SELECT o_orderkey, count(DISTINCT l_suppkey) <= 5 AS single, CASE WHEN count(l_orderkey) = 0 THEN 'NO_FILL_ACTIVITY' WHEN min(l_tax) > 0 THEN 'FILL_FEE_BACKED' ELSE 'FILL_FEE_MISSING' END AS fees,
CASE WHEN max(l_discount) < 0.05 THEN 'NO_FUNDING_EVENTS_OBSERVED' ELSE 'FUNDING_BACKED' END AS funding, CASE WHEN o_orderstatus = 'F' THEN 'FLAT' ELSE 'LONG' END AS direction,
CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS mark, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice * 0.001 END AS exit_fee FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_totalprice)
SELECT o_orderkey, CASE WHEN NOT single THEN 'MULTI_SYMBOL_UNSUPPORTED' WHEN fees = 'NO_FILL_ACTIVITY' THEN fees WHEN fees <> 'FILL_FEE_BACKED' THEN 'GROSS_ONLY_FEE_PARTIAL' WHEN funding <> 'FUNDING_BACKED' THEN 'NET_FEE_BACKED_FUNDING_PARTIAL'
WHEN direction = 'FLAT' THEN 'NET_FEE_BACKED_CLOSED_FUNDING_AWARE' WHEN mark IS NOT NULL THEN 'NET_FEE_BACKED_MARK_TO_MARKET_FUNDING_AWARE' ELSE 'NET_FEE_BACKED_MARK_PRICE_UNAVAILABLE_FUNDING_AWARE' END AS cost_status,
CASE WHEN NOT single THEN 'PROFITABILITY_UNSUPPORTED_MULTI_SYMBOL' WHEN fees = 'NO_FILL_ACTIVITY' THEN fees WHEN fees <> 'FILL_FEE_BACKED' THEN 'GROSS_ONLY_FEE_PARTIAL' WHEN funding <> 'FUNDING_BACKED' THEN 'PROFITABILITY_PARTIAL_FUNDING_MISSING'
WHEN direction = 'FLAT' THEN 'NET_AFTER_FEES_AND_FUNDING' WHEN mark IS NULL THEN 'PROFITABILITY_PARTIAL_MARK_PRICE_UNAVAILABLE' WHEN exit_fee IS NOT NULL THEN 'NET_MARK_TO_MARKET_AFTER_FEES_FUNDING_AND_EXIT_ESTIMATE' ELSE 'NET_MARK_TO_MARKET_AFTER_FEES_AND_FUNDING' END AS profit_status FROM t""")
def x8b(spark, sf_dir):
    """Orders as ledgers; their lines are the fills."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_distinct("l_suppkey").alias("s"), F.count("*").alias("n"), F.min("l_tax").alias("tax"), F.max("l_discount").alias("discount")
    )
    x = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    single = F.coalesce(F.col("s"), F.lit(0)) <= 5
    fees = p.first_of((F.col("n").isNull(), "NO_FILL_ACTIVITY"), (F.col("tax") > 0, "FILL_FEE_BACKED"), default="FILL_FEE_MISSING")
    funding = p.first_of((F.col("discount") < 0.05, "NO_FUNDING_EVENTS_OBSERVED"), default="FUNDING_BACKED")
    direction = p.first_of((F.col("o_orderstatus") == "F", "FLAT"), default="LONG")
    mark, exit_fee = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")), F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_totalprice") * 0.001)
    return x.select("o_orderkey", p.cost_status(single, fees, funding, direction, mark).alias("cost_status"), p.profit_status(single, fees, funding, direction, mark, exit_fee).alias("profit_status"))


@CAT.add("X15_sweep", f"""WITH {TICKS_SQL}, g AS (SELECT t.*, a.v AS threshold, b.v AS cost, c.v AS min_qty, (a.i * 2 + b.i) * 2 + c.i AS combo FROM ticks t, (VALUES (0, 10.0::DOUBLE), (1, 20.0), (2, 40.0)) a(i, v), (VALUES (0, 1.0::DOUBLE), (1, 5.0)) b(i, v), (VALUES (0, 0.0::DOUBLE), (1, 50.0)) c(i, v))
SELECT stream, combo, threshold, cost, min_qty, count(*) AS n, round(avg(price - threshold - cost), 6) AS mean_net FROM g WHERE price > threshold AND qty >= min_qty GROUP BY ALL""")
def x15(spark, sf_dir):
    g = p.with_grid(ticks(spark, sf_dir).select("stream", "price", "qty"), {"threshold": [10.0, 20.0, 40.0], "cost": [1.0, 5.0], "min_qty": [0.0, 50.0]})
    g = g.filter((F.col("price") > F.col("threshold")) & (F.col("qty") >= F.col("min_qty")))
    return rounded(g.groupBy("stream", "combo", "threshold", "cost", "min_qty").agg(F.count("*").alias("n"), F.avg(F.col("price") - F.col("threshold") - F.col("cost")).alias("mean_net")))


QUERIES, ORACLES = CAT.queries, CAT.oracles
