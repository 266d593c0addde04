"""Queries over rollups and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rollups as r
from ..sources.events import TICKS_SQL, table, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
DAY = "ts_event // 86400000"


def day():
    return F.floor(F.col("ts_event") / 86_400_000).alias("day")


Q_SQL = f"""{TICKS_SQL}, q AS (SELECT symbol, {DAY} AS day, count(*) FILTER (WHERE stream = 'error' AND price > 60) AS dropped, max(qty) AS queue_pct, count(*) AS reconnects, sum(qty) AS drain_s,
coalesce(max(price * 10) FILTER (WHERE stream = 'view'), 0) AS primary_offline_s, max(price * 5) AS max_offline_s, min(qty * 4) FILTER (WHERE stream = 'click') AS primary_eps FROM ticks GROUP BY 1, 2),
b AS (SELECT *, dropped > 0 OR queue_pct >= 90 OR primary_offline_s > 600 AS bad, max_offline_s > 180 OR drain_s > 180 OR reconnects >= 5 AS degraded,
dropped = 0 AND max_offline_s < 300 AND queue_pct < 90 AS relaxed, primary_offline_s = 0 AND dropped = 0 AND queue_pct < 50 AND coalesce(primary_eps > 100, false) AS healthy FROM q),
w AS (SELECT *, CASE WHEN bad AND NOT relaxed THEN 'BAD' WHEN (bad OR degraded) AND NOT healthy THEN 'DEGRADED' ELSE 'GOOD' END AS quality FROM b)"""


def windows(spark, sf_dir):
    of = lambda s, v: F.max(F.when(F.col("stream") == s, v))
    q = ticks(spark, sf_dir).groupBy("symbol", day()).agg(
        F.count_if((F.col("stream") == "error") & (F.col("price") > 60)).alias("dropped"), F.max("qty").alias("queue_pct"), F.count("*").alias("reconnects"), F.sum("qty").alias("drain_s"),
        of("view", F.col("price") * 10).alias("primary_offline_s"), F.max(F.col("price") * 5).alias("max_offline_s"), F.min(F.when(F.col("stream") == "click", F.col("qty") * 4)).alias("primary_eps"),
    )
    names = ("dropped", "queue_pct", "reconnects", "drain_s", "primary_offline_s", "max_offline_s", "primary_eps")
    state, why = r.quality(*map(F.col, names))
    return q.withColumns({"quality": state, "reasons": why})


@CAT.add("A24_window_quality", f"WITH {Q_SQL} SELECT symbol, day, quality FROM w")
def a24(spark, sf_dir):
    return windows(spark, sf_dir).select("symbol", "day", "quality")


@CAT.add("A25_A26_day_quality", f"""WITH {Q_SQL}, d AS (SELECT day, count(*) AS windows, count(*) FILTER (WHERE quality = 'BAD') AS bad, count(*) FILTER (WHERE quality = 'DEGRADED') AS degraded FROM w GROUP BY 1)
SELECT *, CASE WHEN windows < 10 THEN 'PARTIAL' WHEN bad > 0 THEN 'BAD' WHEN degraded >= 5 THEN 'DEGRADED' ELSE 'GOOD' END AS day_quality FROM d""")
def a25(spark, sf_dir):
    return r.day_quality(windows(spark, sf_dir), ["day"], 10)


@CAT.add("A23_window_deltas", f"""WITH {TICKS_SQL}, b AS (SELECT stream, ts_event // 3600000 AS slot, count(*) AS n, max(price) AS peak FROM ticks GROUP BY 1, 2)
SELECT stream, slot, n, peak, n - lag(n) OVER (PARTITION BY stream ORDER BY slot) AS change, round(n / 3600.0::DOUBLE, 6) AS eps FROM b""")
def a23(spark, sf_dir):
    b = ticks(spark, sf_dir).groupBy("stream", F.floor(F.col("ts_event") / 3_600_000).alias("slot")).agg(F.count("*").alias("n"), F.max("price").alias("peak"))
    change = F.col("n") - F.lag("n").over(Window.partitionBy("stream").orderBy("slot"))
    return rounded(b.withColumns({"change": change, "eps": F.col("n") / 3600.0}))


@CAT.add("A27_completed_dates", "SELECT o_orderdate FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus IN ('F', 'O'))")
def a27(spark, sf_dir):
    return r.completed_dates(table(spark, sf_dir, "orders"), "o_orderdate", F.col("o_orderstatus").isin("F", "O"))


@CAT.add("A28_coverage", f"""WITH {TICKS_SQL} SELECT {DAY} AS day, count(DISTINCT stream) AS present, count(DISTINCT stream) >= 5 AS "full" FROM ticks GROUP BY 1""")
def a28(spark, sf_dir):
    return r.coverage(ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_event") / 86_400_000)), "day", "stream", 5)


@CAT.add("A29_sliding_days", f"""WITH {TICKS_SQL}, d AS (SELECT DISTINCT symbol, {DAY} AS day FROM ticks), w AS (SELECT symbol, min(day) OVER w AS first_day, day AS last_day, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 2 PRECEDING))
SELECT symbol, first_day, last_day FROM w WHERE n = 3""")
def a29(spark, sf_dir):
    return r.sliding_lists(ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_event") / 86_400_000)), ["symbol"], "day", 3)


@CAT.add("A29_last_windows", f"""WITH {TICKS_SQL}, d AS (SELECT symbol, day FROM (SELECT DISTINCT symbol, {DAY} AS day FROM ticks) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 12),
w AS (SELECT symbol, min(day) OVER w AS first_day, day AS last_day, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 2 PRECEDING)) SELECT symbol, first_day, last_day FROM w WHERE n = 3 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY last_day DESC) <= 4""")
def a29_last(spark, sf_dir):
    """The last four runs of three days, of a symbol's last twelve days."""
    return r.sliding_lists(ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_event") / 86_400_000)), ["symbol"], "day", 3, lookback=12, last=4)


@CAT.add("A30_context", f"""WITH {TICKS_SQL}, s AS (SELECT symbol, arg_min(price, (ts_event, seq)) AS first, arg_max(price, (ts_event, seq)) AS last, avg(price) AS mean, min(price) AS min, max(price) AS max, count(*) AS n FROM ticks GROUP BY 1)
SELECT symbol, first, last, round(mean, 6) AS mean, min, max, n, round((last - first) / nullif(first, 0) * 10000, 6) AS change_bps FROM s""")
def a30(spark, sf_dir):
    return rounded(r.summary(ticks(spark, sf_dir), ["symbol"], "price"))


O_SQL = f"{TICKS_SQL}, o AS (SELECT *, CASE WHEN qty < 40 THEN 'pass' WHEN qty < 80 THEN 'reject' ELSE 'skip' END AS outcome, CASE WHEN seq % 3 = 0 THEN NULL ELSE 'R' || (seq % 3) END AS reason FROM ticks)"


def outcomes(spark, sf_dir):
    o = F.when(F.col("qty") < 40, "pass").when(F.col("qty") < 80, "reject").otherwise("skip")
    reason = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("R"), (F.col("seq") % 3).cast("string")))
    return ticks(spark, sf_dir).withColumns({"outcome": o, "reason": reason})


@CAT.add("A31_A39_funnel", f"WITH {O_SQL} SELECT stream, count(*) AS total, count(*) FILTER (WHERE outcome = 'pass') AS pass, count(*) FILTER (WHERE outcome = 'reject') AS reject, count(*) FILTER (WHERE outcome = 'skip') AS skip FROM o GROUP BY 1")
def a31(spark, sf_dir):
    return r.funnel(outcomes(spark, sf_dir), "stream", "outcome")


@CAT.add("A32_reasons", f"WITH {O_SQL} SELECT stream, coalesce(reason, 'UNKNOWN') AS reason, count(*) AS n FROM o GROUP BY 1, 2")
def a32(spark, sf_dir):
    return r.reasons(outcomes(spark, sf_dir), "stream", "reason")


@CAT.add("A33_A34_decisions", f"""WITH {O_SQL} SELECT symbol, min(ts_event) AS first_seen, count(*) AS events, CASE WHEN max(ts_event) > min(ts_event) THEN arg_max(outcome, (ts_event, seq)) END AS final_outcome FROM o GROUP BY 1""")
def a33(spark, sf_dir):
    return r.decisions(outcomes(spark, sf_dir), "symbol", "outcome")


@CAT.add("A35_A36_A37_pnl_bias", """WITH s AS (SELECT c_nationkey, CASE WHEN c_acctbal IS NULL THEN 'UNKNOWN' WHEN c_acctbal > 3000 THEN 'GAIN' WHEN c_acctbal < -3000 THEN 'LOSS' ELSE 'FLAT' END AS s FROM (SELECT c_nationkey, c_acctbal - 4500 AS c_acctbal FROM customer)),
c AS (SELECT c_nationkey, count(*) FILTER (WHERE s = 'GAIN') AS gains, count(*) FILTER (WHERE s = 'LOSS') AS losses, count(*) FILTER (WHERE s = 'FLAT') AS flats FROM s GROUP BY 1)
SELECT *, CASE WHEN gains > losses AND gains > flats THEN 'GAIN' WHEN losses > gains AND losses > flats THEN 'LOSS' WHEN flats > gains AND flats > losses THEN 'FLAT' ELSE 'MIXED' END AS bias FROM c""")
def a35(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_nationkey", r.pnl_state(F.col("c_acctbal") - 4500, 3000).alias("s"))
    n = lambda s: F.count_if(F.col("s") == s)
    c = x.groupBy("c_nationkey").agg(n("GAIN").alias("gains"), n("LOSS").alias("losses"), n("FLAT").alias("flats"))
    return c.withColumn("bias", r.bias(F.col("gains"), F.col("losses"), F.col("flats")))


@CAT.add("A38_slippage", """WITH b AS (SELECT l_suppkey, floor((l_extendedprice / (l_quantity * 1500) - 1) * 10000 + 0.5) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS b, l_extendedprice AS w FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(avg(b), 6) AS avg_bps, max(b) AS worst_bps, round(sum(b * w) / sum(w), 6) AS weighted_bps FROM b GROUP BY 1""")
def a38(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    x = table(spark, sf_dir, "lineitem")
    return rounded(r.slippage(x, ["l_suppkey"], F.col("l_quantity") * 1500, F.col("l_extendedprice"), F.col("l_extendedprice"), side))


@CAT.add("A40_A43_metrics", f"""WITH {TICKS_SQL}, d AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS pnl FROM ticks), e AS (SELECT *, coalesce(sum(pnl) OVER w, 0) AS equity FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING), 0) AS peak FROM e)
SELECT symbol, count(pnl) AS trades, round(sum(pnl), 6) AS total, round(max(peak - equity), 6) AS max_drawdown, round(avg((pnl > 0)::INT), 6) AS win_rate, round(avg(pnl), 6) AS avg_pnl FROM p GROUP BY 1""")
def a40(spark, sf_dir):
    o = Window.partitionBy("symbol").orderBy("ts_event", "seq")
    up = o.rowsBetween(Window.unboundedPreceding, 0)
    x = ticks(spark, sf_dir).withColumn("pnl", F.col("price") - F.lag("price").over(o))
    x = x.withColumn("equity", F.coalesce(F.sum("pnl").over(up), F.lit(0.0)))
    x = x.withColumn("peak", F.greatest(F.max("equity").over(up), F.lit(0.0)))
    return rounded(x.groupBy("symbol").agg(
        F.count("pnl").alias("trades"), F.sum("pnl").alias("total"), F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.avg("pnl").alias("avg_pnl"),
    ))


@CAT.add("A44_R15_loss_runs", f"""WITH {TICKS_SQL}, h AS (SELECT symbol, ts_event, seq, (price < 10)::INT AS h FROM ticks), i AS (SELECT *, sum(1 - h) OVER (PARTITION BY symbol ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING) AS g FROM h),
n AS (SELECT symbol, g, sum(h) AS n FROM i GROUP BY 1, 2) SELECT symbol, max(n)::BIGINT AS longest FROM n GROUP BY 1""")
def a44(spark, sf_dir):
    return r.longest_runs(ticks(spark, sf_dir), ["symbol"], ["ts_event", "seq"], F.col("price") < 10)


@CAT.add("A45_slo", f"""WITH {TICKS_SQL}, v AS (SELECT stream, week, avg((price < 60)::INT) AS v FROM ticks GROUP BY 1, 2) SELECT stream, week, round(v, 6) AS value, CASE WHEN v >= 0.95 THEN 'MET' WHEN v >= 0.9 THEN 'WARNING' ELSE 'BREACHED' END AS status, round((v - 0.95) / 0.05, 6) AS budget_left FROM v""")
def a45(spark, sf_dir):
    v = ticks(spark, sf_dir).groupBy("stream", "week").agg(F.avg((F.col("price") < 60).cast("int")).alias("value"))
    status = r.slo(F.col("value"), F.lit(0.95), F.lit(0.9), F.lit(True))
    return rounded(v.withColumns({"status": status, "budget_left": (F.col("value") - 0.95) / 0.05}))


@CAT.add("A46_A49_guards", """WITH d AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0) AS ratio, max(o_totalprice) AS peak, max(o_orderdate) AS seen FROM orders GROUP BY 1)
SELECT o_custkey, round(ratio, 6) AS ratio, peak, CASE WHEN ratio IS NULL THEN 'NO_DATA' WHEN ratio < 0.4 THEN 'DETERMINISM' WHEN peak > 450000 THEN 'RESOURCE' ELSE 'PASS' END AS guard,
CASE WHEN date_diff('day', seen::DATE, DATE '2000-01-01') <= 365 THEN 'RECENT' WHEN date_diff('day', seen::DATE, DATE '2000-01-01') <= 1000 THEN 'STALE' ELSE 'OLD' END AS recency FROM d""")
def a46(spark, sf_dir):
    n = lambda c: F.count_if(c)
    status = F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.try_divide(n(status == "F").cast("double"), n(status != "P")).alias("ratio"), F.max("o_totalprice").alias("peak"), F.max("o_orderdate").alias("seen")
    )
    guard = r.first_of((F.col("ratio").isNull(), "NO_DATA"), (F.col("ratio") < 0.4, "DETERMINISM"), (F.col("peak") > 450_000, "RESOURCE"), default="PASS")
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.col("seen").cast("date"))
    recency = r.first_of((age <= 365, "RECENT"), (age <= 1000, "STALE"), default="OLD")
    return rounded(d.select("o_custkey", "ratio", "peak", guard.alias("guard"), recency.alias("recency")))


@CAT.add("A47_A50_family_metrics", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, round(median(c_acctbal), 6) AS median_balance, count(*) AS n FROM customer GROUP BY 1")
def a47(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.percentile("c_acctbal", 0.5).alias("median_balance"), F.count("*").alias("n")))


@CAT.add("R3_score_by_label", f"""WITH {TICKS_SQL} SELECT qty > 50 AS label, count(*) AS n, round(avg(price), 6) AS mean_score, round(stddev_pop(price), 6) AS std_score, max(price) AS top FROM ticks GROUP BY 1""")
def r3(spark, sf_dir):
    return rounded(ticks(spark, sf_dir).groupBy((F.col("qty") > 50).alias("label")).agg(F.count("*").alias("n"), F.avg("price").alias("mean_score"), F.stddev_pop("price").alias("std_score"), F.max("price").alias("top")))


@CAT.add("R4_stage_one", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, stream, count(*) AS n, avg(price - 20) AS m, avg(price - 20) / nullif(stddev_samp(price) / sqrt(count(*)), 0) AS t FROM ticks GROUP BY 1, 2)
SELECT symbol, stream, n, round(abs(t) * greatest(m, 0), 6) AS score FROM c WHERE n >= 5 AND abs(t) >= 0.5""")
def r4(spark, sf_dir):
    v = F.col("price") - 20
    c = ticks(spark, sf_dir).groupBy("symbol", "stream").agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.try_divide(F.avg(v), F.stddev_samp("price") / F.sqrt(F.count("*"))).alias("t"))
    return rounded(c.filter("n >= 5 and abs(t) >= 0.5").select("symbol", "stream", "n", (F.abs("t") * F.greatest(F.col("m"), F.lit(0.0))).alias("score")))


@CAT.add("R4_ranked_cells", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, stream, count(*) AS n, avg(price - 20) AS m, avg(price - 20) / nullif(stddev_samp(price) / sqrt(count(*)), 0) AS t FROM ticks GROUP BY 1, 2),
s AS (SELECT *, round(abs(t) * greatest(m, 0), 6) AS score FROM c WHERE n >= 5 AND abs(t) >= 0.5) SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, round(abs(t), 6) DESC, n DESC, round(abs(m), 6) DESC, stream, symbol) AS rank, symbol, stream, n, score FROM s) WHERE rank <= 20""")
def r4_ranked(spark, sf_dir):
    v = F.col("price") - 20
    c = ticks(spark, sf_dir).groupBy("symbol", "stream").agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.try_divide(F.avg(v), F.stddev_samp("price") / F.sqrt(F.count("*"))).alias("t"))
    c = c.filter("n >= 5 and abs(t) >= 0.5").withColumn("score", F.round(F.abs("t") * F.greatest(F.col("m"), F.lit(0.0)), 6))
    order = [F.desc("score"), F.round(F.abs("t"), 6).desc(), F.desc("n"), F.round(F.abs("m"), 6).desc(), F.col("stream"), F.col("symbol")]
    top = c.orderBy(*order).limit(20)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "symbol", "stream", "n", "score")


@CAT.add("R8_transitions", f"""WITH {TICKS_SQL}, s AS (SELECT *, lag(stream) OVER o AS f FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY ts_event, seq)), c AS (SELECT *, lag(ts_event) OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS since FROM s WHERE f IS NULL OR f <> stream)
SELECT symbol, f || '->' || stream AS transition, count(*) AS n, round(avg(ts_event - since), 6) AS avg_ms FROM c WHERE f IS NOT NULL GROUP BY 1, 2""")
def r8(spark, sf_dir):
    return rounded(r.transitions(ticks(spark, sf_dir), ["symbol"], "stream"))


@CAT.add("R8_state_times", f"""WITH {TICKS_SQL}, g AS (SELECT symbol, stream, lead(ts_event) OVER (PARTITION BY symbol ORDER BY ts_event, seq) - ts_event AS gap FROM ticks)
SELECT symbol, stream, count(*) AS n, count(gap) AS gaps, round(avg(gap), 6) AS avg_ms, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM g GROUP BY 1, 2""")
def r8_states(spark, sf_dir):
    return rounded(r.state_times(ticks(spark, sf_dir), ["symbol"], "stream"))


@CAT.add("R5_cell_summary", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, week, count(*) AS n, avg(price - 12) AS m, avg(price - 12) / nullif(stddev_samp(price - 12) / sqrt(count(*)), 0) AS t FROM ticks GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN n < 3 THEN 'INSUFFICIENT_SUPPORT' WHEN abs(coalesce(t, 0)) >= 1.5 AND m > 0 THEN 'DIRECTIONAL' WHEN abs(coalesce(t, 0)) >= 1.5 AND m < 0 THEN 'ANTI_EDGE' ELSE 'NO_EDGE' END AS verdict FROM c),
s AS (SELECT symbol, count(*) AS windows, count(*) FILTER (WHERE verdict = 'DIRECTIONAL') AS directional, count(*) FILTER (WHERE verdict = 'ANTI_EDGE') AS anti_edge, count(*) FILTER (WHERE verdict = 'NO_EDGE') AS no_edge, count(*) FILTER (WHERE verdict = 'INSUFFICIENT_SUPPORT') AS insufficient,
median(m) AS median_mean, list_sort(list(m))[(count(*) - 1) // 10 + 1] AS p10_mean, min(m) AS min_mean FROM v GROUP BY 1)
SELECT * REPLACE (round(median_mean, 6) AS median_mean, round(p10_mean, 6) AS p10_mean, round(min_mean, 6) AS min_mean), round(directional / windows, 6) AS directional_rate, windows = 5 AND insufficient = 0 AND median_mean >= 2 AND p10_mean >= -1 AND directional / windows >= 0.4::DOUBLE AS promising FROM s""")
def r5_summary(spark, sf_dir):
    """Symbols as cells and weeks as windows."""
    from ..operators.stats import t_stat

    v, t, m = F.col("price") - 12, F.abs("t"), F.col("mean")
    x = ticks(spark, sf_dir).groupBy("symbol", "week").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), t_stat(v).alias("t"))
    verdict = r.first_of((F.col("n") < 3, "INSUFFICIENT_SUPPORT"), ((t >= 1.5) & (m > 0), "DIRECTIONAL"), ((t >= 1.5) & (m < 0), "ANTI_EDGE"), default="NO_EDGE")
    return rounded(r.cell_summary(x.withColumn("verdict", verdict), ["symbol"], 5, 2.0, -1.0, 0.4))


@CAT.add("R9_confidence_buckets", f"""WITH {TICKS_SQL} SELECT stream, count(*) AS n, round(sum(coalesce(price, 0)) / count(*), 6) AS avg_confidence, count(*) FILTER (WHERE price < 10) AS low, count(*) FILTER (WHERE price >= 10 AND price < 30) AS medium, count(*) FILTER (WHERE price >= 30) AS high FROM ticks GROUP BY 1""")
def r9(spark, sf_dir):
    p = F.col("price")
    return rounded(ticks(spark, sf_dir).groupBy("stream").agg(
        F.count("*").alias("n"), (F.sum(F.coalesce(p, F.lit(0.0))) / F.count("*")).alias("avg_confidence"), F.count_if(p < 10).alias("low"), F.count_if((p >= 10) & (p < 30)).alias("medium"), F.count_if(p >= 30).alias("high"),
    ))


@CAT.add("R10_incidents", """WITH i AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate AS opened, min(l_shipdate) AS resolved FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT max(opened) AS now FROM i)
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS acknowledged, count(*) FILTER (WHERE o_orderstatus = 'F') AS resolved,
count(*) FILTER (WHERE opened > now - INTERVAL 1 DAY) AS last_day, round(avg((epoch_ms(resolved) - epoch_ms(opened)) / 3600000.0::DOUBLE) FILTER (WHERE o_orderstatus = 'F' AND resolved IS NOT NULL), 6) AS mttr_hours FROM i, n GROUP BY 1""")
def r10(spark, sf_dir):
    """Orders as incidents: opened when ordered, resolved when the first line ships; the last day ends with the last order."""
    st, o = F.col("o_orderstatus"), table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("resolved"))
    i = o.join(shipped, "o_orderkey", "left").withColumn("now", o.agg(F.max("o_orderdate")).scalar())
    hours = (F.unix_millis(F.col("resolved").cast("timestamp")) - F.unix_millis(F.col("o_orderdate").cast("timestamp"))) / 3_600_000.0
    return rounded(i.groupBy("o_orderpriority").agg(
        F.count_if(st == "O").alias("open"), F.count_if(st == "P").alias("acknowledged"), F.count_if(st == "F").alias("resolved"),
        F.count_if(F.col("o_orderdate") > F.col("now") - F.expr("interval 1 day")).alias("last_day"), F.avg(F.when(st == "F", hours)).alias("mttr_hours"),
    ))


@CAT.add("R11_costs", """SELECT l_returnflag, l_linestatus, round(sum(round(l_quantity * l_tax, 6)), 4) AS cost, count(*) AS jobs FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def r11(spark, sf_dir):
    return r.costs(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_tax"), "l_returnflag", "l_linestatus")


@CAT.add("R12_daily_health", f"""WITH {TICKS_SQL} SELECT {DAY} AS day, count(*) FILTER (WHERE stream = 'error') AS alerts, array_to_string(list_sort(list(DISTINCT stream)), ',') AS types FROM ticks GROUP BY 1""")
def r12(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy(day()).agg(F.count_if(F.col("stream") == "error").alias("alerts"), F.array_join(F.sort_array(F.collect_set("stream")), ",").alias("types"))


@CAT.add("R14_bias_mode", f"""WITH {TICKS_SQL}, s AS (SELECT symbol, stddev_pop(price) / avg(price) AS v, avg(qty) AS q FROM ticks GROUP BY 1)
SELECT symbol, CASE WHEN v > 1.1 AND q > 50 THEN 'CONTRARIAN' WHEN v > 1.1 THEN 'CAUTIOUS' WHEN q > 50 THEN 'TREND_FOLLOWING' ELSE 'NEUTRAL' END AS mode FROM s""")
def r14(spark, sf_dir):
    s = ticks(spark, sf_dir).groupBy("symbol").agg((F.stddev_pop("price") / F.avg("price")).alias("v"), F.avg("qty").alias("q"))
    mode = r.first_of(((F.col("v") > 1.1) & (F.col("q") > 50), "CONTRARIAN"), (F.col("v") > 1.1, "CAUTIOUS"), (F.col("q") > 50, "TREND_FOLLOWING"), default="NEUTRAL")
    return s.select("symbol", mode.alias("mode"))


QUERIES, ORACLES = CAT.queries, CAT.oracles
