"""Queries over fills and accounts: purchases buy and errors sell the tick's quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import execution as x
from ..operators.features import recursive
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, table, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
FILLS_SQL = f"""{QUOTES_SQL}, fills AS (SELECT symbol, ts_event, seq, stream, side, qty, px AS fill_price, px * qty AS fill_value, px * qty * 4e-4::DOUBLE AS fee FROM (
SELECT *, CASE WHEN stream = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN stream = 'purchase' THEN ask_price ELSE bid_price END AS px FROM quotes WHERE stream IN ('purchase', 'error') AND qty > 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS k, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS w FROM fills)"""
POS_SQL = f"""WITH RECURSIVE {FILLS_SQL}, p AS (
SELECT symbol, k, ts_event, seq, w * qty AS size, fill_price AS entry, -fee AS realised FROM n WHERE k = 1
UNION ALL SELECT n.symbol, n.k, n.ts_event, n.seq, p.size + n.w * n.qty,
CASE WHEN p.size * n.w >= 0 THEN (abs(p.size) * p.entry + n.fill_value) / abs(p.size + n.w * n.qty) WHEN (p.size + n.w * n.qty) * n.w > 0 THEN n.fill_price WHEN p.size + n.w * n.qty = 0 THEN 0 ELSE p.entry END,
p.realised - n.fee + CASE WHEN p.size * n.w < 0 THEN least(n.qty, abs(p.size)) * (n.fill_price - p.entry) * sign(p.size) ELSE 0 END
FROM p JOIN n ON n.symbol = p.symbol AND n.k = p.k + 1)"""


def fills(spark, sf_dir):
    q = quotes(spark, sf_dir).filter("stream in ('purchase', 'error') and qty > 0")
    f = x.fills(q.withColumn("side", F.when(F.col("stream") == "purchase", "BUY").otherwise("SELL")))
    return f.select("symbol", "ts_event", "seq", "side", "qty", "fill_price", "fill_value", "fee")


@CAT.add("X1_fills", f"WITH {FILLS_SQL} SELECT seq, side, qty, round(fill_price, 6) AS fill_price, round(fill_value, 6) AS fill_value, round(fee, 6) AS fee FROM fills")
def x1(spark, sf_dir):
    return rounded(fills(spark, sf_dir).select("seq", "side", "qty", "fill_price", "fill_value", "fee"))


@CAT.add("X2_positions", f"{POS_SQL} SELECT seq, size, round(entry, 6) AS entry_price, round(realised, 5) AS realised FROM p")
def x2(spark, sf_dir):
    p = x.positions(fills(spark, sf_dir))
    return p.select("seq", "size", (F.round("entry_price", 6) + 0.0).alias("entry_price"), (F.round("realised", 5) + 0.0).alias("realised"))


@CAT.add("X3_equity", f"""{POS_SQL}, e AS (SELECT q.symbol, q.ts_event, q.seq, 10000 + coalesce(r.realised, 0) + coalesce(r.size * (q.mid - r.entry), 0) AS equity FROM quotes q LEFT JOIN LATERAL
(SELECT * FROM p WHERE p.symbol = q.symbol AND p.ts_event <= q.ts_event ORDER BY p.ts_event DESC, p.seq DESC LIMIT 1) r ON true), k AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT seq, round(equity, 5) AS equity, round(peak, 5) AS peak, round(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END, 5) AS drawdown FROM k""")
def x3(spark, sf_dir):
    q = quotes(spark, sf_dir).select("symbol", "ts_event", "seq", "mid")
    return rounded(x.equity(q, x.positions(fills(spark, sf_dir)), 10_000).select("seq", "equity", "peak", "drawdown"), 5)


@CAT.add("X4_average_cost_trips", f"""WITH RECURSIVE {FILLS_SQL}, p AS (SELECT symbol, k, seq, w * qty AS held, w * fill_value AS cost, fee AS fees, NULL::DOUBLE AS pnl FROM n WHERE k = 1
UNION ALL SELECT n.symbol, n.k, n.seq, p.held + n.w * n.qty, CASE WHEN n.w > 0 OR p.held <= 0 THEN p.cost + n.w * n.fill_value ELSE p.cost - n.qty * p.cost / p.held END,
CASE WHEN n.w > 0 OR p.held <= 0 THEN p.fees + n.fee ELSE p.fees - p.fees * (n.qty / p.held) END,
CASE WHEN n.w < 0 AND p.held > 0 THEN n.qty * n.fill_price - n.qty * p.cost / p.held - n.fee - p.fees * (n.qty / p.held) END FROM p JOIN n ON n.symbol = p.symbol AND n.k = p.k + 1)
SELECT seq, round(pnl, 5) AS pnl FROM p WHERE pnl IS NOT NULL""")
def x4(spark, sf_dir):
    return rounded(x.average_cost_trips(fills(spark, sf_dir)).select("seq", "pnl"), 5)


@CAT.add("X5_fifo_trips")
def x5(spark, sf_dir):
    return rounded(x.fifo_trips(fills(spark, sf_dir)).select("seq", "entry_ts", "pnl"), 5)


@CAT.add("X7_target_trades", f"""WITH {QUOTES_SQL}, t AS (SELECT *, CASE WHEN qty > 66 THEN 1 WHEN qty > 33 THEN 0 ELSE -1 END AS target FROM quotes), c AS (SELECT *, coalesce(lag(target) OVER o, 0) AS was FROM t WINDOW o AS (PARTITION BY symbol ORDER BY ts_event, seq)),
l AS (SELECT symbol, ts_event AS entry_ts, target, mid, lead(ts_event) OVER o AS exit_ts, lead(mid) OVER o AS ep FROM c WHERE target <> was WINDOW o AS (PARTITION BY symbol ORDER BY ts_event, seq))
SELECT symbol, entry_ts, exit_ts, target AS direction, round((ep - mid) * target, 6) AS pnl FROM l WHERE target <> 0 AND exit_ts IS NOT NULL""")
def x7(spark, sf_dir):
    t = quotes(spark, sf_dir).withColumn("target", F.when(F.col("qty") > 66, 1).when(F.col("qty") > 33, 0).otherwise(-1))
    return rounded(x.target_trades(t, ["symbol"], "target", "mid"))


@CAT.add("X9_funding", f"""{POS_SQL}, b AS (SELECT DISTINCT symbol, ts_event // 28800000 * 28800000 AS ts_event FROM quotes)
SELECT b.symbol, b.ts_event, CASE WHEN coalesce(r.size, 0) = 0 THEN 'FLAT' WHEN m.mid IS NULL THEN 'NO_MARK' ELSE 'APPLIED' END AS status, round(CASE WHEN coalesce(r.size, 0) = 0 THEN 0 ELSE r.size * m.mid * 0.0001 END, 6) AS funding_cost
FROM b LEFT JOIN LATERAL (SELECT size FROM p WHERE p.symbol = b.symbol AND p.ts_event <= b.ts_event ORDER BY p.ts_event DESC, p.seq DESC LIMIT 1) r ON true
LEFT JOIN LATERAL (SELECT mid FROM quotes q WHERE q.symbol = b.symbol AND q.ts_event <= b.ts_event ORDER BY q.ts_event DESC, q.seq DESC LIMIT 1) m ON true""")
def x9(spark, sf_dir):
    q = quotes(spark, sf_dir).select("symbol", "ts_event", "seq", "mid")
    b = q.select("symbol", (F.col("ts_event") - F.col("ts_event") % 28_800_000).alias("ts_event")).distinct().withColumn("seq", F.lit(0).cast("long"))
    return rounded(x.funding(b, x.positions(fills(spark, sf_dir)), q, F.lit(0.0001)).select("symbol", "ts_event", "status", "funding_cost"))


@CAT.add("X11_sizing", """SELECT p_partkey, round(least(1000 * 0.02 / (0.05 * p_retailprice), 1000 * (1 + p_size % 5) * 0.95 / p_retailprice), 8) AS units, round(p_retailprice * (1 - 1 / (1 + p_size % 5) + 0.005), 6) AS liquidation FROM part""")
def x11(spark, sf_dir):
    lev = (1 + F.col("p_size") % 5).cast("double")
    units = x.futures_size(F.lit(1000.0), F.lit(0.02), F.lit(0.05), F.col("p_retailprice"), lev)
    liq = x.liquidation_price(F.col("p_retailprice"), lev, F.lit(True))
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(units, 8) + 0.0).alias("units"), (F.round(liq, 6) + 0.0).alias("liquidation"))


@CAT.add("X17_fill_probability", "SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS p FROM orders")
def x17(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", x.fill_probability(F.col("o_orderkey").cast("string")).alias("p"))


@CAT.add("X12_risk_rules", f"""WITH {TICKS_SQL}, a AS (SELECT *, row_number() OVER o AS i, sum(price - 20) OVER (o ROWS UNBOUNDED PRECEDING) AS pnl, lag(price) OVER o AS entry, CASE WHEN qty >= 50 THEN 1 ELSE -1 END AS size FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY ts_event, seq)),
b AS (SELECT *, i - max(CASE WHEN qty > 80 THEN i END) OVER (PARTITION BY symbol ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING) AS since, min(round(pnl, 6)) OVER d - first_value(round(pnl, 6)) OVER d AS fall, (price - entry) / nullif(entry, 0) * size AS back FROM a WINDOW d AS (PARTITION BY symbol, ts_event // 86400000 ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING))
SELECT seq, coalesce(since >= 3, true) AS cooled, coalesce(fall < -0.02::DOUBLE * 1000, false) AS locked, CASE WHEN price <> 0 AND round(back, 9) >= 0.5::DOUBLE THEN 'take_profit' WHEN price <> 0 AND round(back, 9) <= -0.4::DOUBLE THEN 'stop_loss' END AS forced FROM b""")
def x12(spark, sf_dir):
    from pyspark.sql.window import Window

    o = Window.partitionBy("symbol").orderBy("ts_event", "seq")
    pnl = F.round(F.sum(F.col("price") - 20).over(o.rowsBetween(Window.unboundedPreceding, 0)), 6)
    t = ticks(spark, sf_dir).withColumns({"pnl": pnl, "entry": F.lag("price").over(o), "size": F.when(F.col("qty") >= 50, 1).otherwise(-1)})
    t = x.daily_loss_lock(x.cooldown(t, ["symbol"], F.col("qty") > 80, 3), ["symbol"], "pnl", 1000.0, 0.02)
    return t.select("seq", "cooled", "locked", x.forced_exit(F.col("size"), F.col("entry"), F.col("price"), 0.5, 0.4).alias("forced"))


@CAT.add("X18_gates", f"""WITH RECURSIVE {TICKS_SQL}, s AS (SELECT seq, stream, price, ts_event // 86400000 AS day, row_number() OVER (PARTITION BY stream, ts_event // 86400000 ORDER BY ts_event, seq) AS i FROM ticks),
r AS (SELECT stream, day, 0::BIGINT AS i, 0 AS n, 0::DOUBLE AS spent, NULL::BIGINT AS seq, '' AS gate FROM s GROUP BY 1, 2 UNION ALL SELECT stream, day, i, n + (gate = 'PASS')::INT, CASE WHEN gate = 'PASS' THEN spent + price ELSE spent END, seq, gate FROM (
SELECT s.*, n, spent, CASE WHEN NOT coalesce(price > 0.5, false) THEN 'REFUSED' WHEN n >= 5 THEN 'DAILY_ORDERS' WHEN spent + price > 60 THEN 'DAILY_NOTIONAL' ELSE 'PASS' END AS gate FROM r JOIN s ON s.stream = r.stream AND s.day = r.day AND s.i = r.i + 1))
SELECT seq, gate FROM r WHERE i > 0""")
def x18(spark, sf_dir):
    """Five orders and a sum of 60 a stream and day, of those that pass."""
    t = ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_event") / 86_400_000))
    return x.running_limits(t, ["stream", "day"], F.col("price") > 0.5, F.col("price"), 5, 60.0).select("seq", "gate")


@CAT.add("X12_max_positions", f"""WITH {TICKS_SQL}, a AS (SELECT seq, ts_event, symbol, week, CASE WHEN qty > 66 THEN 'LONG' WHEN qty > 33 THEN 'FLAT' ELSE 'SHORT' END AS action FROM ticks),
d AS (SELECT *, (action <> 'FLAT')::INT - coalesce(lag((action <> 'FLAT')::INT) OVER (PARTITION BY week, symbol ORDER BY ts_event, seq), 0) AS d FROM a)
SELECT seq, action = 'FLAT' OR coalesce(sum(d) OVER (PARTITION BY week ORDER BY ts_event, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS allowed FROM d""")
def x12_max(spark, sf_dir):
    """Positions as the actions of a week ask for them; ten open ones bar another action than an exit."""
    from ..operators.scans import number
    from pyspark.sql.window import Window

    a = F.when(F.col("qty") > 66, "LONG").when(F.col("qty") > 33, "FLAT").otherwise("SHORT")
    t = ticks(spark, sf_dir).select("seq", "ts_event", "symbol", "week", a.alias("action")).withColumn("open", (F.col("action") != "FLAT").cast("long"))
    o = Window.partitionBy("week", "symbol").orderBy("ts_event", "seq")
    t = t.withColumn("change", F.col("open") - F.coalesce(F.lag("open").over(o), F.lit(0)))
    t = number(t, ["week"], sums={"held": F.col("change")})
    return t.select("seq", x.max_positions(F.col("held") - F.col("change"), F.col("action"), 10).alias("allowed"))


@CAT.add("X19_curve_returns", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, ts_event, seq, price + 1 AS equity FROM ticks) SELECT seq, round((equity - lag(equity) OVER o) / lag(equity) OVER o, 6) AS "return", coalesce(ts_event >= lag(ts_event) OVER o, true) AS valid FROM c WINDOW o AS (PARTITION BY symbol ORDER BY seq)""")
def x19(spark, sf_dir):
    c = ticks(spark, sf_dir).select("symbol", "ts_event", "seq", (F.col("price") + 1).alias("equity"))
    return rounded(x.returns(c, ["symbol"]).select("seq", "return", "valid"))


@CAT.add("X20_crossover", f"""WITH {QUOTES_SQL}, e AS (SELECT seq, stream, week, ts_event, row_number() OVER o AS rn, list_reduce(list(mid) OVER o, lambda a, b: a + 0.2::DOUBLE * (b - a)) AS f, list_reduce(list(mid) OVER o, lambda a, b: a + (2.0::DOUBLE / 22) * (b - a)) AS s
FROM quotes WINDOW o AS (PARTITION BY stream, week ORDER BY ts_event, seq)), d AS (SELECT seq, rn, sign(f - s) AS d, lag(sign(f - s)) OVER (PARTITION BY stream, week ORDER BY ts_event, seq) AS b FROM e)
SELECT seq, (CASE WHEN rn >= 21 AND d <> 0 AND d IS DISTINCT FROM b THEN d ELSE 0 END)::DOUBLE AS signal FROM d""")
def x20(spark, sf_dir):
    return recursive(quotes(spark, sf_dir), ["stream", "week"], ["signal"], x.crossover_fold).select("seq", "signal")


@CAT.add("X21_sizing_caps", """SELECT l_orderkey, l_linenumber, least(l_quantity, 200 / (l_tax * 100 + 5), 600000 / l_extendedprice) AS qty, CASE WHEN l_quantity <= least(200 / (l_tax * 100 + 5), 600000 / l_extendedprice) THEN 'AS_REQUESTED' WHEN 200 / (l_tax * 100 + 5) <= 600000 / l_extendedprice THEN 'RISK_CAP' ELSE 'NOTIONAL_CAP' END AS reason FROM lineitem""")
def x21(spark, sf_dir):
    qty, reason = x.sized(200 / (F.col("l_tax") * 100 + 5), 600000 / F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", qty.alias("qty"), reason.alias("reason"))


@CAT.add("X22_templates", """SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'momentum' WHEN lower(p_type) LIKE '%brass%' THEN 'reversion' WHEN lower(p_type) LIKE '%tin%' THEN 'breakout' ELSE 'generic' END AS template FROM part""")
def x22(spark, sf_dir):
    from ..operators.rollups import first_of

    kind = F.lower("p_type")
    rules = [(kind.contains(k), name) for k, name in (("steel", "momentum"), ("brass", "reversion"), ("tin", "breakout"))]
    return table(spark, sf_dir, "part").select("p_partkey", first_of(*rules, default="generic").alias("template"))


QUERIES, ORACLES = CAT.queries, CAT.oracles
