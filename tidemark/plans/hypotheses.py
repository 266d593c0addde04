"""Queries over hypothesis grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypotheses as h
from ..operators.stats import index_quantile
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
D, H = (3_600_000, 21_600_000), (3_600_000, 14_400_000)
BY = ["stream"]


def moves_sql(value: str, tolerance: int | None, where: str = "") -> str:
    near = lambda gap: f"AND abs(s.ts_event - {gap}) <= {tolerance}" if tolerance is not None else ""
    past = ", ".join(f"(SELECT struct_pack(v := s.v, t := s.ts_event) FROM s WHERE s.stream = a.stream AND s.ts_event <= a.ts_event - {d} ORDER BY s.ts_event DESC, s.seq DESC LIMIT 1) AS p{d}" for d in D)
    nxt = ", ".join(f"(SELECT struct_pack(v := s.v, t := s.ts_event) FROM s WHERE s.stream = a.stream AND s.ts_event >= a.ts_event + {x} ORDER BY s.ts_event, s.seq LIMIT 1) AS n{x}" for x in H)
    del near
    fine = lambda c, at: f"CASE WHEN abs({c}.t - ({at})) <= {tolerance} THEN {c}.v END" if tolerance is not None else f"{c}.v"
    cells = " UNION ALL ".join(f"SELECT stream, {d} AS delta_ms, {x} AS h_ms, v, {fine(f'p{d}', f'ts_event - {d}')} AS p, {fine(f'n{x}', f'ts_event + {x}')} AS f FROM m" for d in D for x in H)
    return f"s AS (SELECT stream, ts_event, seq, {value} AS v FROM quotes {where}), m AS (SELECT a.*, {past}, {nxt} FROM s a), g AS ({cells})"


PRODUCT = "SELECT stream, delta_ms, h_ms, count(*) AS n, round(avg(x), 2) AS mean_product, round(coalesce(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 0), 6) AS t_stat FROM (SELECT *, {x} AS x FROM g WHERE p IS NOT NULL AND f IS NOT NULL) GROUP BY 1, 2, 3"
BPS = "((v / p - 1) * 10000) * ((f / v - 1) * 10000)"


@CAT.add("A13_momentum_grid", f"WITH {QUOTES_SQL}, {moves_sql('mid', 3_600_000)} {PRODUCT.format(x=BPS)}")
def a13(spark, sf_dir):
    return rounded(h.product_grid(quotes(spark, sf_dir), BY, "mid", D, H, 3_600_000).withColumn("mean_product", F.round("mean_product", 2)))


@CAT.add("A14_reversal_grid", f"WITH {QUOTES_SQL}, {moves_sql('mid', None)} {PRODUCT.format(x=BPS)}")
def a14(spark, sf_dir):
    return rounded(h.product_grid(quotes(spark, sf_dir), BY, "mid", D, H).withColumn("mean_product", F.round("mean_product", 2)))


@CAT.add("A15_spread_reversion", f"WITH {QUOTES_SQL}, {moves_sql('(ask_price - bid_price) / mid * 10000', 3_600_000)} {PRODUCT.format(x='(v - p) * (f - v)')}")
def a15(spark, sf_dir):
    q = quotes(spark, sf_dir).filter("ask_price >= bid_price").withColumn("spread_bps", (F.col("ask_price") - F.col("bid_price")) / F.col("mid") * 10000)
    return rounded(h.product_grid(q, BY, "spread_bps", D, H, 3_600_000, relative=False).withColumn("mean_product", F.round("mean_product", 2)))


def volatility_sql(past: str) -> str:
    cols = ", ".join([f"{past.format(d=d - 1)} AS p{d}" for d in D] + [f"sqrt(sum(r2) OVER (PARTITION BY stream ORDER BY ts_event RANGE BETWEEN 1 FOLLOWING AND {x} FOLLOWING)) AS n{x}" for x in H])
    cells = " UNION ALL ".join(f"SELECT stream, {d} AS delta_ms, {x} AS h_ms, p{d}::DOUBLE AS p, n{x} AS f FROM w" for d in D for x in H)
    return f"""WITH {QUOTES_SQL}, r AS (SELECT *, pow(ln(mid / lag(mid) OVER (PARTITION BY stream ORDER BY ts_event, seq)), 2) AS r2 FROM quotes), w AS (SELECT stream, {cols} FROM r), g AS ({cells}),
c AS (SELECT stream, delta_ms, h_ms, count(*) AS n, avg(p) AS mp, avg(f) AS mf, corr(p, f) AS r FROM g WHERE p IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2, 3)
SELECT stream, delta_ms, h_ms, n, round(mp, 6) AS mean_past, round(mf, 6) AS mean_next, round(r, 6) AS corr, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t_stat FROM c"""


@CAT.add("A11_volatility_clustering", volatility_sql("sqrt(sum(r2) OVER (PARTITION BY stream ORDER BY ts_event RANGE BETWEEN {d} PRECEDING AND CURRENT ROW))"))
def a11(spark, sf_dir):
    return rounded(h.volatility_grid(quotes(spark, sf_dir), BY, "mid", D, H))


@CAT.add("A12_activity_volatility", volatility_sql("count(*) OVER (PARTITION BY stream ORDER BY ts_event RANGE BETWEEN {d} PRECEDING AND CURRENT ROW)"))
def a12(spark, sf_dir):
    return rounded(h.volatility_grid(quotes(spark, sf_dir), BY, "mid", D, H, activity=True))


@CAT.add("A16_jump_reversion", f"""WITH RECURSIVE {QUOTES_SQL}, r AS (SELECT stream, ts_event, seq, mid, mid / lag(mid) OVER (PARTITION BY stream ORDER BY ts_event, seq) - 1 AS jump FROM quotes),
j AS (SELECT * FROM r WHERE abs(jump) >= 2), k AS (SELECT stream, min(ts_event) AS ts_event FROM j GROUP BY 1 UNION ALL
SELECT k.stream, (SELECT min(j.ts_event) FROM j WHERE j.stream = k.stream AND j.ts_event >= k.ts_event + 7200000) FROM k WHERE k.ts_event IS NOT NULL),
a AS (SELECT j.* FROM j JOIN k ON j.stream = k.stream AND j.ts_event = k.ts_event QUALIFY row_number() OVER (PARTITION BY j.stream, j.ts_event ORDER BY j.seq) = 1),
g AS (SELECT a.stream, h.h AS h_ms, sign(a.jump) * ((SELECT q.mid FROM quotes q WHERE q.stream = a.stream AND q.ts_event >= a.ts_event + h.h ORDER BY q.ts_event, q.seq LIMIT 1) / a.mid - 1) AS r FROM a, (VALUES (3600000), (14400000)) h(h))
SELECT stream, h_ms, count(*) AS n, round(avg(r), 6) AS mean, round(coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 0), 6) AS t_stat FROM g WHERE r IS NOT NULL GROUP BY 1, 2""")
def a16(spark, sf_dir):
    return rounded(h.jump_reversion(quotes(spark, sf_dir), BY, "mid", 2.0, 7_200_000, H))


PAIRS = (("click", "view"), ("view", "purchase"))
LEAD_SQL = f"""{QUOTES_SQL}, pairs(lead, follow) AS (VALUES ('click', 'view'), ('view', 'purchase')),
l AS (SELECT * FROM (SELECT symbol, stream, ts_event, seq, sign(mid - lag(mid) OVER (PARTITION BY symbol, stream ORDER BY ts_event, seq)) AS s FROM quotes) WHERE s <> 0),
sig AS (SELECT l.*, lead || '>' || follow AS pair, follow FROM l JOIN pairs ON lead = stream)"""


@CAT.add("A17_A18_lead_lag", f"""WITH {LEAD_SQL}, d AS (SELECT sig.*, delta_ms FROM sig, (VALUES (3600000), (21600000)) x(delta_ms)),
c AS (SELECT d.*, f.ts_event AS t, f.mid AS v FROM d JOIN quotes f ON f.symbol = d.symbol AND f.stream = d.follow AND abs(f.ts_event - d.ts_event - delta_ms) <= 86400000
QUALIFY row_number() OVER (PARTITION BY d.pair, d.symbol, d.seq, delta_ms ORDER BY abs(f.ts_event - d.ts_event - delta_ms), f.ts_event, f.seq) = 1),
h AS (SELECT c.*, h_ms FROM c, (VALUES (7200000), (14400000)) x(h_ms)),
e AS (SELECT h.*, 10000 * s * ln(f.mid / v) AS r FROM h JOIN quotes f ON f.symbol = h.symbol AND f.stream = h.follow AND f.ts_event >= t + h_ms
QUALIFY row_number() OVER (PARTITION BY h.pair, h.symbol, h.seq, delta_ms, h_ms ORDER BY f.ts_event, f.seq) = 1),
u AS (SELECT symbol, pair, count(DISTINCT seq) AS support FROM e GROUP BY 1, 2)
SELECT symbol, pair, delta_ms, h_ms, count(*) AS n, round(avg(r), 6) AS mean_bps, round(coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 0), 6) AS t_stat, max(support) AS support FROM e JOIN u USING (symbol, pair) GROUP BY 1, 2, 3, 4""")
def a17(spark, sf_dir):
    q = quotes(spark, sf_dir).select("symbol", "stream", "ts_event", "seq", "mid")
    return rounded(h.lead_lag(q, ["symbol"], "stream", "mid", PAIRS, D, (7_200_000, 14_400_000), 86_400_000))


@CAT.add("A19_quantile_momentum", f"""WITH {QUOTES_SQL}, {moves_sql('mid', None)}, m1 AS (SELECT stream, (v / p - 1) * 10000 AS past, (f / v - 1) * 10000 AS future FROM g WHERE p IS NOT NULL AND f IS NOT NULL AND delta_ms = 3600000 AND h_ms = 3600000),
i AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY past) AS k, count(*) OVER (PARTITION BY stream) AS c FROM m1), c AS (SELECT stream, max(past) FILTER (WHERE k = floor(0.8 * (c - 1)) + 1) AS cut FROM i GROUP BY 1)
SELECT stream, round(max(cut), 6) AS cut, count(*) AS n, round(avg(future), 6) AS mean_future FROM m1 JOIN c USING (stream) WHERE past >= cut GROUP BY 1""")
def a19(spark, sf_dir):
    q = h.with_moves(quotes(spark, sf_dir), BY, "mid", D[:1], H[:1], None)
    bps = lambda a, b: (F.col(b) / F.col(a) - 1) * 10000
    x = q.select("stream", bps(f"past_{D[0]}", "mid").alias("past"), bps("mid", f"next_{H[0]}").alias("future")).dropna()
    cut = index_quantile(x, BY, "past", 0.8, last=True).withColumnRenamed("quantile", "cut")
    hit = x.join(cut, "stream").filter(F.col("past") >= F.col("cut"))
    return rounded(hit.groupBy("stream").agg(F.max("cut").alias("cut"), F.count("*").alias("n"), F.avg("future").alias("mean_future")))


def feasibility_sql(rise: str, fall: str, fee: float) -> str:
    numbers = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(quantile_disc({c}, 0.1), 6) AS {c}_p10" for c in ("gross", "penalty", "net"))
    return f"""WITH {LEAD_SQL}, q AS (SELECT *, min(mid) OVER w AS lo, max(mid) OVER w AS hi FROM quotes WINDOW w AS (PARTITION BY symbol, stream ORDER BY ts_event RANGE BETWEEN CURRENT ROW AND 86400000 FOLLOWING)),
a AS (SELECT sig.symbol, sig.pair, sig.follow, sig.seq, s, f.ts_event AS t, f.bid_price AS bid, f.ask_price AS ask, f.mid, lo, hi FROM sig JOIN q f ON f.symbol = sig.symbol AND f.stream = sig.follow AND abs(f.ts_event - sig.ts_event - 3600000) <= 86400000
QUALIFY row_number() OVER (PARTITION BY sig.pair, sig.symbol, sig.seq ORDER BY abs(f.ts_event - sig.ts_event - 3600000), f.ts_event, f.seq) = 1),
b AS (SELECT a.*, f.bid_price AS xbid, f.ask_price AS xask FROM a JOIN q f ON f.symbol = a.symbol AND f.stream = a.follow AND abs(f.ts_event - t - 7200000) <= 86400000
QUALIFY row_number() OVER (PARTITION BY a.pair, a.symbol, a.seq ORDER BY abs(f.ts_event - t - 7200000), f.ts_event, f.seq) = 1),
g AS (SELECT symbol, pair, 10000 * CASE WHEN s > 0 THEN ln(xbid / {rise}) ELSE ln({fall} / xask) END AS gross, greatest(10000 * CASE WHEN s > 0 THEN ln(mid / lo) ELSE ln(hi / mid) END, 0) AS penalty FROM b),
n AS (SELECT *, gross - penalty - {fee} AS net FROM g)
SELECT symbol, pair, count(*) AS n, {numbers}, round(min(gross), 6) AS gross_min, round(max(penalty), 6) AS penalty_max, round(min(net), 6) AS net_min, round(avg((net > 0)::INT), 6) AS pos_rate FROM n GROUP BY 1, 2"""


def _feasible(spark, sf_dir, maker: bool):
    q = quotes(spark, sf_dir).select("symbol", "stream", "ts_event", "seq", "bid_price", "ask_price", "mid")
    return rounded(h.feasibility(q, ["symbol"], "stream", PAIRS, 3_600_000, 7_200_000, 86_400_000, 86_400_000, maker, 4.0, 1.5))


@CAT.add("A20_feasibility_taker", feasibility_sql("ask", "bid", 8.0))
def a20(spark, sf_dir):
    return _feasible(spark, sf_dir, False)


@CAT.add("A20_feasibility_maker", feasibility_sql("bid", "ask", 5.5))
def a20_maker(spark, sf_dir):
    return _feasible(spark, sf_dir, True)


@CAT.add("A21_friction_grid", f"""WITH {TICKS_SQL}, c AS (SELECT symbol, stream, avg(price) AS m FROM ticks GROUP BY 1, 2) SELECT k AS cost, round(avg((m > k)::INT), 6) AS survival_rate, round(avg(m - k), 6) AS avg_net FROM c, (SELECT unnest([5.0::DOUBLE, 10, 20, 40, 80]) AS k) GROUP BY 1""")
def a21(spark, sf_dir):
    cells = ticks(spark, sf_dir).groupBy("symbol", "stream").agg(F.avg("price").alias("m"))
    return rounded(h.friction_grid(cells, "m", [5, 10, 20, 40, 80]))


QUERIES, ORACLES = CAT.queries, CAT.oracles
