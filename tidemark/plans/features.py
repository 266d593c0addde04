"""Queries over rolling features. Groups are a stream's weeks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import features as f
from ..operators import registry, temporal
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
BY = ["stream", "week"]
R_SQL = f"""{QUOTES_SQL}, r AS (SELECT *, CASE WHEN lag(mid) OVER o > 0 THEN (mid - lag(mid) OVER o) / lag(mid) OVER o END AS return_1
FROM quotes WINDOW o AS (PARTITION BY stream, week ORDER BY ts_event, seq))"""


def frame(n: int) -> str:
    return f"(PARTITION BY stream, week ORDER BY ts_event, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def out(df, *names):
    return rounded(df.select("seq", *names))


def base(spark, sf_dir):
    return f.with_returns(f.stateless(quotes(spark, sf_dir)), BY)


@CAT.add("W01_W02_W15_book", f"""WITH {QUOTES_SQL} SELECT seq, mid AS mid_price, ask_price - bid_price AS spread,
(bid_price * ask_qty + ask_price * bid_qty) / (bid_qty + ask_qty) AS microprice FROM quotes""")
def w_book(spark, sf_dir):
    return f.stateless(quotes(spark, sf_dir)).select("seq", "mid_price", "spread", "microprice")


@CAT.add("W03_return_1", f"WITH {R_SQL} SELECT seq, round(return_1, 6) AS return_1 FROM r")
def w3(spark, sf_dir):
    return out(base(spark, sf_dir), "return_1")


@CAT.add("W04_volatility", f"""WITH {R_SQL}, v AS (SELECT seq, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(return_1) OVER w END AS v FROM r WHERE return_1 IS NOT NULL WINDOW w AS {frame(20)})
SELECT r.seq, round(v, 6) AS volatility FROM r LEFT JOIN v ON r.seq = v.seq""")
def w4(spark, sf_dir):
    return out(f.volatility(base(spark, sf_dir), BY), "volatility")


EMA_SQL = "CASE WHEN row_number() OVER o >= {n} THEN list_reduce(list({x}) OVER o, lambda a, b: a + {alpha} * (b - a)) END"
O = "WINDOW o AS (PARTITION BY stream, week ORDER BY ts_event, seq)"  # noqa: E741


def ema_sql(x: str, span: int, n: int) -> str:
    return EMA_SQL.format(x=x, alpha=f"(2.0::DOUBLE / {span + 1})", n=n)


@CAT.add("W05_W17_ema", f"""WITH {QUOTES_SQL}, e AS (SELECT seq, stream, week, ts_event, row_number() OVER o AS rn, {ema_sql('mid', 14, 1)} AS e FROM quotes {O})
SELECT seq, round(CASE WHEN rn >= 14 THEN e END, 6) AS ema, round(CASE WHEN rn >= 19 THEN (e - lag(e, 5) OVER o) / 5 END, 6) AS ema_slope FROM e {O}""")
def w5(spark, sf_dir):
    return out(registry.feature_table(quotes(spark, sf_dir), BY, ["ema", "ema_slope"], warm=False), "ema", "ema_slope")


@CAT.add("W06_rsi", f"""WITH {QUOTES_SQL}, c AS (SELECT *, mid - lag(mid) OVER o AS d FROM quotes {O}),
g AS (SELECT seq, count(d) OVER w AS n, avg(CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END) OVER w AS up, avg(CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END) OVER w AS down FROM c WINDOW w AS {frame(14)})
SELECT seq, round(CASE WHEN n < 14 THEN NULL WHEN down = 0 THEN 100 WHEN up = 0 THEN 0 ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi FROM g""")
def w6(spark, sf_dir):
    return out(f.rsi(quotes(spark, sf_dir), BY), "rsi")


@CAT.add("W07_atr", f"""WITH {QUOTES_SQL}, c AS (SELECT *, CASE WHEN lag(mid) OVER o IS NOT NULL THEN greatest(ask_price - bid_price, abs(mid - lag(mid) OVER o)) END AS tr FROM quotes {O})
SELECT seq, round(CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END, 6) AS atr FROM c WINDOW w AS {frame(14)}""")
def w7(spark, sf_dir):
    return out(f.atr(quotes(spark, sf_dir), BY), "atr")


@CAT.add("W08_roc", f"WITH {QUOTES_SQL} SELECT seq, round((mid - lag(mid, 10) OVER o) / lag(mid, 10) OVER o * 100, 6) AS roc FROM quotes {O}")
def w8(spark, sf_dir):
    return out(f.roc(quotes(spark, sf_dir), BY), "roc")


@CAT.add("W09_W12_volatility_regime", f"""WITH {R_SQL}, v AS (SELECT seq, CASE WHEN count(*) OVER a = 20 THEN stddev_pop(return_1) OVER a END AS s, CASE WHEN count(*) OVER b = 100 THEN stddev_pop(return_1) OVER b END AS l
FROM r WHERE return_1 IS NOT NULL WINDOW a AS {frame(20)}, b AS {frame(100)}), x AS (SELECT r.seq, CASE WHEN l = 0 THEN 1 ELSE s / l END AS q FROM r LEFT JOIN v ON r.seq = v.seq)
SELECT seq, round(CASE WHEN q IS NOT NULL THEN least(greatest(q, 0), 5) END, 6) AS volatility_ratio, CASE WHEN q < 0.5 THEN 0 WHEN q > 2 THEN 2 WHEN q IS NOT NULL THEN 1 END AS regime_volatility FROM x""")
def w9(spark, sf_dir):
    return out(f.volatility_regime(base(spark, sf_dir), BY), "volatility_ratio", "regime_volatility")


@CAT.add("W10_W13_trend", f"""WITH {QUOTES_SQL}, e AS (SELECT *, row_number() OVER o AS rn, {ema_sql('mid', 10, 1)} AS f, {ema_sql('mid', 30, 1)} AS s FROM quotes {O}),
x AS (SELECT seq, rn, f, s, (f - s) / s AS sep, (f - lag(f, 4) OVER o) / lag(f, 4) OVER o AS rise, f - lag(f) OVER o AS mv FROM e {O})
SELECT seq, round(CASE WHEN rn >= 35 THEN tanh(100 * (0.7 * sep + 0.3 * rise)) END, 6) AS trend_strength,
CASE WHEN rn >= 30 THEN (CASE WHEN f > s AND mv > 1e-4 THEN 1 WHEN f < s AND mv < -1e-4 THEN -1 ELSE 0 END)::DOUBLE END AS regime_trend FROM x""")
def w10(spark, sf_dir):
    return out(registry.feature_table(quotes(spark, sf_dir), BY, ["trend_strength", "regime_trend"], warm=False), "trend_strength", "regime_trend")


@CAT.add("W11_W14_spread_ratio", f"""WITH {QUOTES_SQL}, s AS (SELECT *, ask_price - bid_price AS s FROM quotes WHERE ask_price > bid_price),
x AS (SELECT seq, CASE WHEN count(*) OVER w = 100 THEN s / avg(s) OVER w END AS q FROM s WINDOW w AS {frame(100)})
SELECT quotes.seq, round(CASE WHEN q IS NOT NULL THEN least(greatest(q, 0), 5) END, 6) AS spread_ratio, CASE WHEN q < 0.5 THEN 0 WHEN q > 2 THEN 2 WHEN q IS NOT NULL THEN 1 END AS regime_spread FROM quotes LEFT JOIN x ON quotes.seq = x.seq""")
def w11(spark, sf_dir):
    return out(f.spread_ratio(quotes(spark, sf_dir), BY), "spread_ratio", "regime_spread")


I_SQL = f"{QUOTES_SQL}, i AS (SELECT *, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS imbalance, ask_price - bid_price AS spread FROM quotes)"


@CAT.add("W16_W19_W22_W23_imbalance", f"""WITH {I_SQL}, e AS (SELECT *, row_number() OVER o AS rn, {ema_sql('imbalance', 20, 20)} AS e20, {ema_sql('imbalance', 10, 1)} AS e10, {ema_sql('spread', 10, 10)} AS s10, {ema_sql('spread', 50, 50)} AS s50 FROM i {O}),
d AS (SELECT *, e10 - lag(e10) OVER o AS d FROM e {O}), a AS (SELECT *, list_reduce(list(d) FILTER (WHERE d IS NOT NULL) OVER o, lambda p, q: p + (2.0::DOUBLE / 6) * (q - p)) AS acc FROM d {O})
SELECT seq, round(e20, 6) AS imbalance_ema, round(CASE WHEN rn >= 10 THEN e10 END, 6) AS liquidity_pressure, round(CASE WHEN s50 IS NOT NULL THEN least(greatest(1 - s10 / s50, -1), 1) END, 6) AS spread_compression,
round(CASE WHEN rn >= 15 THEN tanh(100 * acc) END, 6) AS imbalance_acceleration FROM a""")
def w16(spark, sf_dir):
    names = ["imbalance_ema", "liquidity_pressure", "spread_compression", "imbalance_acceleration"]
    x = registry.feature_table(quotes(spark, sf_dir), BY, names, warm=False)
    return out(x, *names)


@CAT.add("W18_bollinger", f"""WITH {QUOTES_SQL}, x AS (SELECT seq, mid, count(*) OVER w AS n, avg(mid) OVER w AS m, stddev_pop(mid) OVER w AS d FROM quotes WINDOW w AS {frame(20)})
SELECT seq, round(CASE WHEN n < 20 THEN NULL WHEN d = 0 THEN 0.5 ELSE least(greatest((mid - m + 2 * d) / (4 * d), 0), 1) END, 6) AS bollinger_pos FROM x""")
def w18(spark, sf_dir):
    return out(f.bollinger_position(quotes(spark, sf_dir), BY), "bollinger_pos")


@CAT.add("W20_momentum_counts", f"""WITH {R_SQL}, x AS (SELECT seq, CASE WHEN count(*) OVER w = 20 THEN coalesce(sum(sign(return_1)) OVER w / nullif(sum(abs(sign(return_1))) OVER w, 0), 0) END AS m FROM r WHERE return_1 IS NOT NULL WINDOW w AS {frame(20)})
SELECT r.seq, round(m, 6) AS return_momentum FROM r LEFT JOIN x ON r.seq = x.seq""")
def w20_counts(spark, sf_dir):
    return out(f.return_momentum(base(spark, sf_dir), BY, weighted=False), "return_momentum")


@CAT.add("W20_momentum", f"""WITH {R_SQL}, x AS (SELECT seq, CASE WHEN count(*) OVER w = 20 THEN coalesce(sum(return_1) OVER w / nullif(sum(abs(return_1)) OVER w, 0), 0) END AS m FROM r WHERE return_1 IS NOT NULL WINDOW w AS {frame(20)})
SELECT r.seq, round(m, 6) AS return_momentum FROM r LEFT JOIN x ON r.seq = x.seq""")
def w20(spark, sf_dir):
    return out(f.return_momentum(base(spark, sf_dir), BY), "return_momentum")


@CAT.add("W24_micro_reversion", f"""WITH {R_SQL}, s AS (SELECT *, sign(return_1) * sign(lag(return_1) OVER o) AS p FROM r WHERE return_1 IS NOT NULL {O}),
m AS (SELECT *, CASE WHEN p < 0 THEN 1.0 WHEN p > 0 THEN 0.0 WHEN p = 0 THEN 0.5 END::DOUBLE AS f FROM s), x AS (SELECT seq, CASE WHEN count(f) OVER w = 50 THEN avg(f) OVER w END AS v FROM m WINDOW w AS {frame(50)})
SELECT r.seq, round(v, 6) AS micro_reversion FROM r LEFT JOIN x ON r.seq = x.seq""")
def w24(spark, sf_dir):
    return out(f.micro_reversion(base(spark, sf_dir), BY), "micro_reversion")


@CAT.add("W25_quote_intensity", f"""WITH {QUOTES_SQL}, s AS (SELECT *, ts_event - lag(ts_event, 19) OVER o AS sp FROM quotes {O}), r AS (SELECT *, 20 / (sp / 1000.0::DOUBLE) AS rate FROM s WHERE sp > 0),
l AS (SELECT seq, rate, list(rate) OVER w AS v FROM r WINDOW w AS {frame(50)})
SELECT q.seq, round(CASE WHEN len(v) = 50 THEN len(list_filter(v, lambda x: x <= rate)) / 50.0::DOUBLE END, 6) AS quote_intensity FROM quotes q LEFT JOIN l ON q.seq = l.seq""")
def w25(spark, sf_dir):
    return out(f.quote_intensity(quotes(spark, sf_dir), BY, 20, 50), "quote_intensity")


def whole_stream(name: str) -> str:
    """A feature's SQL over whole streams, with all digits."""
    return CAT.oracles[name].replace("PARTITION BY stream, week", "PARTITION BY stream").replace(", 6) AS", ", 15) AS")


SINGLE = ("W03_return_1", "W04_volatility", "W05_W17_ema", "W06_rsi", "W07_atr", "W08_roc", "W09_W12_volatility_regime", "W10_W13_trend", "W11_W14_spread_ratio", "W16_W19_W22_W23_imbalance", "W18_bollinger", "W20_momentum", "W24_micro_reversion")
INTENSITY_SQL = whole_stream("W25_quote_intensity").replace("49 PRECEDING", "199 PRECEDING").replace("len(v) = 50", "len(v) = 200").replace("/ 50.0", "/ 200.0")
TABLE_SQL = f"""WITH q AS (WITH {QUOTES_SQL} SELECT seq, stream, ts_event FROM quotes),
v AS (SELECT * FROM q JOIN ({whole_stream("W01_W02_W15_book")}) USING (seq) {" ".join(f"JOIN ({whole_stream(n)}) USING (seq)" for n in SINGLE)} JOIN ({INTENSITY_SQL}) USING (seq)),
s AS (SELECT seq, CASE WHEN count(*) OVER w = 100 THEN 0.4 * (1 - least(var_pop(volatility_ratio) OVER w / 0.67, 1)) + 0.4 * (1 - least(var_pop(trend_strength) OVER w / 0.67, 1)) + 0.2 * (1 - least(var_pop(spread_ratio) OVER w / 0.67, 1)) END AS regime_stability
FROM v WHERE volatility_ratio IS NOT NULL AND trend_strength IS NOT NULL AND spread_ratio IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY ts_event, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, list(volatility) OVER (PARTITION BY stream ORDER BY ts_event, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM v WHERE volatility_ratio IS NOT NULL AND spread_compression IS NOT NULL AND volatility IS NOT NULL),
c AS (SELECT seq, 0.4 * least(greatest(2 - volatility_ratio, 0), 1) + 0.3 * (spread_compression + 1) / 2 + 0.3 * (1 - len(list_filter(l, lambda x: x <= volatility)) / 50.0::DOUBLE) AS volatility_compression_score FROM l WHERE len(l) = 50),
t AS (SELECT *, (return_momentum - liquidity_pressure) / 2 AS behavior_divergence FROM v LEFT JOIN s USING (seq) LEFT JOIN c USING (seq))"""


def known_sql(names) -> str:
    whole = ("regime_volatility", "regime_trend", "regime_spread", "microprice")  # classes, and a value whose sixth place has ties
    shown = ", ".join(n if n in whole else f"round({n}, 6) AS {n}" for n in names)
    return f"{TABLE_SQL} SELECT seq, {shown} FROM t WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}"


DERIVED = ("regime_stability", "behavior_divergence", "volatility_compression_score")


@CAT.add("W21_W26_W27_derived", known_sql(DERIVED))
def w21(spark, sf_dir):
    return out(registry.feature_table(quotes(spark, sf_dir), ["stream"], DERIVED), *DERIVED)


@CAT.add("W_feature_table", known_sql(registry.FEATURES))
def feature_table(spark, sf_dir):
    """All features by name over whole streams, where all are known."""
    x = registry.feature_table(quotes(spark, sf_dir), ["stream"])
    return rounded(x.select("seq", *registry.FEATURES), but=["microprice"])


UNIT = 600_000


def past_sql(*horizons: int) -> str:
    return ", ".join(f"(SELECT mid FROM s WHERE s.stream = a.stream AND s.week = a.week AND s.ts_event <= a.ts_event - {h * UNIT} ORDER BY s.ts_event DESC, s.seq DESC LIMIT 1) AS p{h}" for h in horizons)


@CAT.add("W30_model_features", f"""WITH {QUOTES_SQL}, s AS (SELECT stream, week, ts_event, seq, mid FROM quotes),
b AS (SELECT a.*, {past_sql(1, 5, 10, 30)}, (SELECT mid FROM s WHERE s.stream = a.stream AND s.week = a.week AND s.ts_event >= a.ts_event + {10 * UNIT} ORDER BY s.ts_event, s.seq LIMIT 1) AS future, min(ts_event) OVER (PARTITION BY stream, week) AS first FROM quotes a),
v AS (SELECT x.seq, stddev_pop(ln(y.mid / y.p1)) AS v, count(ln(y.mid / y.p1)) AS n FROM b x JOIN b y ON x.stream = y.stream AND x.week = y.week AND y.ts_event >= x.ts_event - {10 * UNIT} AND (y.ts_event < x.ts_event OR (y.ts_event = x.ts_event AND y.seq <= x.seq)) GROUP BY 1)
SELECT b.seq, round(ln(mid / p1), 6) AS log_return_1, round(ln(mid / p5), 6) AS log_return_5, round(ln(mid / p10), 6) AS log_return_10, round(ln(mid / p30), 6) AS log_return_30, round(v, 6) AS volatility, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 6) AS imbalance,
round((bid_price * ask_qty + ask_price * bid_qty) / (bid_qty + ask_qty), 6) AS microprice, CASE WHEN future > mid THEN 1 ELSE 0 END AS label
FROM b JOIN v ON b.seq = v.seq WHERE ts_event >= first + {30 * UNIT} AND n >= 2 AND p1 IS NOT NULL AND p5 IS NOT NULL AND p10 IS NOT NULL AND p30 IS NOT NULL AND future IS NOT NULL""")  # fmt: skip
def w30(spark, sf_dir):
    x = f.model_features(quotes(spark, sf_dir), BY, UNIT)
    return out(x, *[f"log_return_{h}" for h in (1, 5, 10, 30)], "volatility", "imbalance", "microprice", "label")


@CAT.add("W31_live_features", f"""WITH {QUOTES_SQL}, s AS (SELECT stream, week, ts_event, seq, mid FROM quotes), b AS (SELECT a.*, {past_sql(1, 5)},
(SELECT count(*) FROM s WHERE s.stream = a.stream AND s.week = a.week AND s.ts_event >= a.ts_event - {UNIT} AND (s.ts_event < a.ts_event OR (s.ts_event = a.ts_event AND s.seq < a.seq))) AS f_intensity FROM quotes a)
SELECT seq, round(coalesce(ln(mid / p1), 0), 8) AS f_log_return_1, round(coalesce(ln(mid / p5), 0), 8) AS f_log_return_5, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 8) AS f_imbalance, f_intensity FROM b""")
def w31(spark, sf_dir):
    return f.live_features(quotes(spark, sf_dir), BY, UNIT).drop(*BY, "ts_event")


@CAT.add("W35_W36_event_labels", f"""WITH {QUOTES_SQL}, x AS (SELECT seq, mid, lead(mid, 10) OVER o AS m10, lead(mid, 50) OVER o AS m50, lead(mid) OVER o AS m1 FROM quotes {O})
SELECT seq, round(m10 / mid - 1, 6) AS h10, round(m50 / mid - 1, 6) AS h50, sign(m1 - mid)::INT AS next_sign FROM x WHERE m1 IS NOT NULL""")
def w35(spark, sf_dir):
    o = f.ordered(BY)
    x = quotes(spark, sf_dir).withColumns({f"h{h}": F.lead("mid", h).over(o) / F.col("mid") - 1 for h in (10, 50)})
    x = x.withColumn("next_sign", F.signum(F.lead("mid").over(o) - F.col("mid")).cast("int"))
    return out(x.filter(F.col("next_sign").isNotNull()), "h10", "h50", "next_sign")


@CAT.add("W37_horizon_label", f"""WITH {QUOTES_SQL}, s AS (SELECT stream, week, ts_event, seq, mid FROM quotes), b AS (SELECT a.seq, a.mid, (SELECT mid FROM s WHERE s.stream = a.stream AND s.week = a.week AND s.ts_event >= a.ts_event + 3600000 ORDER BY s.ts_event, s.seq LIMIT 1) AS m FROM s a)
SELECT seq, floor((m / mid - 1) * 1e8 + 0.5) / 1e8 AS label_future_return, sign(m - mid)::INT AS label_direction FROM b WHERE m IS NOT NULL""")
def w37(spark, sf_dir):
    q = quotes(spark, sf_dir).select("stream", "week", "ts_event", "seq", "mid")
    x = temporal.asof_forward(q, q, BY, ["mid"], 3_600_000, prefix="next_").filter("next_mid is not null")
    return x.select("seq", (F.floor((F.col("next_mid") / F.col("mid") - 1) * 1e8 + 0.5) / 1e8).alias("label_future_return"), F.signum(F.col("next_mid") - F.col("mid")).cast("int").alias("label_direction"))


@CAT.add("W38_baseline", f"""WITH {R_SQL}, x AS (SELECT seq, return_1, (ask_price - bid_price) / mid * 10000 AS bps FROM r)
SELECT seq, round(bps, 6) AS spread_bps, CASE WHEN return_1 > 0.5 AND bps < 25 THEN 'LONG' WHEN return_1 < -0.5 AND bps < 25 THEN 'SHORT' ELSE 'FLAT' END AS decision FROM x""")
def w38(spark, sf_dir):
    x = base(spark, sf_dir).withColumn("spread_bps", F.col("spread") / F.col("mid") * 10000)
    narrow = F.col("spread_bps") < 25
    d = F.when((F.col("return_1") > 0.5) & narrow, "LONG").when((F.col("return_1") < -0.5) & narrow, "SHORT").otherwise("FLAT")
    return out(x.withColumn("decision", d), "spread_bps", "decision")


@CAT.add("W38_positions", f"""WITH RECURSIVE {R_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY stream, week ORDER BY ts_event, seq) AS i, (ask_price - bid_price) / mid * 10000 > 25 AS wide FROM r),
x AS (SELECT stream, week, i, seq, wide, return_1 AS r, CASE WHEN NOT wide AND return_1 > 0.5::DOUBLE THEN 1 WHEN NOT wide AND return_1 < -0.5::DOUBLE THEN -1 ELSE 0 END AS s FROM n),
p AS (SELECT stream, week, 0::BIGINT AS i, 0 AS p FROM x GROUP BY 1, 2 UNION ALL SELECT x.stream, x.week, x.i, least(1, greatest(-1, p + s)) FROM p JOIN x ON x.stream = p.stream AND x.week = p.week AND x.i = p.i + 1)
SELECT seq, p AS position, CASE WHEN p = 1 AND s = -1 THEN 'EXIT_LONG' WHEN p = -1 AND s = 1 THEN 'EXIT_SHORT' WHEN p = 0 AND s = 1 THEN 'LONG' WHEN p = 0 AND s = -1 THEN 'SHORT' ELSE 'FLAT' END AS action,
CASE WHEN wide THEN 'spread_too_wide' WHEN p * s < 0 THEN 'momentum_reversal' WHEN p = 1 THEN 'holding_long' WHEN p = -1 THEN 'holding_short' WHEN s = 1 THEN 'positive_momentum' WHEN s = -1 THEN 'negative_momentum' ELSE 'no_signal' END AS reason,
round(CASE WHEN s <> 0 AND s <> p THEN least(1, abs(r) / 0.5::DOUBLE) END, 6) AS confidence FROM x JOIN (SELECT stream, week, i + 1 AS i, p FROM p) USING (stream, week, i)""")
def w38_positions(spark, sf_dir):
    """The baseline with the position that its earlier actions left."""
    return out(f.baseline_actions(base(spark, sf_dir), BY, 0.5, 25.0), "position", "action", "reason", "confidence")


@CAT.add("W39_drawdown", f"""WITH {TICKS_SQL}, p AS (SELECT *, max(price) OVER (PARTITION BY symbol ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING) AS peak FROM ticks)
SELECT seq, peak, round(CASE WHEN peak > 0 THEN (peak - price) / peak ELSE 0 END, 6) AS drawdown FROM p""")
def w39(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts_event", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = ticks(spark, sf_dir).withColumn("peak", F.max("price").over(w))
    return out(x.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("price")) / F.col("peak")).otherwise(0.0)), "peak", "drawdown")


@CAT.add("W40_silence", f"""WITH {TICKS_SQL}, g AS (SELECT *, ts_event - lag(ts_event) OVER (PARTITION BY symbol, stream ORDER BY ts_event, seq) AS gap FROM ticks)
SELECT seq, gap, sum(CASE WHEN gap > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, stream ORDER BY ts_event RANGE BETWEEN 259200000 PRECEDING AND CURRENT ROW)::BIGINT AS silences FROM g""")
def w40(spark, sf_dir):
    by = Window.partitionBy("symbol", "stream")
    x = ticks(spark, sf_dir).withColumn("gap", F.col("ts_event") - F.lag("ts_event").over(by.orderBy("ts_event", "seq")))
    recent = F.sum(F.when(F.col("gap") > 86_400_000, 1).otherwise(0)).over(by.orderBy("ts_event").rangeBetween(-259_200_000, 0))
    return x.select("seq", "gap", recent.alias("silences"))


@CAT.add("W41_run_numbering", f"""WITH {TICKS_SQL} SELECT seq, row_number() OVER (PARTITION BY symbol ORDER BY ts_event, seq)::INT AS event_seq,
first_value(stream) OVER w AS first_stream, last_value(stream) OVER w AS last_stream FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_event, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def w41(spark, sf_dir):
    o = Window.partitionBy("symbol").orderBy("ts_event", "seq")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ticks(spark, sf_dir).select("seq", F.row_number().over(o).alias("event_seq"), F.first("stream").over(whole).alias("first_stream"), F.last("stream").over(whole).alias("last_stream"))


QUERIES, ORACLES = CAT.queries, CAT.oracles
