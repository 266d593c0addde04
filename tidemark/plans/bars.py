"""Queries over time buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
HOUR = 3_600_000


@CAT.add("A1_ohlcv_bars", f"""WITH {TICKS_SQL} SELECT stream, ts_event // 3600000 * 3600000 AS bucket, arg_min(price, (ts_event, seq)) AS open, max(price) AS high,
min(price) AS low, arg_max(price, (ts_event, seq)) AS close, sum(qty) AS volume, count(*) AS trade_count FROM ticks GROUP BY 1, 2""")
def a1(spark, sf_dir):
    return bars.ohlcv(ticks(spark, sf_dir), HOUR, volume=F.col("qty"), by=("stream",))


@CAT.add("A2_rebucket", f"""WITH {TICKS_SQL} SELECT stream, ts_event // 86400000 * 86400000 AS bucket, arg_min(price, (ts_event, seq)) AS open, max(price) AS high,
min(price) AS low, arg_max(price, (ts_event, seq)) AS close, sum(qty) AS volume, count(*) AS trade_count FROM ticks GROUP BY 1, 2""")
def a2(spark, sf_dir):
    """Days from hours are days from ticks."""
    hours = bars.ohlcv(ticks(spark, sf_dir), HOUR, volume=F.col("qty"), by=("stream",))
    return bars.rebucket(hours, HOUR, 24 * HOUR, by=("stream",))


@CAT.add("A3_tick_resample", f"""WITH {TICKS_SQL} SELECT stream, ts_event // 3600000 * 3600000 AS bucket, arg_max(price, (ts_event, seq)) AS last, round(avg(price), 6) AS mean,
round(stddev_samp(price), 6) AS deviation, count(*) AS n FROM ticks GROUP BY 1, 2""")
def a3(spark, sf_dir):
    return rounded(bars.resample(ticks(spark, sf_dir), HOUR, by=("stream",)))


@CAT.add("A4_spread_bars", f"""WITH {QUOTES_SQL} SELECT stream, ts_event // 3600000 * 3600000 AS bucket, round(avg(ask_price - bid_price), 6) AS avg_spread, round(min(ask_price - bid_price), 6) AS min_spread,
round(max(ask_price - bid_price), 6) AS max_spread, round(avg((ask_price - bid_price) / mid) * 100, 6) AS avg_spread_pct FROM quotes GROUP BY 1, 2""")
def a4(spark, sf_dir):
    return rounded(bars.spread_bars(quotes(spark, sf_dir), HOUR, by=("stream",)))


@CAT.add("A5_imbalance_bars", f"""WITH {QUOTES_SQL} SELECT stream, ts_event // 3600000 * 3600000 AS bucket, sum(bid_qty) AS bid_qty, sum(ask_qty) AS ask_qty,
sum(bid_qty) - sum(ask_qty) AS difference, count(*) AS n FROM quotes GROUP BY 1, 2""")
def a5(spark, sf_dir):
    return bars.imbalance_bars(quotes(spark, sf_dir), HOUR, by=("stream",))


@CAT.add("A6_centred_buckets", f"""WITH {TICKS_SQL} SELECT round_even(ts_event / 300000.0::DOUBLE, 0)::BIGINT * 300000 AS bucket, count(*) AS n FROM ticks GROUP BY 1""")
def a6(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy(bars.bucket(F.col("ts_event"), 300_000, "round").alias("bucket")).agg(F.count("*").alias("n"))


@CAT.add("A8_last_of_second", f"""WITH {TICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts_event // 60000 ORDER BY ts_event DESC, seq DESC) AS k FROM ticks)
SELECT ts_event // 60000 AS slot, symbol, ts_event, seq, price FROM r WHERE k = 1""")
def a8(spark, sf_dir):
    return bars.last_of_slot(ticks(spark, sf_dir), 60_000, ["price"])


@CAT.add("W32_bar_volatility", f"""WITH {TICKS_SQL}, b AS (SELECT stream, ts_event // 3600000 * 3600000 AS bucket, max(price) AS high, min(price) AS low, arg_max(price, (ts_event, seq)) AS close FROM ticks GROUP BY 1, 2),
t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr FROM b WINDOW o AS (PARTITION BY stream ORDER BY bucket))
SELECT stream, bucket, round(tr, 6) AS true_range, round(avg(tr) OVER w, 6) AS atr, round(avg(close) OVER w, 6) AS bb_mid, round(avg(close) OVER w + 2 * stddev_samp(close) OVER w, 6) AS bb_upper,
round(avg(close) OVER w - 2 * stddev_samp(close) OVER w, 6) AS bb_lower FROM t WINDOW w AS (PARTITION BY stream ORDER BY bucket ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def w32(spark, sf_dir):
    x = bars.bar_volatility(bars.ohlcv(ticks(spark, sf_dir), HOUR, by=("stream",)), 14, ["stream"])
    return rounded(x.select("stream", "bucket", "true_range", "atr", "bb_mid", "bb_upper", "bb_lower"))


@CAT.add("W33_bar_momentum", f"""WITH {TICKS_SQL}, b AS (SELECT stream, ts_event // 3600000 * 3600000 AS bucket, arg_max(price, (ts_event, seq)) AS close FROM ticks GROUP BY 1, 2),
c AS (SELECT *, close - lag(close) OVER o AS d, lag(close, 14) OVER o AS old FROM b WINDOW o AS (PARTITION BY stream ORDER BY bucket)),
g AS (SELECT *, avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS up, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS down,
avg(close) OVER (PARTITION BY stream ORDER BY bucket ROWS 11 PRECEDING) AS s12, avg(close) OVER (PARTITION BY stream ORDER BY bucket ROWS 25 PRECEDING) AS s26 FROM c WINDOW w AS (PARTITION BY stream ORDER BY bucket ROWS 13 PRECEDING))
SELECT stream, bucket, round(100 - 100 / (1 + up / nullif(down, 0)), 6) AS rsi, round(s12 - s26, 6) AS macd, round(close - old, 6) AS momentum, round((close - old) / nullif(old, 0) * 100, 6) AS roc FROM g""")
def w33(spark, sf_dir):
    x = bars.bar_momentum(bars.ohlcv(ticks(spark, sf_dir), HOUR, by=("stream",)), 14, ["stream"])
    return rounded(x.select("stream", "bucket", "rsi", "macd", "momentum", "roc"))


@CAT.add("W34_bar_volume", f"""WITH {TICKS_SQL}, b AS (SELECT stream, ts_event // 3600000 * 3600000 AS bucket, max(price) AS high, min(price) AS low, arg_max(price, (ts_event, seq)) AS close, sum(qty) AS volume FROM ticks GROUP BY 1, 2)
SELECT stream, bucket, round(high - low, 6) AS hl_spread, round(sum(close * volume) OVER c / nullif(sum(volume) OVER c, 0), 6) AS vwap, round(sum(close * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS rolling_vwap,
round(close * volume, 6) AS dollar_volume, volume - lag(volume) OVER (PARTITION BY stream ORDER BY bucket) AS volume_delta FROM b
WINDOW c AS (PARTITION BY stream ORDER BY bucket), w AS (PARTITION BY stream ORDER BY bucket ROWS 13 PRECEDING)""")
def w34(spark, sf_dir):
    x = bars.bar_volume(bars.ohlcv(ticks(spark, sf_dir), HOUR, volume=F.col("qty"), by=("stream",)), 14, ["stream"])
    return rounded(x.select("stream", "bucket", "hl_spread", "vwap", "rolling_vwap", "dollar_volume", "volume_delta"))


QUERIES, ORACLES = CAT.queries, CAT.oracles
