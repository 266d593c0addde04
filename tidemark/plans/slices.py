"""Queries over scans, slices, sorts and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slices as s
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, table, ticks, trade_to_quote, trades_of
from .registry import Catalogue, rounded

CAT = Catalogue()
T0, T1 = 1_704_500_000_000, 1_705_500_000_000
COLS = "ts_event, seq, symbol, stream, price"
NAMES = COLS.split(", ")


@CAT.add("S1_S5_clean_scan", f"WITH {TICKS_SQL} SELECT {COLS} FROM ticks WHERE ts_event IS NOT NULL AND seq IS NOT NULL AND price > 0")
def s1(spark, sf_dir):
    return ticks(spark, sf_dir).select(*NAMES).filter("ts_event is not null and seq is not null and price > 0")


@CAT.add("S3_F1_range_count", f"WITH {TICKS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE ts_event BETWEEN {T0} AND {T1}) AS inside FROM ticks")
def s3(spark, sf_dir):
    return ticks(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("ts_event").between(T0, T1)).alias("inside"))


@CAT.add("S6_S7_stream_values", f"""WITH {QUOTES_SQL} SELECT seq, stream, mid AS value FROM quotes WHERE stream = 'click' AND bid_price > 0 AND ask_price > 0
UNION ALL SELECT seq, stream, price FROM ticks WHERE stream <> 'click'""")
def s6(spark, sf_dir):
    q = quotes(spark, sf_dir).filter("stream = 'click' and bid_price > 0 and ask_price > 0").select("seq", "stream", F.col("mid").alias("value"))
    return q.unionByName(ticks(spark, sf_dir).filter("stream <> 'click'").select("seq", "stream", F.col("price").alias("value")))


@CAT.add("S12_partitions", f"WITH {TICKS_SQL} SELECT stream, strftime(make_timestamp(ts_event * 1000), '%Y%m%d') AS date, count(*) AS n FROM ticks GROUP BY 1, 2")
def s12(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("stream", F.date_format(F.timestamp_millis("ts_event"), "yyyyMMdd").alias("date")).agg(F.count("*").alias("n"))


@CAT.add("S14_normalised", f"""WITH {TICKS_SQL} SELECT seq, upper(stream) || 'USDT' AS pair, price, qty, CASE WHEN qty > 50 THEN 1 ELSE -1 END::INT AS side, CASE WHEN stream = 'click' AND qty > 90 THEN ts_event + 7 ELSE ts_event END AS ts_event FROM ticks""")
def s14(spark, sf_dir):
    """Ticks as the messages of three venues (some of the first without a time), and read from them."""
    buy, c = F.col("qty") > 50, F.col
    pair = F.concat("stream", F.lit("-"), F.lit("usdt"))
    sent = F.when(~((c("stream") == "click") & (c("qty") > 90)), c("ts_event"))
    text = lambda name: c(name).cast("string")
    first = F.to_json(F.struct(pair.alias("s"), text("price").alias("p"), text("qty").alias("q"), sent.alias("T"), (~buy).alias("m")))
    second = F.to_json(F.struct(F.upper(pair).alias("s"), text("price").alias("p"), text("qty").alias("v"), c("ts_event").alias("T"), F.when(buy, "Buy").otherwise("Sell").alias("S")))
    third = F.to_json(F.struct(F.concat("stream", F.lit("_USDT")).alias("instId"), text("price").alias("px"), text("qty").alias("sz"), text("ts_event").alias("ts"), F.when(buy, "buy").otherwise("sell").alias("side")))
    venue = F.when(c("stream") == "click", "binance").when(c("stream") == "view", "bybit").otherwise("okx")
    payload = F.when(c("stream") == "click", first).when(c("stream") == "view", second).otherwise(third)
    m = ticks(spark, sf_dir).select("seq", venue.alias("venue"), payload.alias("payload"), (c("ts_event") + 7).alias("ts_recv"))
    return trades_of(m).select("seq", "pair", "price", "qty", "side", "ts_event")


@CAT.add("S16_S17_meta", f"""WITH {TICKS_SQL} SELECT stream, count(*) AS rows, min(ts_event) AS ts_event_min, max(ts_event) AS ts_event_max, substr(md5(stream || ':' || count(*)), 1, 12) AS manifest FROM ticks GROUP BY 1""")
def s16(spark, sf_dir):
    x = ticks(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("rows"), F.min("ts_event").alias("ts_event_min"), F.max("ts_event").alias("ts_event_max"))
    return x.withColumn("manifest", F.substring(F.md5(F.concat_ws(":", "stream", F.col("rows").cast("string"))), 1, 12))


@CAT.add("F2_page", f"WITH {TICKS_SQL} SELECT {COLS} FROM ticks WHERE (ts_event, seq) > ({T0}, 10) ORDER BY ts_event, seq LIMIT 100")
def f2(spark, sf_dir):
    return s.page(ticks(spark, sf_dir).select(*NAMES), (T0, 10), 100)


@CAT.add("F3_head", f"WITH {TICKS_SQL} SELECT {COLS} FROM ticks ORDER BY ts_event, seq LIMIT 37")
def f3(spark, sf_dir):
    return s.head(ticks(spark, sf_dir).select(*NAMES), 37)


@CAT.add("F4_tail", f"WITH {TICKS_SQL} SELECT {COLS} FROM ticks ORDER BY ts_event DESC, seq DESC LIMIT 37")
def f4(spark, sf_dir):
    return s.tail(ticks(spark, sf_dir).select(*NAMES), 37)


@CAT.add("F5_head_tail", f"WITH {TICKS_SQL} (SELECT {COLS} FROM ticks ORDER BY ts_event, seq LIMIT 25) UNION (SELECT {COLS} FROM ticks ORDER BY ts_event DESC, seq DESC LIMIT 26)")
def f5(spark, sf_dir):
    return s.head_tail(ticks(spark, sf_dir).select(*NAMES), 51)


@CAT.add("F6_cursors", f"""WITH {TICKS_SQL} SELECT seq, replace(base64(encode('{{"v":1,"ts_event":"' || ts_event || '","seq":"' || seq || '"}}')), chr(10), '') AS cursor, ts_event FROM ticks""")
def f6(spark, sf_dir):
    x = ticks(spark, sf_dir).select("seq", s.encode_cursor(F.col("ts_event"), F.col("seq")).alias("cursor"))
    return x.withColumn("ts_event", s.decode_cursor(F.col("cursor"))["ts_event"])


@CAT.add("F7_every_nth", f"WITH {TICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts_event, seq) AS i FROM ticks) SELECT {COLS} FROM r WHERE i % 7 = 0")
def f7(spark, sf_dir):
    return s.every_nth(ticks(spark, sf_dir).select(*NAMES), 7, ["stream"])


@CAT.add("F8_min_interval", f"""WITH RECURSIVE {TICKS_SQL}, k AS (
SELECT symbol, min(ts_event) AS ts_event FROM ticks GROUP BY symbol
UNION ALL SELECT k.symbol, (SELECT min(t.ts_event) FROM ticks t WHERE t.symbol = k.symbol AND t.ts_event >= k.ts_event + 86400000) FROM k WHERE k.ts_event IS NOT NULL),
r AS (SELECT t.*, row_number() OVER (PARTITION BY t.symbol, t.ts_event ORDER BY seq) AS i FROM ticks t JOIN k ON t.symbol = k.symbol AND t.ts_event = k.ts_event) SELECT {COLS} FROM r WHERE i = 1""")
def f8(spark, sf_dir):
    return s.min_interval(ticks(spark, sf_dir).select(*NAMES), 86_400_000, ["symbol"])


@CAT.add("F9_first_of_group", f"WITH {TICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stream, week ORDER BY ts_event, seq) AS i FROM ticks) SELECT {COLS} FROM r WHERE i <= 20")
def f9(spark, sf_dir):
    return s.cap_per_group(ticks(spark, sf_dir), 20, ["stream", "week"]).select(*NAMES)


@CAT.add("F10_F11_trade_to_quote", f"""WITH {TICKS_SQL}, s AS (SELECT *, greatest(abs(price) * 1e-6, 1e-8) AS sp FROM ticks WHERE price IS NOT NULL AND qty IS NOT NULL)
SELECT seq, price - sp / 2 AS bid_price, price + sp / 2 AS ask_price, CASE WHEN qty > 0 THEN qty ELSE 1e-9 END AS bid_qty FROM s""")
def f10(spark, sf_dir):
    t = ticks(spark, sf_dir).dropna(subset=["price", "qty"])
    return trade_to_quote(t).select("seq", "bid_price", "ask_price", "bid_qty")


@CAT.add("F12_F13_conditions", f"""WITH {TICKS_SQL} SELECT seq, coalesce(price > 20, false) AND coalesce(qty <= 50, false) AND symbol IN (1, 2, 3, 5, 8) AS entered,
CASE WHEN price IS NULL THEN 'missing_price' WHEN NOT price > 20 THEN 'price_condition' WHEN qty IS NULL THEN 'missing_qty' WHEN NOT qty <= 50 THEN 'qty_condition' END AS exit_reason FROM ticks""")
def f12(spark, sf_dir):
    c = [("price", ">", 20.0), ("qty", "<=", 50.0)]
    return ticks(spark, sf_dir).select("seq", s.matches(c, [1, 2, 3, 5, 8], "symbol").alias("entered"), s.exit_reason(c).alias("exit_reason"))


@CAT.add("F15_threshold_signals", f"""WITH {TICKS_SQL}, p AS (SELECT stream, least(price / 100, 1) AS p FROM ticks) SELECT stream, count(*) AS n, count(*) FILTER (WHERE p >= 0.55) AS signals,
round(avg((p >= 0.55)::INT), 6) AS pos_rate, min(p) AS min_p, round(avg(p), 6) AS mean_p, max(p) AS max_p FROM p GROUP BY 1""")
def f15(spark, sf_dir):
    p = ticks(spark, sf_dir).withColumn("p", F.least(F.col("price") / 100, F.lit(1.0)))
    hit = (F.col("p") >= 0.55).cast("int")
    return rounded(p.groupBy("stream").agg(F.count("*").alias("n"), F.sum(hit).alias("signals"), F.avg(hit).alias("pos_rate"), F.min("p").alias("min_p"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p")))


@CAT.add("F16_inventory", """SELECT o_orderkey, o_orderpriority, split_part(o_orderpriority, '-', 2) AS name FROM orders WHERE o_orderstatus = 'F' AND split_part(o_orderpriority, '-', 1) = '1'""")
def f16(spark, sf_dir):
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (part(1) == "1")).select("o_orderkey", "o_orderpriority", part(2).alias("name"))


@CAT.add("O2_merge_seq", f"""WITH {TICKS_SQL} SELECT stream, week, ts_event, symbol % 4 AS file, seq AS row, row_number() OVER (PARTITION BY stream, week ORDER BY ts_event, symbol % 4, seq) - 1 AS merged_seq FROM ticks""")
def o2(spark, sf_dir):
    t = ticks(spark, sf_dir).select("stream", "week", "ts_event", (F.col("symbol") % 4).alias("file"), F.col("seq").alias("row"))
    return s.merged(t, ["stream", "week"], "file", "row").withColumnRenamed("seq", "merged_seq")


@CAT.add("O6_content_hash", f"""WITH {TICKS_SQL}, n AS (SELECT stream, ts_event // 86400000 AS day, ts_event || ':' || seq AS text, ts_event, seq, row_number() OVER (PARTITION BY stream, ts_event // 86400000 ORDER BY ts_event, seq) - 1 AS i FROM ticks),
b AS (SELECT stream, day, i // 16 AS block, count(*) AS n, sha256(string_agg(text, '' ORDER BY i)) AS h FROM n GROUP BY 1, 2, 3) SELECT stream, day, sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY block)) AS fingerprint FROM b GROUP BY 1, 2""")
def o6(spark, sf_dir):
    """A fingerprint of every ordered part, a stream's day, by blocks of 16 rows."""
    t = ticks(spark, sf_dir).withColumn("day", F.floor(F.col("ts_event") / 86_400_000))
    return s.content_hash(t, ["stream", "day"], F.concat_ws(":", F.col("ts_event").cast("string"), F.col("seq").cast("string")), size=16)


@CAT.add("O7_order_faults", f"""WITH {TICKS_SQL}, x AS (SELECT stream, ts_event, seq, lag(ts_event) OVER o AS lt, lag(seq) OVER o AS ls FROM ticks WINDOW o AS (PARTITION BY stream ORDER BY symbol * 1000000 + seq))
SELECT stream, count(*) AS n, count(*) FILTER (WHERE ts_event = lt AND seq = ls) AS duplicates, count(*) FILTER (WHERE ts_event < lt OR (ts_event = lt AND seq < ls)) AS regressions FROM x GROUP BY 1""")
def o7(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("arrival", F.col("symbol") * 1_000_000 + F.col("seq"))
    return s.order_faults(t, ["stream"], "arrival")


@CAT.add("O8_top_candidates", f"""WITH {TICKS_SQL} SELECT symbol, stream, count(*) AS n, round(avg(price), 6) AS m FROM ticks GROUP BY 1, 2 ORDER BY m DESC, n DESC, symbol, stream LIMIT 25""")
def o8(spark, sf_dir):
    x = rounded(ticks(spark, sf_dir).groupBy("symbol", "stream").agg(F.count("*").alias("n"), F.avg("price").alias("m")))
    return s.top(x, [F.desc("m"), F.desc("n"), F.col("symbol"), F.col("stream")], 25)


@CAT.add("O8_best_of_family", f"""WITH {TICKS_SQL}, x AS (SELECT stream, symbol, week, count(*) AS n, round(avg(price), 6) AS m FROM ticks GROUP BY ALL)
SELECT stream, symbol, week, n, m FROM x QUALIFY row_number() OVER (PARTITION BY stream ORDER BY CASE WHEN stream IN ('click', 'error') THEN m ELSE -m END NULLS LAST, n DESC, week, symbol) = 1""")
def o8_family(spark, sf_dir):
    """Streams as families, two of which look for the lowest mean."""
    x = rounded(ticks(spark, sf_dir).groupBy("stream", "symbol", "week").agg(F.count("*").alias("n"), F.avg("price").alias("m")))
    return s.best_of_family(x, "stream", "m", ["click", "error"], [-F.col("n"), F.col("week"), F.col("symbol")])


@CAT.add("O9_O10_latest", f"""WITH {TICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_event DESC, seq DESC) AS i FROM ticks) SELECT {COLS} FROM r WHERE i = 1""")
def o9(spark, sf_dir):
    return s.latest(ticks(spark, sf_dir).select(*NAMES), ["symbol"], ["ts_event", "seq"])


def histories(spark, sf_dir):
    """Suppliers as a history, and orders as news of their customers' keys, which repeat."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0).cast("long").alias("i"), F.col("s_acctbal").alias("v"))
    return a, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("long").alias("i"), F.col("o_totalprice").alias("v"))


HISTORY_SQL = "a AS (SELECT s_suppkey AS k, 0::BIGINT AS i, s_acctbal AS v FROM supplier), b AS (SELECT o_custkey AS k, o_orderkey::BIGINT AS i, o_totalprice AS v FROM orders)"


@CAT.add("O11_merge_history", f"WITH {HISTORY_SQL} SELECT * FROM a UNION ALL (SELECT * FROM b WHERE k NOT IN (SELECT k FROM a) QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1)")
def o11(spark, sf_dir):
    return s.merge_history(*histories(spark, sf_dir), ["k"], ["i"])


@CAT.add("O11_merge_counts", f"WITH {HISTORY_SQL}, n AS (SELECT count(DISTINCT k) AS n FROM b WHERE k NOT IN (SELECT k FROM a)) SELECT n AS inserted, (SELECT count(*) FROM b) - n AS skipped FROM n")
def o11_counts(spark, sf_dir):
    return s.merge_counts(*histories(spark, sf_dir), ["k"])


@CAT.add("O12_append_new", """WITH a AS (SELECT DISTINCT o_orderstatus AS x, o_orderpriority AS y FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_orderstatus AS x, o_orderpriority AS y FROM orders)
SELECT * FROM b EXCEPT SELECT * FROM a""")
def o12(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("x"), F.col("o_orderpriority").alias("y"))
    return s.append_new(o.filter("x = 'F'"), o).drop("fingerprint")


@CAT.add("O13_O17_ranked", """WITH x AS (SELECT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS bucket, o_totalprice, o_orderkey FROM orders)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY bucket, o_totalprice DESC NULLS LAST, o_orderkey)::INT AS rank FROM x QUALIFY rank <= 3""")
def o13(spark, sf_dir):
    bucket = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", bucket.alias("bucket"), "o_totalprice", "o_orderkey")
    return s.ranked(x, ["o_custkey"], [F.col("bucket"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]).filter("rank <= 3")


REVIEW_SQL = """p AS (SELECT o_custkey, CASE WHEN sum(o_totalprice) > 1500000 THEN 'PROMOTE_STRONG' WHEN sum(o_totalprice) > 500000 THEN 'PROMOTE' ELSE 'HOLD' END AS tier, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed,
count(*) FILTER (WHERE o_orderstatus <> 'P') AS supported, max(o_totalprice) AS rss, count(*) * 31 AS elapsed, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN -10 ELSE 0 END AS bonus FROM orders GROUP BY 1),
v AS (SELECT *, round(CASE tier WHEN 'PROMOTE_STRONG' THEN 50 WHEN 'PROMOTE' THEN 30 ELSE 0 END + 20 * (passed / greatest(supported, 1)) - least(rss / 200000::DOUBLE, 10) - least(elapsed / 60::DOUBLE, 10) + bonus, 6) AS score FROM p)"""


def reviewed(spark, sf_dir):
    """Customers as candidate packs: finished orders are repeats that agreed, a partly finished one wasn't supported."""
    total = F.sum("o_totalprice")
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.when(total > 1_500_000, "PROMOTE_STRONG").when(total > 500_000, "PROMOTE").otherwise("HOLD").alias("tier"), F.count_if(F.col("o_orderstatus") == "F").alias("passed"),
        F.count_if(F.col("o_orderstatus") != "P").alias("supported"), F.max("o_totalprice").alias("rss"), (F.count("*") * 31).alias("elapsed"), F.when(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), -10).otherwise(0).alias("bonus"),
    )
    return p.withColumn("score", s.review_score(*map(F.col, ("tier", "passed", "supported", "rss", "elapsed", "bonus"))))


@CAT.add("O14_review_score", f"WITH {REVIEW_SQL} SELECT o_custkey, tier, score FROM v")
def o14(spark, sf_dir):
    return reviewed(spark, sf_dir).select("o_custkey", "tier", "score")


@CAT.add("O14_review_top", f"WITH {REVIEW_SQL} SELECT o_custkey, tier, score FROM v ORDER BY score DESC, tier <> 'PROMOTE_STRONG', passed / greatest(supported, 1) DESC, rss, elapsed, o_custkey LIMIT 10")
def o14_top(spark, sf_dir):
    """The ten best packs, as the review reports them."""
    ratio = F.col("passed") / F.greatest(F.col("supported"), F.lit(1))
    return s.top(reviewed(spark, sf_dir), [F.desc("score"), F.col("tier") != "PROMOTE_STRONG", ratio.desc(), F.col("rss"), F.col("elapsed"), F.col("o_custkey")], 10).select("o_custkey", "tier", "score")


@CAT.add("R7_round_robin", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r ORDER BY i, o_custkey LIMIT 120""")
def r7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return s.round_robin(o, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 120)


QUERIES, ORACLES = CAT.queries, CAT.oracles
