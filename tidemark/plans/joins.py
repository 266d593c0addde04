"""Queries that join: as-of, nearest, lookup, pairing and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import temporal
from ..sources.events import TICKS_SQL, table, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
SIDES = f"{TICKS_SQL}, l AS (SELECT * FROM ticks WHERE stream = 'click'), r AS (SELECT * FROM ticks WHERE stream = 'view')"


def sides(spark, sf_dir):
    t = ticks(spark, sf_dir).select("ts_event", "seq", "symbol", "stream", "price")
    return t.filter("stream = 'click'").drop("stream"), t.filter("stream = 'view'").drop("stream")


def asof_sql(condition: str, order: str, extra: str = "") -> str:
    return f"""WITH {SIDES}, c AS (
SELECT l.ts_event, l.seq, l.symbol, l.price, r.ts_event AS rt, r.seq AS rs, r.price AS rp,
       row_number() OVER (PARTITION BY l.seq ORDER BY {order}) AS rn
FROM l LEFT JOIN r ON l.symbol = r.symbol AND {condition} {extra})
SELECT ts_event, seq, symbol, price, rt AS r_ts_event, rs AS r_seq, rp AS r_price FROM c WHERE rn = 1"""


@CAT.add("J1_asof_backward", asof_sql("r.ts_event <= l.ts_event - 5000", "r.ts_event DESC, r.seq DESC"))
def j1(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return temporal.asof_backward(left, right, ["symbol"], ["price"], -5000)


@CAT.add("J2_asof_forward", asof_sql("r.ts_event >= l.ts_event + 10000", "r.ts_event, r.seq"))
def j2(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return temporal.asof_forward(left, right, ["symbol"], ["price"], 10000)


@CAT.add("J3_asof_tolerance", asof_sql("r.ts_event <= l.ts_event AND r.ts_event >= l.ts_event - 86400000", "r.ts_event DESC, r.seq DESC"))
def j3(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return temporal.asof_backward(left, right, ["symbol"], ["price"], 0, 86_400_000)


@CAT.add("J4_nearest_tolerance", asof_sql("abs(r.ts_event - l.ts_event - 60000) <= 43200000", "abs(r.ts_event - l.ts_event - 60000), r.ts_event, r.seq"))
def j4(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return temporal.nearest(left, right, ["symbol"], ["price"], 60_000, 43_200_000)


@CAT.add("J5_nearest", asof_sql("true", "abs(r.ts_event - l.ts_event), r.ts_event, r.seq"))
def j5(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return temporal.nearest(left, right, ["symbol"], ["price"])


BOUNDARIES = "b AS (SELECT DISTINCT symbol, ts_event // 28800000 * 28800000 AS ts_event, 0 AS seq FROM ticks)"


def boundaries(t):
    return t.select("symbol", (F.col("ts_event") - F.col("ts_event") % 28_800_000).alias("ts_event")).distinct().withColumn("seq", F.lit(0).cast("long"))


@CAT.add("J6_latest_at_boundary", f"""WITH {TICKS_SQL}, {BOUNDARIES}
SELECT b.symbol, b.ts_event, t.ts_event AS mark_ts_event, t.price AS mark_price
FROM b LEFT JOIN LATERAL (SELECT ts_event, price FROM ticks t WHERE t.symbol = b.symbol AND t.ts_event <= b.ts_event ORDER BY t.ts_event DESC, t.seq DESC LIMIT 1) t ON true""")  # fmt: skip
def j6(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return temporal.asof_backward(boundaries(t), t, ["symbol"], ["price"], prefix="mark_").drop("seq", "mark_seq")


@CAT.add("J7_state_at_boundary", f"""WITH {TICKS_SQL}, {BOUNDARIES}
SELECT b.symbol, b.ts_event, coalesce(sum(CASE WHEN t.stream = 'purchase' THEN t.qty ELSE -t.qty END), 0)::DOUBLE AS position
FROM b LEFT JOIN ticks t ON t.symbol = b.symbol AND t.ts_event <= b.ts_event AND t.stream IN ('purchase', 'error') GROUP BY 1, 2""")  # fmt: skip
def j7(spark, sf_dir):
    t = ticks(spark, sf_dir)
    moves = t.filter("stream in ('purchase', 'error')").withColumn("signed", F.when(F.col("stream") == "purchase", F.col("qty")).otherwise(-F.col("qty")))
    return temporal.state_at(boundaries(t), moves, ["symbol"], "signed", "position").drop("seq")


@CAT.add("J8_grid_cross", f"""WITH {TICKS_SQL}, g AS (SELECT d, h FROM (VALUES (1), (5), (10)) a(d), (VALUES (10), (60)) b(h))
SELECT stream, d, h, count(*) AS n, round(avg(price) * d + h, 6) AS score FROM ticks, g GROUP BY 1, 2, 3""")  # fmt: skip
def j8(spark, sf_dir):
    """The grid meets aggregates, not rows."""
    sums = ticks(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"), F.avg("price").alias("m"))
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(h).alias("h")) for d in (1, 5, 10) for h in (10, 60)])).alias("g")
    return rounded(sums.select("stream", "n", "m", grid).select("stream", "g.d", "g.h", "n", (F.col("m") * F.col("g.d") + F.col("g.h")).alias("score")))


@CAT.add("J9_lookup_defaults", """SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS nation, coalesce(c_acctbal, 0) AS balance
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def j9(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    x = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.select("c_custkey", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@CAT.add("J10_pending", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def j10(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@CAT.add("J11_entry_exit", f"""WITH {TICKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol, stream ORDER BY ts_event, seq) AS k FROM ticks WHERE stream IN ('signup', 'purchase'))
SELECT e.symbol, e.k::INT AS trade_no, e.price AS entry_price, x.price AS exit_price, x.ts_event - e.ts_event AS holding_ms, round(x.price - e.price, 6) AS pnl
FROM n e JOIN n x ON e.symbol = x.symbol AND e.k = x.k AND e.stream = 'signup' AND x.stream = 'purchase'""")  # fmt: skip
def j11(spark, sf_dir):
    w = Window.partitionBy("symbol", "stream").orderBy("ts_event", "seq")
    n = ticks(spark, sf_dir).filter("stream in ('signup', 'purchase')").withColumn("trade_no", F.row_number().over(w))
    e = n.filter("stream = 'signup'").select("symbol", "trade_no", F.col("price").alias("entry_price"), F.col("ts_event").alias("t0"))
    x = n.filter("stream = 'purchase'").select("symbol", "trade_no", F.col("price").alias("exit_price"), F.col("ts_event").alias("t1"))
    j = e.join(x, ["symbol", "trade_no"])
    return j.select("symbol", "trade_no", "entry_price", "exit_price", (F.col("t1") - F.col("t0")).alias("holding_ms"), F.round(F.col("exit_price") - F.col("entry_price"), 6).alias("pnl"))


@CAT.add("J12_first_last_of_key", f"""WITH {TICKS_SQL} SELECT symbol, arg_min(stream, (ts_event, seq)) AS first_stream, arg_max(stream, (ts_event, seq)) AS last_stream, count(*) AS n FROM ticks GROUP BY symbol""")
def j12(spark, sf_dir):
    at = F.struct("ts_event", "seq")
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.min_by("stream", at).alias("first_stream"), F.max_by("stream", at).alias("last_stream"), F.count("*").alias("n"))


@CAT.add("J13_adjacent_days", f"""WITH {TICKS_SQL}, d AS (SELECT DISTINCT symbol, ts_event // 86400000 AS day FROM ticks),
n AS (SELECT symbol, day, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS next_day FROM d) SELECT symbol, day, next_day FROM n WHERE next_day = day + 1""")  # fmt: skip
def j13(spark, sf_dir):
    d = ticks(spark, sf_dir).select("symbol", F.floor(F.col("ts_event") / 86_400_000).alias("day")).distinct()
    return d.withColumn("next_day", F.lead("day").over(Window.partitionBy("symbol").orderBy("day"))).filter("next_day = day + 1")


@CAT.add("J14_excursion", f"""WITH {TICKS_SQL} SELECT seq, min(price) OVER w AS min_price, max(price) OVER w AS max_price FROM ticks
WINDOW w AS (PARTITION BY stream, week ORDER BY ts_event RANGE BETWEEN CURRENT ROW AND 3600000 FOLLOWING)""")  # fmt: skip
def j14(spark, sf_dir):
    return temporal.excursion(ticks(spark, sf_dir), ["stream", "week"], "price", 3_600_000).select("seq", "min_price", "max_price")


@CAT.add("J15_reconcile", f"""WITH {TICKS_SQL},
a AS (SELECT symbol, sum(qty) AS paper FROM ticks WHERE stream = 'click' GROUP BY 1 HAVING sum(qty) <> 0),
b AS (SELECT symbol, sum(qty) AS venue FROM ticks WHERE stream = 'view' GROUP BY 1 HAVING sum(qty) <> 0)
SELECT coalesce(a.symbol, b.symbol) AS symbol, paper, venue,
 CASE WHEN venue IS NULL THEN 'ORPHAN_PAPER' WHEN paper IS NULL THEN 'ORPHAN_VENUE' WHEN abs(paper - venue) / abs(venue) > 0.0001 THEN 'MISMATCH' ELSE 'MATCH' END AS state,
 CASE WHEN paper IS NULL OR venue IS NULL THEN NULL WHEN abs(paper - venue) / abs(venue) > 0.10 THEN 'CRITICAL' WHEN abs(paper - venue) / abs(venue) > 0.05 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM a FULL JOIN b ON a.symbol = b.symbol""")  # fmt: skip
def j15(spark, sf_dir):
    t = ticks(spark, sf_dir)
    a = t.filter("stream = 'click'").groupBy("symbol").agg(F.sum("qty").alias("paper")).filter("paper <> 0")
    b = t.filter("stream = 'view'").groupBy("symbol").agg(F.sum("qty").alias("venue")).filter("venue <> 0")
    off = F.abs(F.col("paper") - F.col("venue")) / F.abs("venue")
    state = F.when(F.col("venue").isNull(), "ORPHAN_PAPER").when(F.col("paper").isNull(), "ORPHAN_VENUE").when(off > 0.0001, "MISMATCH").otherwise("MATCH")
    severity = F.when(F.col("paper").isNull() | F.col("venue").isNull(), None).when(off > 0.10, "CRITICAL").when(off > 0.05, "WARNING").otherwise("INFO")
    return a.join(b, "symbol", "full_outer").select("symbol", "paper", "venue", state.alias("state"), severity.alias("severity"))


@CAT.add("J16_ordered_merge", f"""WITH {TICKS_SQL} SELECT a.ts_event, a.seq, a.price, b.price > 50 AS label FROM ticks a JOIN ticks b ON a.ts_event = b.ts_event AND a.seq = b.seq""")
def j16(spark, sf_dir):
    t = ticks(spark, sf_dir)
    labels = t.select("ts_event", "seq", (F.col("price") > 50).alias("label"))
    return t.select("ts_event", "seq", "price").join(labels, ["ts_event", "seq"])


@CAT.add("J17_twins", f"""WITH {TICKS_SQL}, r AS (SELECT symbol, week, max(seq) FILTER (WHERE stream = 'click') AS off_run, max(seq) FILTER (WHERE stream = 'view') AS shadow_run FROM ticks GROUP BY 1, 2)
SELECT * FROM r WHERE off_run IS NOT NULL AND shadow_run IS NOT NULL""")  # fmt: skip
def j17(spark, sf_dir):
    one = lambda s: F.max(F.when(F.col("stream") == s, F.col("seq")))
    return ticks(spark, sf_dir).groupBy("symbol", "week").agg(one("click").alias("off_run"), one("view").alias("shadow_run")).dropna(subset=["off_run", "shadow_run"])


QUERIES, ORACLES = CAT.queries, CAT.oracles
