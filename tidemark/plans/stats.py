"""Queries over statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import stats as s
from ..operators.scans import number
from ..sources.events import TICKS_SQL, table, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
P_SQL = f"{TICKS_SQL}, p AS (SELECT *, least(price / 100, 1.0::DOUBLE) AS p, symbol % 2 AS side FROM ticks)"


def probabilities(spark, sf_dir):
    return ticks(spark, sf_dir).withColumns({"p": F.least(F.col("price") / 100, F.lit(1.0)), "side": F.col("symbol") % 2})


@CAT.add("A9_t_stat", f"WITH {TICKS_SQL} SELECT stream, count(*) AS n, round(avg(price - 20), 6) AS mean, round(avg(price - 20) / (stddev_samp(price - 20) / sqrt(count(*))), 6) AS t FROM ticks GROUP BY 1")
def a9(spark, sf_dir):
    v = F.col("price") - 20
    return rounded(ticks(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), s.t_stat(v).alias("t")))


@CAT.add("A10_correlation", f"""WITH {TICKS_SQL}, c AS (SELECT stream, count(*) AS n, corr(price, qty) AS r FROM ticks GROUP BY 1) SELECT stream, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM c""")
def a10(spark, sf_dir):
    x = ticks(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"), s.pearson(F.col("price"), F.col("qty")).alias("r"))
    return rounded(x.withColumn("t", s.corr_t(F.col("r"), F.col("n"))))


@CAT.add("A22_grouping_sets", """SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'overall' END AS scope,
coalesce(o_orderstatus, o_orderpriority, 'all') AS name, count(*) AS n, min(o_totalprice) AS lo, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, max(o_totalprice) AS hi
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def a22(spark, sf_dir):
    scope = lambda name, key: F.struct(F.lit(name).alias("scope"), key.cast("string").alias("_key"))
    scopes = F.array(scope("overall", F.lit(None)), scope("status", F.col("o_orderstatus")), scope("priority", F.col("o_orderpriority")))
    x = table(spark, sf_dir, "orders").select(F.explode(scopes).alias("_s"), "o_totalprice").select("_s.*", "o_totalprice")
    x = s.percentiles(x, ["scope", "_key"], "o_totalprice", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return rounded(x.select("scope", F.coalesce("_key", F.lit("all")).alias("name"), "n", "lo", "p10", "median", "p90", "hi"))


@CAT.add("M1_distribution", f"""WITH {TICKS_SQL}, b AS (SELECT stream, count(*) AS n, avg(price) AS mean, stddev_pop(price) AS std, median(price) AS median, min(price) AS mn, max(price) AS mx FROM ticks GROUP BY 1),
m AS (SELECT t.stream, avg(((price - mean) / std) ** 3) AS skew, avg(((price - mean) / std) ** 4) - 3 AS kurt FROM ticks t JOIN b ON t.stream = b.stream GROUP BY 1),
i AS (SELECT stream, price, row_number() OVER (PARTITION BY stream ORDER BY price) AS k, count(*) OVER (PARTITION BY stream) AS n FROM ticks),
q AS (SELECT stream, max(price) FILTER (WHERE k = floor(0.25 * n) + 1) AS q1, max(price) FILTER (WHERE k = floor(0.75 * n) + 1) AS q3 FROM i GROUP BY 1)
SELECT b.stream, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, mn AS min, mx AS max, round(skew, 6) AS skew, round(kurt, 6) AS excess_kurtosis, q1, q3, round(q3 - q1, 6) AS iqr FROM b JOIN m USING (stream) JOIN q USING (stream)""")
def m1(spark, sf_dir):
    return rounded(s.distribution(ticks(spark, sf_dir), ["stream"], "price"))


@CAT.add("M2_outliers", f"""WITH {TICKS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY price) AS k, count(*) OVER (PARTITION BY stream) AS n FROM ticks),
q AS (SELECT stream, max(price) FILTER (WHERE k = floor(0.25 * n) + 1) AS q1, max(price) FILTER (WHERE k = floor(0.75 * n) + 1) AS q3 FROM i GROUP BY 1)
SELECT seq, stream, price FROM ticks JOIN q USING (stream) WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)""")
def m2(spark, sf_dir):
    return s.outliers(ticks(spark, sf_dir).select("seq", "stream", "price"), ["stream"], "price").select("seq", "stream", "price")


@CAT.add("M3_kolmogorov_smirnov", f"""WITH {P_SQL}, c AS (SELECT stream, p, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM p GROUP BY 1, 2),
u AS (SELECT stream, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY stream) - sum(b) OVER w / sum(b) OVER (PARTITION BY stream)) AS g FROM c WINDOW w AS (PARTITION BY stream ORDER BY p)),
d AS (SELECT stream, max(g) AS d, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM u GROUP BY 1), l AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * d AS lam FROM d)
SELECT stream, round(d, 6) AS d, n_a, n_b, round(least(greatest(list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * lam * lam))), 0), 1), 6) AS p FROM l""")
def m3(spark, sf_dir):
    return rounded(s.ks_two_sample(probabilities(spark, sf_dir), ["stream"], "p", "side"))


@CAT.add("M4_spearman", f"""WITH {TICKS_SQL}, r AS (SELECT stream, rank() OVER (PARTITION BY stream ORDER BY price) + (count(*) OVER (PARTITION BY stream, price) - 1) / 2 AS a,
rank() OVER (PARTITION BY stream ORDER BY qty) + (count(*) OVER (PARTITION BY stream, qty) - 1) / 2 AS b FROM ticks) SELECT stream, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def m4(spark, sf_dir):
    x = s.average_rank(s.average_rank(ticks(spark, sf_dir), ["stream"], "price", "a"), ["stream"], "qty", "b")
    return rounded(x.groupBy("stream").agg(s.pearson(F.col("a"), F.col("b")).alias("rho")))


@CAT.add("M5_correlation_matrix", """SELECT a AS a, b AS b, round(r, 6) AS r, abs(r) >= 0.8 AS high FROM (
SELECT 'quantity' AS a, 'price' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'quantity', 'discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'quantity', 'tax', corr(l_quantity, l_tax) FROM lineitem
UNION ALL SELECT 'price', 'discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'price', 'tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'discount', 'tax', corr(l_discount, l_tax) FROM lineitem)""")
def m5(spark, sf_dir):
    """All pairs of columns in one pass; the matrix is one row until it is unpivoted."""
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    pairs = [(a, b) for i, a in enumerate(names) for b in list(names)[i + 1 :]]
    one = table(spark, sf_dir, "lineitem").agg(*[s.pearson(F.col(names[a]), F.col(names[b])).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])
    x = one.select(F.explode(rows).alias("x")).select("x.*")
    return rounded(x.withColumn("high", F.abs("r") >= 0.8))


CORR_SQL = ", ".join(f"corr({a}, {b})" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")))


@CAT.add("M5_clusters", f"""WITH c AS (SELECT list_reverse(list_sort(list_transform([{CORR_SQL}], lambda r: abs(r)))) AS v, abs(corr(l_quantity, l_extendedprice)) AS qp FROM lineitem)
SELECT f AS feature, CASE WHEN f = 'price' AND qp >= 0.8 THEN 'quantity' ELSE f END AS cluster, round(list_avg(v[1:5]), 6) AS redundancy FROM c, (SELECT unnest(['quantity', 'price', 'discount', 'tax']) AS f)""")
def m5_clusters(spark, sf_dir):
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    order = list(names)
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    one = table(spark, sf_dir, "lineitem").agg(*[s.pearson(F.col(names[a]), F.col(names[b])).alias(f"{a}_{b}") for a, b in pairs])
    return rounded(s.correlation_clusters(one, order))


@CAT.add("M6_point_biserial", f"""WITH {TICKS_SQL}, r AS (SELECT stream, corr(price, (qty > 50)::INT) AS r FROM ticks GROUP BY 1) SELECT stream, round(r, 6) AS r, CASE WHEN abs(r) >= 0.5 THEN 'STRONG' WHEN abs(r) >= 0.3 THEN 'MODERATE' WHEN abs(r) >= 0.1 THEN 'WEAK' ELSE 'NONE' END AS strength FROM r""")
def m6(spark, sf_dir):
    x = ticks(spark, sf_dir).groupBy("stream").agg(s.pearson(F.col("price"), (F.col("qty") > 50).cast("int")).alias("r"))
    a = F.abs("r")
    return rounded(x.withColumn("strength", F.when(a >= 0.5, "STRONG").when(a >= 0.3, "MODERATE").when(a >= 0.1, "WEAK").otherwise("NONE")))


RANKED = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


@CAT.add("M6_label_ranking", f"""WITH c AS (SELECT unnest([{", ".join(f"struct_pack(f := '{n}', r := corr({n}, (l_quantity * 1000 + l_extendedprice > 80000)::INT))" for n in RANKED)}]) AS u FROM lineitem),
x AS (SELECT u.f AS feature, u.r AS correlation, coalesce(abs(u.r), 0) AS size FROM c) SELECT feature, round(correlation, 6) AS correlation, round(size, 6) AS size, CASE WHEN size >= 0.5 THEN 'STRONG' WHEN size >= 0.3 THEN 'MODERATE' WHEN size >= 0.1 THEN 'WEAK' ELSE 'NEGLIGIBLE' END AS strength,
(row_number() OVER (ORDER BY size DESC, feature))::INT AS rank FROM x""")
def m6_ranking(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("high", (F.col("l_quantity") * 1000 + F.col("l_extendedprice") > 80_000).cast("int"))
    return rounded(s.label_ranking(x, RANKED, "high"))


@CAT.add("M7_label_balance", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) AS p FROM c)
SELECT o_orderpriority, sum(n)::BIGINT AS n, count(*) AS labels, round(max(n) / min(n), 6) AS imbalance, round(-sum(p * log2(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS normalised_entropy FROM p GROUP BY 1""")
def m7(spark, sf_dir):
    return rounded(s.label_balance(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus"))


@CAT.add("M8_label_drift", f"""WITH {TICKS_SQL}, i AS (SELECT stream, qty >= 50 AS label, (row_number() OVER (PARTITION BY stream ORDER BY ts_event, seq) - 1) // 50 AS h FROM ticks),
e AS (SELECT stream, label, unnest([h, h - 1]) AS win FROM i), w AS (SELECT stream, win, count(*) FILTER (WHERE label) AS a, count(*) FILTER (WHERE NOT label) AS b FROM e WHERE win >= 0 GROUP BY 1, 2 HAVING count(*) = 100)
SELECT x.stream, x.win AS "window", round((abs(x.a - y.a) / 100 + abs(x.b - y.b) / 100) / 2, 6) AS drift,
CASE WHEN (abs(x.a - y.a) / 100 + abs(x.b - y.b) / 100) / 2 > 0.3 THEN 'HIGH' WHEN (abs(x.a - y.a) / 100 + abs(x.b - y.b) / 100) / 2 > 0.2 THEN 'DRIFT' ELSE 'OK' END AS level FROM w x JOIN w y ON x.stream = y.stream AND x.win = y.win + 1""")
def m8(spark, sf_dir):
    x = ticks(spark, sf_dir).withColumn("label", F.col("qty") >= 50)
    return rounded(s.window_drift(x, ["stream"], "label", 100))


@CAT.add("M10_psi", f"""WITH {P_SQL}, r AS (SELECT stream, min(p) AS lo, max(p) AS hi FROM p WHERE side = 0 GROUP BY 1), b AS (SELECT p.stream, side, least(greatest(floor((p - lo) / (hi - lo) * 10), 0), 9) AS bin FROM p JOIN r USING (stream)),
c AS (SELECT stream, bin, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS z FROM b GROUP BY 1, 2), t AS (SELECT stream, sum(a) AS na, sum(z) AS nz FROM c GROUP BY 1),
g AS (SELECT t.stream, greatest(coalesce(a, 0) / na, 1e-4) AS p, greatest(coalesce(z, 0) / nz, 1e-4) AS q FROM t CROSS JOIN range(10) n(bin) LEFT JOIN c ON c.stream = t.stream AND c.bin = n.bin),
o AS (SELECT stream, sum((q - p) * ln(q / p)) AS psi FROM g GROUP BY 1) SELECT stream, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.25 THEN 'SHIFT' ELSE 'UNSTABLE' END AS level FROM o""")
def m10(spark, sf_dir):
    return rounded(s.psi(probabilities(spark, sf_dir), ["stream"], "p", "side"))


@CAT.add("M14_confusion", f"""WITH {P_SQL}, x AS (SELECT stream, qty > 50 AS y, p >= 0.3 AS g FROM p), c AS (SELECT stream, count(*) FILTER (WHERE y AND g) AS tp, count(*) FILTER (WHERE NOT y AND g) AS fp, count(*) FILTER (WHERE NOT y AND NOT g) AS tn, count(*) FILTER (WHERE y AND NOT g) AS fn FROM x GROUP BY 1)
SELECT stream, tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""")
def m14(spark, sf_dir):
    return rounded(s.confusion(probabilities(spark, sf_dir), ["stream"], F.col("qty") > 50, F.col("p") >= 0.3))


@CAT.add("M14_threshold_grid", f"""WITH {P_SQL}, x AS (SELECT stream, t AS threshold, qty > 50 AS y, p >= t AS g FROM p, (SELECT unnest([0.5::DOUBLE, 0.55, 0.6, 0.65, 0.7]) AS t)),
c AS (SELECT stream, threshold, count(*) FILTER (WHERE y AND g) AS tp, count(*) FILTER (WHERE NOT y AND g) AS fp, count(*) FILTER (WHERE NOT y AND NOT g) AS tn, count(*) FILTER (WHERE y AND NOT g) AS fn FROM x GROUP BY 1, 2),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, tn / nullif(tn + fp, 0) AS sp FROM c), f AS (SELECT *, 2 * pr * re / nullif(pr + re, 0) AS f FROM r)
SELECT stream, threshold, tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, round((re + sp) / 2, 6) AS balanced_accuracy, f IS NOT NULL AND row_number() OVER (PARTITION BY stream ORDER BY f DESC NULLS LAST, threshold) = 1 AS best FROM f""")
def m14_grid(spark, sf_dir):
    return rounded(s.threshold_grid(probabilities(spark, sf_dir), ["stream"], F.col("qty") > 50, "p"))


@CAT.add("M15_chronological_split", f"""WITH {TICKS_SQL}, r AS (SELECT seq, stream, row_number() OVER (PARTITION BY stream ORDER BY ts_event, seq) AS i, count(*) OVER (PARTITION BY stream) AS n FROM ticks)
SELECT seq, stream, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM r""")
def m15(spark, sf_dir):
    i, n = F.col("_i") + 1, F.col("_n")
    return number(ticks(spark, sf_dir), ["stream"]).select("seq", "stream", F.when(i <= F.floor(n * 0.7), "train").when(i <= F.floor(n * 0.85), "valid").otherwise("test").alias("split"))


def welch_sql(by: str) -> str:
    return f"""WITH {TICKS_SQL}, a AS (SELECT {by}, count(*) FILTER (WHERE qty > 70) AS n_in, avg(price) FILTER (WHERE qty > 70) AS mean_in, coalesce(var_pop(price) FILTER (WHERE qty > 70), 0) AS vi, count(*) FILTER (WHERE NOT qty > 70) AS n_out, avg(price) FILTER (WHERE NOT qty > 70) AS mean_out, coalesce(var_pop(price) FILTER (WHERE NOT qty > 70), 0) AS vo FROM ticks GROUP BY 1),
e AS (SELECT *, vi / nullif(n_in, 0) AS a, vo / nullif(n_out, 0) AS b FROM a), f AS (SELECT *, CASE WHEN a + b > 0 THEN (mean_in - mean_out) / sqrt(a + b) ELSE 0 END AS t,
CASE WHEN a + b > 0 THEN (a + b) * (a + b) / (coalesce(a * a / nullif(n_in - 1, 0), 0) + coalesce(b * b / nullif(n_out - 1, 0), 0)) ELSE 0 END AS df FROM e),
z AS (SELECT *, CASE WHEN df > 30 THEN abs(t) ELSE abs(t) * sqrt(df / (df + 1)) END AS z FROM f), k AS (SELECT *, 1.0 / (1.0 + 0.2316419 * z) AS k FROM z)
SELECT {by}, n_in, round(mean_in, 6) AS mean_in, n_out, round(mean_out, 6) AS mean_out, round(t, 6) AS t, round(df, 6) AS df,
CASE WHEN a + b > 0 THEN round(2 * exp(-z * z / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))), 6) ELSE 1 END AS p FROM k"""


@CAT.add("M23_welch", welch_sql("stream"))
def m23(spark, sf_dir):
    return rounded(s.welch(ticks(spark, sf_dir).withColumn("hit", F.col("qty") > 70), ["stream"], "price", "hit"))


@CAT.add("M23_welch_small", welch_sql("symbol"))
def m23_small(spark, sf_dir):
    """By symbol: few rows a group, so few degrees of freedom."""
    return rounded(s.welch(ticks(spark, sf_dir).withColumn("hit", F.col("qty") > 70), ["symbol"], "price", "hit"))


@CAT.add("R1_histogram", f"""WITH {P_SQL}, c AS (SELECT stream, least(floor(p * 8), 7)::BIGINT AS bin, count(*) AS n FROM p GROUP BY 1, 2) SELECT s.stream, g.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT stream FROM p) s CROSS JOIN range(8) g(bin) LEFT JOIN c ON c.stream = s.stream AND c.bin = g.bin""")
def r1(spark, sf_dir):
    return s.histogram(probabilities(spark, sf_dir), ["stream"], "p", 8)


@CAT.add("R2_calibration", f"WITH {P_SQL} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS avg_p, round(avg((qty > 50)::INT), 6) AS win_rate FROM p GROUP BY 1")
def r2(spark, sf_dir):
    return rounded(s.calibration(probabilities(spark, sf_dir), "p", F.col("qty") > 50, 10))


QUERIES, ORACLES = CAT.queries, CAT.oracles
