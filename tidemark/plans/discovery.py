"""Queries over pattern discovery and validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chance
from ..operators import clusters as cl
from ..operators import decisions
from ..operators import discovery as d
from ..operators import spacing
from ..operators.rollups import first_of
from ..operators.scans import along
from ..operators.slices import ranked
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, table, ticks
from .registry import Catalogue, rounded

CAT = Catalogue()
ROWS_SQL = f"""{QUOTES_SQL}, v AS (SELECT stream, ts_event, seq, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS f_imbalance, (symbol % 21) / 10.0::DOUBLE - 1 AS f_place,
lead(mid, 10) OVER o / mid - 1 AS h10, lead(mid, 50) OVER o / mid - 1 AS h50, seq % 3 AS regime FROM quotes WINDOW o AS (PARTITION BY stream ORDER BY ts_event, seq)),
e AS (SELECT *, CASE WHEN f_imbalance > 0.3::DOUBLE THEN h10 WHEN f_imbalance < -0.3::DOUBLE THEN -h10 END AS r FROM v)"""
YEAR = "sqrt(7200000.0::DOUBLE)"
FEATURES, RETURNS = ["f_imbalance", "f_place"], ["h10", "h50"]


def rows(spark, sf_dir):
    """Two features in [-1, 1], two forward returns, a regime, and the trades of one pattern."""
    ahead = lambda n: lambda w: F.lead("mid", n).over(w) / F.col("mid") - 1
    q = along(quotes(spark, sf_dir), ["stream"], {"h10": ahead(10), "h50": ahead(50)}, after=50)
    x = q.select(
        "stream", "ts_event", "seq", ((F.col("bid_qty") - F.col("ask_qty")) / (F.col("bid_qty") + F.col("ask_qty"))).alias("f_imbalance"),
        ((F.col("symbol") % 21) / F.lit(10.0) - 1).alias("f_place"), "h10", "h50", (F.col("seq") % 3).alias("regime"),
    )
    return x.withColumn("r", F.when(F.col("f_imbalance") > 0.3, F.col("h10")).when(F.col("f_imbalance") < -0.3, -F.col("h10")))


CELLS_SQL = """, s AS (SELECT m.feature, m.op, m.bound, scope, horizon, value FROM m, LATERAL (VALUES ('all'), ('regime ' || m.regime)) x(scope), LATERAL (VALUES ('h10', m.h10), ('h50', m.h50)) y(horizon, value) WHERE value IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY feature, op, bound, scope, horizon ORDER BY value) AS i, count(*) OVER (PARTITION BY feature, op, bound, scope, horizon) AS n FROM s)"""
CELLS_OUT = "SELECT feature, op, bound, scope, horizon, count(*) AS support, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value) FILTER (WHERE i = least(n // 2 + 1, n)), 6) AS median FROM k GROUP BY ALL"
LONG_SQL = ", l AS (SELECT regime, h10, h50, feature, x FROM v, LATERAL (VALUES ('f_imbalance', f_imbalance), ('f_place', f_place)) w(feature, x))"
THRESHOLD_SQL = f"""WITH {ROWS_SQL} {LONG_SQL}, t AS (SELECT unnest([0.3::DOUBLE, 0.5, 0.7]) AS t),
m AS (SELECT l.*, '>' AS op, t AS bound FROM l, t WHERE x > t UNION ALL SELECT l.*, '<', -t FROM l, t WHERE x < -t) {CELLS_SQL}"""


@CAT.add("M19_threshold_scan", f"{THRESHOLD_SQL} {CELLS_OUT}")
def m19(spark, sf_dir):
    return rounded(d.threshold_scan(rows(spark, sf_dir), FEATURES, RETURNS, "regime"))


@CAT.add("M22_M26b_kept_patterns", f"""{THRESHOLD_SQL}, p AS (SELECT feature, op, bound, scope, horizon, count(*) AS support, avg(value) AS mean, stddev_pop(value) AS std FROM k GROUP BY ALL HAVING count(*) >= 30 AND abs(avg(value)) >= 0.0005)
SELECT feature, op, bound, scope, horizon, support, round(least(greatest(0.5 + 0.5 * (2 / (1 + exp(-2 * mean / std)) - 1), 0.3), 0.9), 6) AS win_rate, round(2 * std, 6) AS max_drawdown, round(abs(mean) + 2 * std, 6) AS max_loss, round(3 * std, 6) AS tail_risk FROM p""")
def m22(spark, sf_dir):
    x = d.edge_statistics(d.kept_patterns(d.threshold_scan(rows(spark, sf_dir), FEATURES, RETURNS, "regime")))
    return rounded(x.drop("mean", "std", "median"), 6).select("feature", "op", "bound", "scope", "horizon", "support", "win_rate", "max_drawdown", "max_loss", "tail_risk")


@CAT.add("M20_quantile_scan", f"""WITH {ROWS_SQL} {LONG_SQL}, z AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS i, count(*) OVER (PARTITION BY feature) AS n FROM l WHERE x IS NOT NULL),
q AS (SELECT feature, max(x) FILTER (WHERE i = floor(0.1::DOUBLE * n) + 1) AS lo, max(x) FILTER (WHERE i = floor(0.9::DOUBLE * n) + 1) AS hi FROM z GROUP BY 1),
m AS (SELECT l.*, '>' AS op, hi AS bound FROM l JOIN q USING (feature) WHERE x > hi UNION ALL SELECT l.*, '<', lo FROM l JOIN q USING (feature) WHERE x < lo) {CELLS_SQL} {CELLS_OUT.replace("bound, scope", "round(bound, 6) AS bound, scope")}""")
def m20(spark, sf_dir):
    return rounded(d.quantile_scan(rows(spark, sf_dir), FEATURES, RETURNS, "regime"))


def sharpe_sql(x: str) -> str:
    return f"CASE WHEN coalesce(min({x}) = max({x}), true) THEN 0 ELSE avg({x}) / stddev_pop({x}) * {YEAR} END"


@CAT.add("M25_sharpe", f"WITH {ROWS_SQL} SELECT stream, regime, round({sharpe_sql('r')}, 6) AS sharpe, count(r) AS trades FROM e GROUP BY 1, 2")
def m25(spark, sf_dir):
    return rounded(rows(spark, sf_dir).groupBy("stream", "regime").agg(d.sharpe(F.col("r")).alias("sharpe"), F.count("r").alias("trades")))


I_SQL = f"{ROWS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts_event, seq) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM e)"
OOS_SQL = f""", os AS (SELECT stream, {sharpe_sql('CASE WHEN i < floor(n * 0.7::DOUBLE) THEN r END')} AS is_sharpe, {sharpe_sql('CASE WHEN NOT i < floor(n * 0.7::DOUBLE) THEN r END')} AS oos_sharpe,
count(CASE WHEN i < floor(n * 0.7::DOUBLE) THEN r END) AS is_trades, count(CASE WHEN NOT i < floor(n * 0.7::DOUBLE) THEN r END) AS oos_trades FROM i GROUP BY 1),
ol AS (SELECT *, CASE WHEN is_sharpe = 0 THEN 0 ELSE (is_sharpe - oos_sharpe) / abs(is_sharpe) END AS degradation FROM os),
oos AS (SELECT *, oos_sharpe >= 0.5 AND degradation <= 0.5 AS oos_passed, (least(1.0, oos_sharpe / 0.5) + greatest(0.0, 1 - degradation / 0.5) + least(1.0, oos_trades / 30)) / 3 AS oos_confidence FROM ol)"""


@CAT.add("M27_out_of_sample", f"""WITH {I_SQL} {OOS_SQL} SELECT stream, round(is_sharpe, 6) AS is_sharpe, round(oos_sharpe, 6) AS oos_sharpe, is_trades, oos_trades, round(degradation, 6) AS degradation, oos_passed, round(oos_confidence, 6) AS oos_confidence FROM oos""")
def m27(spark, sf_dir):
    return rounded(d.out_of_sample(rows(spark, sf_dir), ["stream"]))


WF_SQL = f""", wk AS (SELECT stream, r, n, unnest(range(greatest(0, (i - 80) // 20), i // 20 + 1)) AS k FROM i), ws AS (SELECT stream, k, {sharpe_sql('r')} AS s FROM wk WHERE k * 20 + 100 <= n GROUP BY 1, 2),
wg AS (SELECT stream, count(*) AS windows, avg((s > 0)::INT) AS positive_fraction, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(s, k) END AS sharpe_trend, stddev_pop(s) AS consistency FROM ws GROUP BY 1),
wf AS (SELECT *, positive_fraction >= 0.6 AND sharpe_trend >= -0.5 AS wf_passed FROM wg)"""


@CAT.add("M28_walk_forward", f"WITH {I_SQL} {WF_SQL} SELECT stream, windows, round(positive_fraction, 6) AS positive_fraction, round(sharpe_trend, 6) AS sharpe_trend, round(consistency, 6) AS consistency, wf_passed FROM wf")
def m28(spark, sf_dir):
    return rounded(d.walk_forward(rows(spark, sf_dir), ["stream"], 100, 20))


DECAY_SQL = """, dw AS (SELECT stream, i // 50 AS k, coalesce(avg(r), 0) AS m FROM i WHERE (i // 50 + 1) * 50 <= n GROUP BY 1, 2), dg AS (SELECT stream, count(*) AS w, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(m, k) END AS decay_rate FROM dw GROUP BY 1),
dc AS (SELECT stream, regime, count(*) FILTER (WHERE i < n // 4) AS a, count(*) FILTER (WHERE i >= n - n // 4) AS b, max(n // 4) AS q FROM i GROUP BY 1, 2 HAVING count(*) FILTER (WHERE i < n // 4) > 0 OR count(*) FILTER (WHERE i >= n - n // 4) > 0),
dp AS (SELECT *, (a + 1) / (q + count(*) OVER (PARTITION BY stream)) AS p1, (b + 1) / (q + count(*) OVER (PARTITION BY stream)) AS p2 FROM dc), ds AS (SELECT stream, abs(sum((p1 - p2) * ln(p1 / p2))) AS psi FROM dp GROUP BY 1),
dk AS (SELECT stream, decay_rate, CASE WHEN w < 2 THEN 0 ELSE coalesce(psi, 0) END AS psi, CASE WHEN decay_rate < 0 THEN ln(2) / abs(decay_rate) END AS half_life FROM dg LEFT JOIN ds USING (stream)), decay AS (SELECT *, decay_rate >= -0.001 AND psi < 0.25 AS decay_passed FROM dk)"""


@CAT.add("M29_decay", f"WITH {I_SQL} {DECAY_SQL} SELECT stream, round(decay_rate, 9) AS decay_rate, round(psi, 6) AS psi, round(half_life, 3) AS half_life, decay_passed FROM decay")
def m29(spark, sf_dir):
    x = d.decay(rows(spark, sf_dir), ["stream"], 50)
    return x.withColumns({"decay_rate": F.round("decay_rate", 9) + 0.0, "psi": F.round("psi", 6) + 0.0, "half_life": F.round("half_life", 3)})


REGIME_SQL = f""", rg AS (SELECT stream, regime, {sharpe_sql('r')} AS s, count(r) AS c FROM e GROUP BY 1, 2), rs AS (SELECT stream, coalesce(avg(s) FILTER (WHERE regime IN (0, 2) AND c >= 20), 0) AS target_sharpe, coalesce(avg(s) FILTER (WHERE regime = 1 AND c >= 20), 0) AS other_sharpe FROM rg GROUP BY 1),
rt AS (SELECT *, target_sharpe - other_sharpe AS selectivity, target_sharpe >= 0.3 AND target_sharpe - other_sharpe >= 0.2 AS regime_passed FROM rs)"""


@CAT.add("M30_regime_selectivity", f"WITH {ROWS_SQL} {REGIME_SQL} SELECT stream, round(target_sharpe, 6) AS target_sharpe, round(other_sharpe, 6) AS other_sharpe, round(selectivity, 6) AS selectivity, regime_passed FROM rt")
def m30(spark, sf_dir):
    return rounded(d.regime_selectivity(rows(spark, sf_dir), ["stream"], [0, 2]))


@CAT.add("M31_edge_score", f"""WITH {I_SQL} {OOS_SQL} {WF_SQL} {DECAY_SQL} {REGIME_SQL}, t AS (SELECT stream, 0.3::DOUBLE * CASE WHEN oos_passed THEN least(greatest(oos_confidence, 0), 1) ELSE 0 END
+ 0.25::DOUBLE * CASE WHEN wf_passed THEN (positive_fraction + CASE WHEN sharpe_trend >= 0 THEN 1 ELSE greatest(0, 1 + sharpe_trend) END + CASE WHEN consistency < 1 THEN 1 ELSE 1 / (1 + consistency) END) / 3 ELSE 0 END
+ 0.2::DOUBLE * coalesce(decay_passed, true)::INT + 0.15::DOUBLE * CASE WHEN regime_passed THEN (least(1, selectivity) + least(1, target_sharpe)) / 2 ELSE 0 END + 0.1::DOUBLE * least(1, (is_trades + oos_trades) / 100) AS score
FROM oos LEFT JOIN wf USING (stream) LEFT JOIN decay USING (stream) LEFT JOIN rt USING (stream)) SELECT stream, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'VALIDATED' WHEN score >= 0.4 THEN 'MARGINAL' ELSE 'REJECTED' END AS recommendation FROM t""")
def m31(spark, sf_dir):
    return rounded(d.edge_score(rows(spark, sf_dir), ["stream"], [0, 2], 100, 20, 50))


@CAT.add("M24_M26_four_tests")
def m24(spark, sf_dir):
    """Random splits come from a generator that other engines lack; tests hold their sizes and p against plain shuffles."""
    from ..operators.stats import welch

    x = rows(spark, sf_dir).filter("h10 is not null").withColumn("hit", F.col("f_imbalance") > 0.3)
    one = welch(x, ["stream"], "h10", "hit").select("stream", F.col("p").alias("t_p"))
    one = one.join(chance.permutation_p(x, ["stream"], "h10", "hit"), "stream")
    one = one.join(x.groupBy("stream").agg(d.sharpe(F.when(F.col("hit"), F.col("h10"))).alias("sharpe")), "stream")
    one = one.join(d.regimes_hold(x, ["stream"], "regime", "h10", "hit"), "stream")
    score, verdict = d.four_tests(F.col("t_p"), F.col("p"), F.col("sharpe"), F.col("regimes_hold"), tests=5)
    return one.withColumns({"score": score, "recommendation": verdict})


@CAT.add("M26_regimes_hold", f"""WITH {ROWS_SQL}, g AS (SELECT stream, regime, CASE WHEN min(h10) = max(h10) THEN 0 ELSE avg(h10) / stddev_pop(h10) * sqrt(7200000) END AS s FROM e WHERE f_imbalance > 0.3 AND h10 IS NOT NULL GROUP BY 1, 2)
SELECT x.stream, coalesce(bool_and(s >= 0.5), true) AS regimes_hold FROM (SELECT DISTINCT stream FROM e) x LEFT JOIN g USING (stream) GROUP BY 1""")
def m26_regimes(spark, sf_dir):
    x = rows(spark, sf_dir).withColumn("hit", F.coalesce(F.col("f_imbalance") > 0.3, F.lit(False)))
    return d.regimes_hold(x, ["stream"], "regime", "h10", "hit")


@CAT.add("M33_running_stats", f"""WITH {ROWS_SQL}, x AS (SELECT *, count(r) OVER w AS trades, count(*) FILTER (WHERE r > 0) OVER w AS wins, avg(r) OVER w AS a, count(*) FILTER (WHERE NOT r < 0) OVER w AS g FROM e WHERE r IS NOT NULL WINDOW w AS (PARTITION BY stream ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, count(*) FILTER (WHERE r < 0) OVER (PARTITION BY stream, g ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING) AS losses_in_row, max((trades > 50 AND a < -0.001)::INT) OVER (PARTITION BY stream ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING) = 1 AS retired FROM x)
SELECT seq, trades, wins, round(a, 6) AS avg_return, losses_in_row, round(0.5 * least(2 * wins / trades, 1) + 0.15 + 0.2 * least(1, trades / 100), 6) AS health, retired FROM y""")
def m33(spark, sf_dir):
    x = d.running_stats(rows(spark, sf_dir).filter("r is not null"), ["stream"], "r")
    return rounded(x.select("seq", "trades", "wins", "avg_return", "losses_in_row", "health", "retired"))


@CAT.add("M32_live_confidence", f"""WITH RECURSIVE {ROWS_SQL}, x AS (SELECT stream, seq, r, row_number() OVER o AS k, sum((r > 0)::INT) OVER o AS wins, sum((NOT r < 0)::INT) OVER o AS g FROM e WHERE r IS NOT NULL WINDOW o AS (PARTITION BY stream ORDER BY ts_event, seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT stream, 0::BIGINT AS k, 0.7::DOUBLE AS c FROM x GROUP BY 1 UNION ALL SELECT x.stream, x.k, CASE WHEN x.k >= 30 THEN c * (1 - 0.05::DOUBLE) + (r > 0)::INT * 0.05::DOUBLE ELSE c END FROM c JOIN x ON x.stream = c.stream AND x.k = c.k + 1),
y AS (SELECT x.*, c, count(*) FILTER (WHERE r < 0) OVER (PARTITION BY x.stream, g ORDER BY x.k ROWS UNBOUNDED PRECEDING) AS losses FROM x JOIN c USING (stream, k))
SELECT seq, k AS trades, wins::BIGINT AS wins, losses AS losses_in_row, round(c, 6) AS confidence, concat_ws(',', CASE WHEN 0.7 - c > 0.15::DOUBLE THEN 'CONFIDENCE_DROP' END, CASE WHEN losses >= 10 THEN 'CONSECUTIVE_LOSSES' END, CASE WHEN k >= 30 AND 0.55::DOUBLE - wins / k > 0.1::DOUBLE THEN 'WINRATE_DROP' END) AS alerts FROM y""")
def m32(spark, sf_dir):
    x = d.live_confidence(rows(spark, sf_dir).filter("r is not null"), ["stream"], "r", 0.7, 0.7, 0.55)
    return rounded(x.select("seq", "trades", "wins", "losses_in_row", "confidence", F.array_join("alerts", ",").alias("alerts")))


MODEL_SQL = "0.6::DOUBLE * {} + 0.4::DOUBLE * {} > 0"


@CAT.add("M12_permutation_importance", f"""WITH {ROWS_SQL}, b AS (SELECT seq, f_imbalance AS f0, f_place AS f1, h10 > 0 AS y FROM v WHERE h10 IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || seq), 1, 8))::BIGINT, seq) AS i FROM b),
p AS (SELECT j, r, 43 + r * 1000 + j AS s FROM (SELECT unnest([0, 1]) AS j), (SELECT unnest(range(5)) AS r)), o AS (SELECT j, r, row_number() OVER (PARTITION BY j, r ORDER BY ('0x' || substr(md5(s || ':' || seq), 1, 8))::BIGINT, seq) AS i, CASE WHEN j = 0 THEN f0 ELSE f1 END AS other FROM n, p),
z AS (SELECT avg((({MODEL_SQL.format("f0", "f1")}) = y)::INT) AS base FROM b), a AS (SELECT j, r, avg((({MODEL_SQL.format("CASE WHEN j = 0 THEN other ELSE f0 END", "CASE WHEN j = 1 THEN other ELSE f1 END")}) = y)::INT) AS acc FROM n JOIN o USING (i) GROUP BY 1, 2),
g AS (SELECT CASE WHEN j = 0 THEN 'f_imbalance' ELSE 'f_place' END AS feature, base, avg(base - acc) AS m, stddev_pop(base - acc) AS sd FROM a, z GROUP BY 1, 2)
SELECT feature, round(base, 6) AS baseline, round(m, 6) AS mean_decrease, round(sd, 6) AS std_decrease, m > sd AS is_important, (row_number() OVER (ORDER BY m DESC, feature))::INT AS rank, round(m / greatest(max(m) OVER (), 0.001), 6) AS normalised, m <= 0.005 AS unimportant FROM g""")
def m12(spark, sf_dir):
    """A fixed linear rule's accuracy at the sign of the next move, as each of its features is permuted."""
    x = rows(spark, sf_dir).filter("h10 is not null").withColumn("up", F.col("h10") > 0)
    model = lambda c: F.lit(0.6) * c["f_imbalance"] + F.lit(0.4) * c["f_place"] > 0
    return rounded(chance.permutation_importance(x, FEATURES, model, "up"))


@CAT.add("M17_three_classes")
def m17(spark, sf_dir):
    """The next move's sign from two features; a fit by Newton's method is beyond SQL, and a test holds it against plain descent."""
    from ..operators import classifier

    x = rows(spark, sf_dir).filter("h10 is not null").withColumn("move", F.signum(F.round("h10", 2)).cast("int"))
    model = classifier.fit(x, FEATURES, "move", weights=classifier.class_weights(x, "move"))
    p = model.probabilities()
    return rounded(x.select("seq", "move", model.label().alias("predicted"), p[1].alias("p_up"), p[-1].alias("p_down")))


REPORT = ({"feature": "f_imbalance", "alpha_score": 0.83, "label_correlation": 0.19}, {"feature": "f_place", "alpha_score": 0.61, "label_correlation": -0.13}, {"feature": "f_beat", "alpha_score": 0.47, "label_correlation": 0.07})
DECISION_SQL = f"""{ROWS_SQL}, t AS (SELECT seq, regime, unnest([struct_pack(v := f_imbalance, b := 0.01 / 0.19, w := 0.83, up := 1), struct_pack(v := f_place, b := 0.01 / 0.13, w := 0.61, up := -1), struct_pack(v := (seq % 7 - 3) / 3, b := 0.1, w := 0.47, up := 1)]) AS u FROM v),
s AS (SELECT seq, sign(u.v) * u.up AS d, least(1, abs(u.v) / (u.b * (1 + regime / 2)) / 10) * u.w AS s, u.w AS w FROM t WHERE abs(u.v) > u.b * (1 + regime / 2)),
c AS (SELECT seq, sum(d * s) / sum(s) AS consensus, count(*) FILTER (WHERE s >= 0.3) AS n, count(*) FILTER (WHERE s >= 0.3 AND d > 0) AS l, sum(s) FILTER (WHERE s >= 0.3 AND d > 0) AS ls, sum(s) FILTER (WHERE s >= 0.3 AND d < 0) AS ss,
sum(w * s * d) FILTER (WHERE s >= 0.3) / sum(w) FILTER (WHERE s >= 0.3) AS net FROM s GROUP BY 1),
m AS (SELECT v.seq, coalesce(consensus, 0) AS consensus, coalesce(n, 0) AS n, l, n - l AS h, ls, ss, net FROM v LEFT JOIN c ON v.seq = c.seq)"""


@CAT.add("M35_decisions", f"""WITH {DECISION_SQL.replace("0.01 / 0.19", "0.01::DOUBLE / 0.19::DOUBLE").replace("0.01 / 0.13", "0.01::DOUBLE / 0.13::DOUBLE").replace("b := 0.1,", "b := 0.1::DOUBLE,").replace("w := 0.83", "w := 0.83::DOUBLE").replace("w := 0.61", "w := 0.61::DOUBLE").replace("w := 0.47", "w := 0.47::DOUBLE").replace("/ 3, b", "/ 3.0::DOUBLE, b")}
SELECT seq, round(consensus, 6) AS consensus, CASE WHEN n = 0 THEN 'HOLD' WHEN l > h AND l >= 2 THEN 'LONG' WHEN h > l AND h >= 2 THEN 'SHORT' ELSE 'HOLD' END AS by_majority,
CASE WHEN n >= 2 AND l = n THEN 'LONG' WHEN n >= 2 AND h = n THEN 'SHORT' ELSE 'HOLD' END AS by_unanimity, CASE WHEN n = 0 OR abs(net) < 0.5::DOUBLE THEN 'HOLD' WHEN net > 0 THEN 'LONG' ELSE 'SHORT' END AS by_weight,
round(CASE WHEN l > h AND l >= 2 THEN ls / n WHEN h > l AND h >= 2 THEN ss / n ELSE 0 END, 6) AS majority_confidence, round(coalesce(abs(net), 0), 6) AS weight_confidence FROM m""")
def m35(spark, sf_dir):
    """Three features' signals, their thresholds by regime, combined in each of the three ways."""
    x = rows(spark, sf_dir).withColumn("f_beat", (F.col("seq") % 7 - 3) / F.lit(3.0))
    x = decisions.with_signals(x, decisions.rules_of(REPORT, base=0.01, least=0.05, most=0.1), 1 + F.col("regime") / 2).select("seq", "signals", "consensus")
    for mode, name in (("majority", "by_majority"), ("unanimous", "by_unanimity"), ("weighted", "by_weight")):
        x = decisions.combine(x, mode).withColumnsRenamed({"action": name, "confidence": f"{mode}_confidence"}).drop("reason")
    return rounded(x.select("seq", "consensus", "by_majority", "by_unanimity", "by_weight", "majority_confidence", F.col("weighted_confidence").alias("weight_confidence")))


SIGNALS_SQL = f"""{QUOTES_SQL}, s AS (SELECT stream, ts_event, seq, (symbol % 21) / 20.0::DOUBLE AS score, seq % 3 - 1 AS tr, CASE WHEN seq % 5 > 0 THEN seq % 4 END AS sp, (ask_price - bid_price) / mid > 0.0025::DOUBLE AS wide FROM quotes),
f AS (SELECT *, CASE WHEN tr < -0.5 THEN 'regime_trend' WHEN coalesce(sp, 1) > 2 THEN 'regime_spread' WHEN score < 0.6::DOUBLE THEN 'signal_strength' END AS stop FROM s), a AS (SELECT * FROM f WHERE stop IS NULL AND NOT wide),
k AS (SELECT stream, min(ts_event) AS t FROM a GROUP BY 1 UNION ALL SELECT k.stream, (SELECT min(a.ts_event) FROM a WHERE a.stream = k.stream AND a.ts_event >= k.t + 3600000) FROM k WHERE k.t IS NOT NULL),
m AS (SELECT a.stream, a.ts_event, min(seq) AS seq, true AS kept FROM a JOIN k ON k.stream = a.stream AND k.t = a.ts_event GROUP BY 1, 2),
l AS (SELECT f.*, coalesce(kept, false) AS allow, max(CASE WHEN kept THEN f.ts_event END) OVER (PARTITION BY f.stream ORDER BY f.ts_event, f.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM f LEFT JOIN m ON m.stream = f.stream AND m.seq = f.seq)"""


@CAT.add("M36_signal_gate", f"""WITH RECURSIVE {SIGNALS_SQL}
SELECT seq, allow, coalesce(stop, CASE WHEN ts_event - t < 3600000 THEN 'cooldown' END, CASE WHEN wide THEN 'spread_penalty' END, 'all_gates_passed') AS reason FROM l""")
def m36(spark, sf_dir):
    q = quotes(spark, sf_dir).select("stream", "ts_event", "seq", "mid", (F.col("ask_price") - F.col("bid_price")).alias("spread"), ((F.col("symbol") % 21) / F.lit(20.0)).alias("score"), (F.col("seq") % 3 - 1).alias("regime_trend"),
                                     (F.col("seq") % 3).alias("regime_volatility"), F.when(F.col("seq") % 5 > 0, F.col("seq") % 4).alias("regime_spread"))
    rules = {**spacing.GATE, "cooldown_ms": 3_600_000, "relative_spread_max": 0.0025}
    return spacing.gate(q, ["stream"], rules).select("seq", "allow", "reason")


@CAT.add("M16_outcome_importance", f"""WITH {ROWS_SQL}, g AS (SELECT stream, count(*) AS n, corr(f_place, r) AS c, avg(f_place) FILTER (WHERE r > 0) AS mw, avg(f_place) FILTER (WHERE NOT r > 0) AS ml, var_pop(f_place) FILTER (WHERE r > 0) AS vw, var_pop(f_place) FILTER (WHERE NOT r > 0) AS vl FROM e WHERE r IS NOT NULL GROUP BY 1),
t AS (SELECT *, abs(c * sqrt((n - 2) / (1 - c * c))) AS t, least(1, abs(mw - ml) / sqrt((vw + vl) / 2) / 0.8) AS shift FROM g), p AS (SELECT *, CASE WHEN t > 2.6 THEN 0.01::DOUBLE WHEN t > 2 THEN 0.05 WHEN t > 1.5 THEN 0.15 ELSE 0.5 END AS p FROM t)
SELECT stream, n, round(c, 6) AS correlation, p, round(shift, 6) AS shift, round(least(1, 0.5 * abs(c) + 0.3 * (1 - p) + 0.2 * shift), 6) AS importance FROM p""")
def m16(spark, sf_dir):
    return rounded(d.outcome_importance(rows(spark, sf_dir).filter("r is not null"), ["stream"], "f_place", "r"))


@CAT.add("M16_quartile_win_rates", f"""WITH {ROWS_SQL}, i AS (SELECT stream, r, row_number() OVER (PARTITION BY stream ORDER BY f_place, ts_event, seq) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM e WHERE r IS NOT NULL)
SELECT stream, least(3, i // (n // 4)) AS quartile, count(*) AS n, round(avg((r > 0)::INT), 6) AS win_rate FROM i WHERE n >= 4 GROUP BY 1, 2""")
def m16b(spark, sf_dir):
    return rounded(d.quartile_win_rates(rows(spark, sf_dir).filter("r is not null"), ["stream"], "f_place", "r"))


@CAT.add("M9_split_drift", """WITH s AS (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'valid' ELSE 'test' END AS split, o_orderstatus FROM orders), c AS (SELECT split, o_orderstatus, count(*) AS n FROM s GROUP BY 1, 2),
g AS (SELECT a.split, b.o_orderstatus, coalesce(n, 0) AS n FROM (SELECT DISTINCT split FROM c) a CROSS JOIN (SELECT DISTINCT o_orderstatus FROM c) b LEFT JOIN c ON c.split = a.split AND c.o_orderstatus = b.o_orderstatus), p AS (SELECT *, n / sum(n) OVER (PARTITION BY split) AS p FROM g)
SELECT x.split AS a, y.split AS b, x.o_orderstatus, round(abs(x.p - y.p), 6) AS difference, abs(x.p - y.p) > 0.05 AS drift FROM p x JOIN p y ON x.o_orderstatus = y.o_orderstatus AND x.split < y.split""")
def m9(spark, sf_dir):
    k = F.col("o_orderkey") % 10
    x = table(spark, sf_dir, "orders").withColumn("split", F.when(k < 7, "train").when(k < 9, "valid").otherwise("test"))
    return rounded(d.split_drift(x, "split", "o_orderstatus"))


@CAT.add("M11_M13_window_stability", f"""WITH {TICKS_SQL}, b AS (SELECT stream, min(ts_event) AS t0, max(ts_event) AS t1 FROM ticks GROUP BY 1), x AS (SELECT stream, price, (ts_event - t0) // 604800000 AS win FROM ticks JOIN b USING (stream) WHERE t0 + (ts_event - t0) // 604800000 * 604800000 < t1),
r AS (SELECT stream, min(price) AS lo, max(price) AS hi FROM x WHERE win = 0 GROUP BY 1), c AS (SELECT stream, win, least(greatest(floor((price - lo) / (hi - lo) * 10), 0), 9)::BIGINT AS bin, count(*) AS n FROM x JOIN r USING (stream) GROUP BY 1, 2, 3),
g AS (SELECT w.stream, w.win, k.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT stream, win FROM c) w CROSS JOIN range(10) k(bin) LEFT JOIN c ON c.stream = w.stream AND c.win = w.win AND c.bin = k.bin), p AS (SELECT *, greatest(n / sum(n) OVER (PARTITION BY stream, win), 1e-4) AS p FROM g),
s AS (SELECT p.stream, p.win, sum((p.p - b.p) * ln(p.p / b.p)) AS psi FROM p JOIN p b ON p.stream = b.stream AND p.bin = b.bin AND b.win = 0 WHERE p.win > 0 GROUP BY 1, 2)
SELECT stream, round(max(psi), 6) AS max_psi, round(avg(psi), 6) AS avg_psi, round(0.4 * 0.5 + 0.3 * 0.2 + 0.3 * (1 - least(max(psi) / 0.5, 1)), 6) AS alpha_score FROM s GROUP BY 1""")
def m11(spark, sf_dir):
    x = d.window_psi(ticks(spark, sf_dir), ["stream"], "price", 604_800_000)
    x = x.groupBy("stream").agg(F.max("psi").alias("max_psi"), F.avg("psi").alias("avg_psi"))
    return rounded(x.withColumn("alpha_score", d.alpha_score(F.lit(0.5), F.lit(0.2), F.col("max_psi"))))


CELL_SQL = f"{TICKS_SQL}, c AS (SELECT stream, week, count(*) AS n, avg(price - 20) AS m, avg(price - 20) / nullif(stddev_samp(price - 20) / sqrt(count(*)), 0) AS t FROM ticks GROUP BY 1, 2)"


@CAT.add("R5_R6_cell_verdicts", f"""WITH {CELL_SQL} SELECT stream, week, CASE WHEN n < 20 THEN 'INSUFFICIENT_SUPPORT' WHEN abs(coalesce(t, 0)) >= 3 AND m > 0 THEN 'DIRECTIONAL' WHEN abs(coalesce(t, 0)) >= 3 AND m < 0 THEN 'ANTI_EDGE' ELSE 'NO_EDGE' END AS verdict,
CASE WHEN n >= 20 AND coalesce(lead(n) OVER o, 0) >= 20 THEN 'GG' WHEN n < 20 AND coalesce(lead(n) OVER o, 0) < 20 THEN 'DD' ELSE 'GD' END AS tag FROM c WINDOW o AS (PARTITION BY stream ORDER BY week)""")
def r5(spark, sf_dir):
    """A cell's verdict, and its week's and the next one's quality together."""
    from ..operators.stats import t_stat

    v = F.col("price") - 20
    x = ticks(spark, sf_dir).groupBy("stream", "week").agg(F.count("*").alias("n"), F.avg(v).alias("m"), t_stat(v).alias("t"))
    after = F.coalesce(F.lead("n").over(Window.partitionBy("stream").orderBy("week")), F.lit(0))
    strong = F.abs("t") >= 3
    verdict = first_of((F.col("n") < 20, "INSUFFICIENT_SUPPORT"), (strong & (F.col("m") > 0), "DIRECTIONAL"), (strong & (F.col("m") < 0), "ANTI_EDGE"), default="NO_EDGE")
    return x.select("stream", "week", verdict.alias("verdict"), first_of(((F.col("n") >= 20) & (after >= 20), "GG"), ((F.col("n") < 20) & (after < 20), "DD"), default="GD").alias("tag"))


@CAT.add("R13_X16_model_compare", f"""WITH {TICKS_SQL}, m AS (SELECT symbol, avg((price > 20)::INT) FILTER (WHERE seq % 2 = 0) * 0.6 + avg((qty > 50)::INT) FILTER (WHERE seq % 2 = 0) * 0.4 AS a, avg((price > 20)::INT) FILTER (WHERE seq % 2 = 1) * 0.6 + avg((qty > 50)::INT) FILTER (WHERE seq % 2 = 1) * 0.4 AS b FROM ticks GROUP BY 1)
SELECT symbol, round(a, 6) AS score_a, round(b, 6) AS score_b, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a > b THEN 'model_a' WHEN b > a THEN 'model_b' ELSE 'tie' END AS winner, CASE WHEN abs(a - b) > 0.1 THEN 'high' WHEN abs(a - b) > 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM m""")
def r13(spark, sf_dir):
    """Two models' weighted scores side by side."""
    score = lambda k: F.avg(F.when(F.col("seq") % 2 == k, (F.col("price") > 20).cast("int"))) * 0.6 + F.avg(F.when(F.col("seq") % 2 == k, (F.col("qty") > 50).cast("int"))) * 0.4
    x = ticks(spark, sf_dir).groupBy("symbol").agg(score(0).alias("score_a"), score(1).alias("score_b"))
    a, b, gap = F.col("score_a"), F.col("score_b"), F.abs(F.col("score_a") - F.col("score_b"))
    winner = first_of((a.isNull() | b.isNull(), "unknown"), (a > b, "model_a"), (b > a, "model_b"), default="tie")
    return rounded(x.withColumns({"winner": winner, "confidence": first_of((gap > 0.1, "high"), (gap > 0.05, "medium"), default="low")}))


@CAT.add("O15_O16_R16_ranked_pools", """WITH f AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, median(c_acctbal) AS m FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY m DESC, n DESC, c_nationkey) AS selection_rank FROM f)
SELECT c_mktsegment, c_nationkey, n, round(m, 6) AS median_balance, selection_rank::INT AS selection_rank FROM r WHERE selection_rank <= 3""")
def o15(spark, sf_dir):
    """Each lane's best three families; the rank filter is pushed below the shuffle."""
    x = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.median("c_acctbal").alias("median_balance"))
    return rounded(ranked(x, ["c_mktsegment"], [F.desc("median_balance"), F.desc("n"), F.col("c_nationkey")], "selection_rank").filter("selection_rank <= 3"))


def clustered(spark, sf_dir):
    """Quotes with a forward return, and the clusters of their price, width and size."""
    q = quotes(spark, sf_dir)
    o = Window.partitionBy("stream", "week").orderBy("ts_event", "seq")
    q = q.select("seq", F.log("mid").alias("level"), ((F.col("ask_price") - F.col("bid_price")) / F.col("mid") * 10000).alias("width"), F.col("bid_qty").alias("size"), F.log(F.lead("mid").over(o) / F.col("mid")).alias("next_return"))
    return q, cl.fit(q, ["level", "width", "size"])


@CAT.add("M18_W28_cluster_regime")
def m18(spark, sf_dir):
    q, clusters = clustered(spark, sf_dir)
    return rounded(cl.predict(q, clusters).select("seq", "cluster", "distance", "confidence", "cluster_regime"))


@CAT.add("M21_cluster_scan")
def m21(spark, sf_dir):
    q, clusters = clustered(spark, sf_dir)
    return rounded(cl.cluster_scan(q.filter("next_return is not null"), clusters, "next_return"))


QUERIES, ORACLES = CAT.queries, CAT.oracles
