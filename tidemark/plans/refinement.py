"""Queries over hand-written edges, refinement proposals and families' roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, edges, refinement, registry
from ..sources.events import WEEK_MS, quotes, table
from .features import TABLE_SQL
from .registry import Catalogue, rounded

CAT = Catalogue()
VALUES = ("l_quantity", "l_discount", "l_tax")
CONDITIONS = (("1995", "l_quantity"), ("1995", "l_tax"), ("1996", "l_discount"))


@CAT.add("M34_proposals", f"""WITH x AS (SELECT strftime(l_shipdate, '%Y') AS edge, unnest([struct_pack(f := 'l_quantity', v := l_quantity::DOUBLE), struct_pack(f := 'l_discount', v := l_discount::DOUBLE), struct_pack(f := 'l_tax', v := l_tax::DOUBLE)]) AS u, l_quantity * 1000 + l_extendedprice / 4 - 38000 AS pnl FROM lineitem),
g AS (SELECT edge, u.f AS feature, count(*) AS n, corr(u.v, pnl) AS r, avg(u.v) FILTER (WHERE pnl > 0) - avg(u.v) FILTER (WHERE NOT pnl > 0) AS d, (var_pop(u.v) FILTER (WHERE pnl > 0) + var_pop(u.v) FILTER (WHERE NOT pnl > 0)) / 2 AS v FROM x GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN n < 3 THEN 1.0::DOUBLE WHEN t > 2.6 THEN 0.01 WHEN t > 2.0 THEN 0.05 WHEN t > 1.5 THEN 0.15 ELSE 0.5 END AS p FROM (SELECT *, abs(r * sqrt((n - 2) / (1 - r * r))) AS t FROM g)),
i AS (SELECT edge, feature, r, least(1, 0.5 * abs(r) + 0.3 * (1 - p) + 0.2 * coalesce(least(1, abs(d) / sqrt(v) / 0.8), 0)) AS imp, edge <> '1998' AS known, (edge, feature) IN ({", ".join(map(str, CONDITIONS))}) AS used FROM p),
f AS (SELECT feature, count(*) FILTER (WHERE imp < 0.25) AS low, avg(imp) FILTER (WHERE imp < 0.25) AS m, count(*) FILTER (WHERE known) AS n, avg(abs(r)) FILTER (WHERE known) AS c, count(*) FILTER (WHERE known AND used) AS u FROM i GROUP BY 1)
SELECT 'WEIGHT_ADJUST' AS kind, edge, feature, CASE WHEN used THEN 'REFINE_THRESHOLD' ELSE 'ADD_CONDITION' END AS action, CASE WHEN used THEN 'MEDIUM' ELSE 'HIGH' END AS priority, round(imp, 6) AS value, 1::BIGINT AS edges, used::BIGINT AS used FROM i WHERE known AND imp >= 0.6
UNION ALL SELECT 'PRUNE_CANDIDATE', NULL, feature, 'REMOVE', CASE WHEN low >= 5 THEN 'HIGH' ELSE 'MEDIUM' END, round(m, 6), low, NULL FROM f WHERE low >= 3
UNION ALL SELECT 'NEW_FEATURE_SIGNAL', NULL, feature, 'ADD_TO_SCAN', CASE WHEN c > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END, round(c, 6), n, u FROM f WHERE c >= 0.5 AND u < n * 0.3""")
def m34(spark, sf_dir):
    """Years of shipping as edges, all but one of them registered: what lines' columns say about a result."""
    x = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("edge"), (F.col("l_quantity") * 1000 + F.col("l_extendedprice") / 4 - 38000).alias("pnl"), *[F.col(v).cast("double") for v in VALUES])
    x = x.unpivot(["edge", "pnl"], list(VALUES), "feature", "value")
    importance = discovery.outcome_importance(x, ["edge", "feature"], "value", "pnl")
    conditions = spark.createDataFrame(CONDITIONS, "edge string, feature string")
    known = x.select("edge").distinct().filter("edge <> '1998'")
    return rounded(refinement.proposals(importance, conditions, known, low=0.25))


FAMILIES = [r[0] for r in refinement.ROLES] + ["latency_leadlag_v1"]
ROLE_SQL = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in refinement.ROLES)


@CAT.add("A48_family_roles", f"""WITH r(family, role, translation, binding, paper) AS (VALUES {ROLE_SQL}), p AS (SELECT {FAMILIES}[p_partkey % 9 + 1] AS family, * FROM part),
c AS (SELECT family, count(*) AS reports, count(DISTINCT p_brand) AS packs, count(*) FILTER (WHERE p_size < 20) AS translated, count(*) FILTER (WHERE p_type LIKE 'S%') AS bound FROM p GROUP BY 1)
SELECT family, coalesce(role, 'UNKNOWN') AS role, coalesce(translation, 'UNKNOWN') AS translation, coalesce(binding, 'UNKNOWN') AS binding, coalesce(paper, 'UNKNOWN') AS paper, coalesce(reports, 0) AS reports, coalesce(packs, 0) AS packs, coalesce(translated, 0) AS translated,
coalesce(bound, 0) AS bound, coalesce(translated, 0) > 0 AS translatable_now, coalesce(bound, 0) > 0 AS bindable_now, CASE WHEN role = 'CONTEXT_GUARD' THEN 'SUPPORT_ONLY' ELSE 'NOT_READY' END AS use_now FROM r FULL JOIN c USING (family)""")
def a48(spark, sf_dir):
    """Parts as reports, specs and bindings of nine families, one of which no role names."""
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("p_partkey") % 9 + 1).cast("int")).alias("family")
    p = table(spark, sf_dir, "part")
    specs = p.select(family, F.when(F.col("p_size") < 20, "TRANSLATABLE").otherwise("BLOCKED").alias("status"))
    bindings = p.select(family, F.when(F.col("p_type").startswith("S"), "BOUND_SHADOW_RUNNABLE").otherwise("UNBOUND").alias("status"))
    return refinement.family_roles(p.select(family, F.col("p_brand").alias("pack")), specs, bindings)


UNIT = 3_600_000
NEEDED = ("mid_price", "volatility_ratio", "regime_volatility", "return_momentum", "liquidity_pressure", "micro_reversion", "regime_trend", "volatility_compression_score", "spread_compression", "quote_intensity")
EXITS_SQL = """CASE WHEN return_momentum > 0.2 THEN 'reversion_complete' WHEN regime_volatility = 2 OR volatility_ratio > 2 THEN 'volatility_spike' END AS x1,
CASE WHEN abs(return_momentum) < 0.2 THEN 'momentum_weakened' WHEN (return_momentum > 0 AND liquidity_pressure < -0.3) OR (return_momentum < 0 AND liquidity_pressure > 0.3) THEN 'pressure_reversal' WHEN regime_trend = 0 THEN 'regime_change' END AS x2,
CASE WHEN volatility_ratio > 1.5 THEN 'volatility_expanded' WHEN volatility_compression_score < 0.4 THEN 'compression_failed' END AS x3"""
ENTRIES_SQL = """SELECT *, 'mean_rev_low_vol_v1' AS edge, 'LONG' AS direction, micro_reversion AS confidence, 10 AS h FROM f WHERE regime_trend = 0 AND (regime_volatility = 0 OR volatility_ratio < 0.5) AND micro_reversion > 0.6 AND return_momentum < -0.3
UNION ALL SELECT *, 'momentum_continuation_v1', CASE WHEN return_momentum > 0 THEN 'LONG' ELSE 'SHORT' END, abs(return_momentum), 15 FROM f WHERE regime_trend <> 0 AND abs(return_momentum) > 0.5 AND ((return_momentum > 0 AND liquidity_pressure > 0.3) OR (return_momentum < 0 AND liquidity_pressure < -0.3)) AND micro_reversion < 0.4
UNION ALL SELECT *, 'vol_breakout_compression_v1', CASE WHEN return_momentum < -0.1 THEN 'SHORT' ELSE 'LONG' END, volatility_compression_score, 20 FROM f WHERE volatility_compression_score > 0.7 AND spread_compression > 0.3 AND quote_intensity > 0.7 AND volatility_ratio < 1"""


@CAT.add("F14_edge_trades", f"""{TABLE_SQL}, f AS (SELECT stream, seq, ts_event, ts_event // {WEEK_MS} AS week, {", ".join(NEEDED)}, {EXITS_SQL} FROM t WHERE {" AND ".join(f"{n} IS NOT NULL" for n in NEEDED)}), e AS ({ENTRIES_SQL}),
y AS (SELECT e.stream, e.week, e.seq, e.edge, e.direction, e.confidence, e.ts_event AS entry_ts, e.mid_price AS p, b.ts_event AS exit_ts, b.seq AS exit_seq, b.mid_price AS q, b.late,
CASE WHEN b.late THEN 'time_horizon_exceeded' ELSE b.why END AS reason FROM e LEFT JOIN LATERAL (SELECT *, f.ts_event - e.ts_event > e.h * {UNIT} AS late, CASE e.h WHEN 10 THEN x1 WHEN 15 THEN x2 ELSE x3 END AS why FROM f WHERE f.stream = e.stream AND f.week = e.week AND (f.ts_event, f.seq) > (e.ts_event, e.seq)
AND (f.ts_event - e.ts_event > e.h * {UNIT} OR CASE e.h WHEN 10 THEN x1 WHEN 15 THEN x2 ELSE x3 END IS NOT NULL) ORDER BY f.ts_event, f.seq LIMIT 1) b ON true)
SELECT stream, week, seq, edge, direction, round(confidence, 6) AS confidence, entry_ts, exit_ts, exit_seq, reason, round((q - p) / p * CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END, 6) AS back FROM y""")
def f14(spark, sf_dir):
    """The three edges over a stream's features; trades end with their week at the latest. Horizons are in hours, as ticks are sparse."""
    x = registry.feature_table(quotes(spark, sf_dir), ["stream"], NEEDED).withColumn("week", F.floor(F.col("ts_event") / WEEK_MS))
    return rounded(edges.edge_trades(x, ["stream", "week"], edges.manual_edges(), "mid_price", "regime_trend", UNIT))


QUERIES, ORACLES = CAT.queries, CAT.oracles
