"""Proposals, roles, hand-written edges, demotion and limits against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import edges, execution, performance, refinement, slices
from tidemark.sources.events import trades_of

FEATURES = "volatility_ratio double, regime_volatility int, return_momentum double, liquidity_pressure double, micro_reversion double, regime_trend int, volatility_compression_score double, spread_compression double, quote_intensity double"


def test_proposals_by_hand(spark):
    rows = [(e, "calm", 0.1, 0.05) for e in "abcde"] + [("a", "loud", 0.9, -0.8), ("b", "loud", 0.61, 0.9), ("x", "loud", 0.99, 0.0), ("c", "loud", 0.6, None), ("d", "dull", None, 0.1), ("x", "calm", 0.0, 0.9)]
    importance = spark.createDataFrame(rows, "edge string, feature string, importance double, correlation double")
    conditions = spark.createDataFrame([("b", "loud"), ("b", "loud"), ("x", "calm")], "edge string, feature string")
    known = spark.createDataFrame([(e,) for e in "abcdea"], "edge string")
    got = {(r["kind"], r["edge"], r["feature"]): r for r in refinement.proposals(importance, conditions, known).collect()}
    assert set(got) == {("WEIGHT_ADJUST", e, "loud") for e in "abc"} | {("PRUNE_CANDIDATE", None, "calm")}  # loud is used by a third of its edges
    assert [got["WEIGHT_ADJUST", e, "loud"]["action"] for e in "abc"] == ["ADD_CONDITION", "REFINE_THRESHOLD", "ADD_CONDITION"]
    prune = got["PRUNE_CANDIDATE", None, "calm"]
    assert (prune["edges"], prune["priority"]) == (6, "HIGH") and prune["value"] == pytest.approx(0.5 / 6)
    got = refinement.proposals(importance, conditions.limit(0), known).filter("kind = 'NEW_FEATURE_SIGNAL'").collect()
    assert [(r["feature"], r["priority"], r["edges"], r["used"]) for r in got] == [("loud", "HIGH", 3, 0)] and got[0]["value"] == pytest.approx(0.85)
    assert refinement.proposals(importance.limit(0), conditions, known).count() == 0


def test_a_family_without_a_role_is_not_lost(spark):
    reports = spark.createDataFrame([("momentum_v1", 1), ("momentum_v1", 1), ("new_one", 2), (None, 3)], "family string, pack int")
    status = spark.createDataFrame([("spread_reversion_v1", "TRANSLATABLE"), ("momentum_v1", "BLOCKED"), (None, "TRANSLATABLE")], "family string, status string")
    got = {r["family"]: r for r in refinement.family_roles(reports, status, status.limit(0)).collect()}
    assert len(got) == 9 and got["new_one"]["role"] == "UNKNOWN" and (got["momentum_v1"]["reports"], got["momentum_v1"]["packs"]) == (2, 1)
    assert got["spread_reversion_v1"]["translatable_now"] and not got["momentum_v1"]["translatable_now"] and got["volume_vol_link_v1"]["use_now"] == "SUPPORT_ONLY"


def plain_trades(rows, horizon):
    """The momentum edge by its words, row by row."""
    out = {}
    for i, r in enumerate(rows):
        m, p, rev, trend = r["return_momentum"], r["liquidity_pressure"], r["micro_reversion"], r["regime_trend"]
        if None in (m, p, rev, trend) or trend not in (-1, 1) or abs(m) <= 0.5 or not (m > 0 and p > 0.3 or m < 0 and p < -0.3) or rev >= 0.4:
            continue
        found = None
        for q in rows[i + 1 :]:
            m2, p2 = q["return_momentum"], q["liquidity_pressure"]
            why = None
            if q["ts_event"] - r["ts_event"] > horizon:
                why = "time_horizon_exceeded"
            elif m2 is not None and abs(m2) < 0.2:
                why = "momentum_weakened"
            elif m2 is not None and p2 is not None and (m2 > 0 and p2 < -0.3 or m2 < 0 and p2 > 0.3):
                why = "pressure_reversal"
            elif q["regime_trend"] == 0:
                why = "regime_change"
            if why:
                found = (q["ts_event"], q["seq"], why)
                break
        out[r["seq"]] = ("LONG" if m > 0 else "SHORT", *(found or (None, None, None)))
    return out


def test_edges_equal_a_loop(spark):
    rng = random.Random(5)
    some = lambda v: None if rng.random() < 0.05 else v
    rows = [
        ("k", 1000 * (i // 3) * rng.choice((1, 1)), i, 100.0 + i % 7, some(rng.uniform(0, 2.5)), some(rng.choice((0, 1, 2))), some(rng.uniform(-1, 1)), some(rng.uniform(-1, 1)), some(rng.uniform(0, 0.8)),
         some(rng.choice((-1, 0, 1, 1, -1))), some(rng.random()), some(rng.random()), some(rng.random()))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, f"stream string, ts_event long, seq long, mid double, {FEATURES}")
    got = edges.edge_trades(df, ["stream"], edges.manual_edges(), "mid", "regime_trend", 1000).collect()
    assert {r["edge"] for r in got} == {e.name for e in edges.manual_edges()}
    want = plain_trades([r.asDict() for r in df.collect()], 15_000)
    assert {r["seq"]: (r["direction"], r["exit_ts"], r["exit_seq"], r["reason"]) for r in got if r["edge"] == "momentum_continuation_v1"} == want and len(want) > 20
    assert {w[3] for w in want.values()} >= {"momentum_weakened", "pressure_reversal", "regime_change"}
    price = {r[2]: r[3] for r in rows}
    for r in got:
        if r["exit_seq"] is not None:
            assert r["back"] == pytest.approx((price[r["exit_seq"]] / price[r["seq"]] - 1) * (1 if r["direction"] == "LONG" else -1))
    assert edges.edge_trades(df.limit(0), ["stream"], edges.manual_edges(), "mid").count() == 0


def test_time_goes_before_conditions(spark):
    rows = [("k", 0, 0, 1.0, 0.9, 0.5, 0.1, 1), ("k", 15_000, 1, 2.0, 0.9, 0.5, 0.1, 1), ("k", 15_001, 2, 4.0, 0.0, 0.5, 0.1, 1)]
    df = spark.createDataFrame(rows, "stream string, ts_event long, seq long, mid double, return_momentum double, liquidity_pressure double, micro_reversion double, regime_trend int")
    got = edges.edge_trades(df, ["stream"], edges.manual_edges()[1:2], "mid", "regime_trend").orderBy("seq").collect()
    assert [(r["seq"], r["exit_seq"], r["reason"], r["back"]) for r in got] == [(0, 2, "time_horizon_exceeded", 3.0), (1, 2, "momentum_weakened", 1.0)]


def test_demotion_by_hand(spark):
    cases = [
        ("CANARY", -0.51, 0.0, 0, 5.0, 1.0, "RETIRED", "sharpe_catastrophic"), ("LIVE", 1.0, 10.1, 9, 5.0, 1.0, "RETIRED", "drawdown"), ("LIVE", 1.0, 10.0, 0, 5.0, 0.2, None, None), ("LIVE", 1.0, 99.0, 6, 0.0, None, "SHADOW", "loss_days"),
        ("PAPER", 0.29, 1.0, 6, None, 0.19, "RETIRED", "edge_decay"), ("CANDIDATE", 0.4, 1.0, 5, None, None, "RETIRED", "sharpe"), ("SHADOW", 0.29, 1.0, 5, None, None, "CANARY", "sharpe"), ("LIVE", 0.0, 1.0, 5, None, None, None, None),
        ("RETIRED", 0.0, 1.0, 50, None, None, None, None), ("PAPER", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, stage string, avg_sharpe double, max_drawdown_pct double, loss_days long, backtest_drawdown double, edge_health double")
    got = performance.demotion(df).orderBy("i").collect()
    assert [(r["to_stage"], r["why"]) for r in got] == [c[6:] for c in cases]
    assert [r["severity"] for r in got] == ["RETIRE" if c[6] == "RETIRED" else "DEMOTE" if c[6] else "WARNING" for c in cases]


def test_only_passed_orders_use_up_limits(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), i // 2, i, rng.choice((None, *map(float, range(1, 40)))), rng.random() < 0.9) for i in range(400)]
    df = spark.createDataFrame(rows, "account int, ts_event long, seq long, cost double, fine boolean").withColumn("_c", F.lit(1))
    got = {r["seq"]: r["gate"] for r in execution.running_limits(df, ["account"], F.col("fine"), F.col("cost"), 7, 90.0).collect()}
    used = {a: [0, 0.0] for a in range(4)}
    for account, _, seq, cost, fine in rows:
        n, spent = used[account]
        want = "REFUSED" if not fine else "DAILY_ORDERS" if n >= 7 else "DAILY_NOTIONAL" if cost is None or spent + cost > 90 else "PASS"
        assert got[seq] == want, seq
        if want == "PASS":
            used[account] = [n + 1, spent + cost]
    assert execution.running_limits(df.limit(0), ["account"], F.col("fine"), F.col("cost"), 7, 90.0).count() == 0


def test_exits_pass_any_number_of_positions(spark):
    df = spark.createDataFrame([("LONG", 2), ("LONG", 3), ("EXIT_LONG", 9), ("FLAT", 3), (None, 3), ("SHORT", None)], "action string, n int")
    assert [r[0] for r in df.select(execution.max_positions(F.col("n"), F.col("action"), 3)).collect()] == [True, False, True, True, False, True]


def test_content_hash_by_blocks(spark):
    rows = [("a", i // 4, i, f"t{i}" if i % 9 else None) for i in range(50)] + [("b", 0, 0, "x")]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, text string")
    got = {r["k"]: (r["rows"], r["fingerprint"]) for r in slices.content_hash(df.repartition(7), ["k"], F.col("text"), size=8).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [r[3] or "" for r in rows[:50]]
    assert got == {"a": (50, digest("".join(digest("".join(texts[i : i + 8])) for i in range(0, 50, 8)))), "b": (1, digest(digest("x")))}


def test_review_score_counts_absent_figures_as_none(spark):
    df = spark.createDataFrame([(" promote ", 1, 0, 9e9, 6e9, 5.0), (None, None, None, None, None, None)], "t string, p int, s int, r double, e double, b double")
    assert [r[0] for r in df.select(slices.review_score(*map(F.col, "tpsreb"))).collect()] == [35.0, 0.0]


def test_odd_messages(spark):
    rows = [
        ("binance", '{"s":"btc-usd_t","p":"1.5","q":"2","T":9,"m":true}'), ("bybit", '{"s":"A/B","S":"Buy","p":"x","v":"1"}'), ("okx", '{"instId":"a-b","px":"1","sz":"2","side":"sell","ts":"3"}'),
        ("other", '{"s":"A"}'), ("okx", "no json"), ("okx", None), (None, '{"s":"A"}'), ("binance", '{"p":"1"}'),
    ]
    got = trades_of(spark.createDataFrame([(*r, 77) for r in rows], "venue string, payload string, ts_recv long")).collect()
    assert [tuple(r)[3:] for r in got] == [("BTCUSDT", 1.5, 2.0, -1, 9), ("AB", None, 1.0, 1, 77), ("AB", 1.0, 2.0, -1, 3), *[(None,) * 5] * 5]


def test_best_of_family_by_hand(spark):
    rows = [("up", 1.0, 1), ("up", 3.0, 2), ("up", 3.0, 1), ("up", None, 0), ("down", 2.0, 5), ("down", -1.0, 6), ("none", None, 9), (None, 4.0, 3)]
    df = spark.createDataFrame(rows, "family string, value double, tie int")
    got = {r["family"]: (r["value"], r["tie"]) for r in slices.best_of_family(df, "family", "value", ["down"], [F.col("tie")]).collect()}
    assert got == {"up": (3.0, 1), "down": (-1.0, 6), "none": (None, 9), None: (4.0, 3)}
