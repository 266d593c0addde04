"""Permutations against plain ones, live confidence and the gate against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import chance, discovery, spacing

SCHEMA = "k string, seq long, v double, hit boolean"


def data(n, seed=3, effect=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hit = rng.random() < 0.3
        out.append(("ab"[i % 2], i, rng.gauss(effect if hit else 0.0, 1.0), hit if i % 17 else None))
    return out + [("a", n + 1, None, True), ("none", n + 2, 1.0, False)]


def test_every_round_has_the_size_of_the_pattern(spark):
    rows = data(3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    size = Counter(r[0] for r in rows if r[3] and r[2] is not None)
    for chunk_rows in (100, 10**6):
        got = chance.chance_sums(df.withColumn("v", F.when(F.col("v").isNotNull(), 1.0)), ["k"], "v", "hit", rounds=50, chunk_rows=chunk_rows).collect()
        assert Counter(r["k"] for r in got) == dict.fromkeys(("a", "b", "none"), 50)
        assert all(r["chosen"] == size[r["k"]] == r["sum"] for r in got)


def test_rounds_do_not_depend_on_how_rows_are_stored(spark):
    df = spark.createDataFrame(data(500), SCHEMA)
    one = {(r["k"], r["round"]): r["sum"] for r in chance.chance_sums(df.repartition(3), ["k"], "v", "hit", rounds=20, chunk_rows=60).collect()}
    two = {(r["k"], r["round"]): r["sum"] for r in chance.chance_sums(df.orderBy(F.desc("v")).coalesce(1), ["k"], "v", "hit", rounds=20, chunk_rows=60).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert len({round(v, 9) for v in one.values()}) > 30


@pytest.mark.parametrize("effect", [0.0, 0.12, 0.3])
def test_p_is_that_of_plain_shuffles(spark, effect):
    rows = data(1600, 11, effect)
    got = {r["k"]: r for r in chance.permutation_p(spark.createDataFrame(rows, SCHEMA), ["k"], "v", "hit", rounds=1000, chunk_rows=90).collect()}
    rng = np.random.default_rng(5)
    for k in "ab":
        v = np.array([r[2] for r in rows if r[0] == k and r[2] is not None])
        hit = np.array([bool(r[3]) for r in rows if r[0] == k and r[2] is not None])
        gap = v[hit].mean() - v[~hit].mean()
        plain = []
        for _ in range(3000):
            x = rng.permutation(v)
            plain.append(abs(x[: hit.sum()].mean() - x[hit.sum() :].mean()) >= abs(gap))
        p = float(np.mean(plain))
        assert abs(got[k]["gap"] - gap) < 1e-9
        assert abs(got[k]["p"] - p) < 4 * (max(p * (1 - p), 0.002) * (1 / 1000 + 1 / 3000)) ** 0.5
    assert (got["none"]["p"], got["none"]["gap"]) == (1.0, -1.0)  # nothing matches: every split is the pattern's own


def test_constant_patterns(spark):
    """A pattern that is all of the difference is never matched by chance; one that is none of it always is."""
    x = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") % 2 == 0).alias("hit"), (F.col("id") % 2).cast("double").alias("v"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("w"))
    assert chance.permutation_p(x, ["k"], "v", "hit").first()["p"] == 0.0
    assert chance.permutation_p(x, ["k"], "w", "hit").first()["p"] == 1.0
    assert chance.permutation_p(x.limit(0), ["k"], "v", "hit").count() == 0


def test_importance_against_a_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1) if i % 9 else None) for i in range(400)]
    rows = [(*r, 2 * r[1] + r[2] > rng.gauss(0, 0.4)) for r in rows]
    names = ["x", "y", "z"]
    df = spark.createDataFrame(rows, "seq long, x double, y double, z double, label boolean").repartition(5)
    found = chance.permutation_importance(df, names, lambda c: 2 * c["x"] + c["y"] + 0 * F.coalesce(c["z"], F.lit(0.0)) > 0, "label", blocks=7).collect()
    h = lambda s, i: (int(hashlib.md5(f"{s}:{i}".encode()).hexdigest()[:8], 16), i)
    base = sorted(rows, key=lambda r: h(42, r[0]))
    score = lambda xs: sum((2 * a + b > 0) == label for a, b, label in xs) / len(rows)
    baseline = score((r[1], r[2], r[4]) for r in rows)
    want = {}
    for j, name in enumerate(names):
        falls = []
        for rep in range(5):
            other = sorted(rows, key=lambda r: h(42 + rep * 1000 + j + 1, r[0]))
            falls.append(baseline - score((o[1] if j == 0 else r[1], o[2] if j == 1 else r[2], r[4]) for r, o in zip(base, other, strict=True)))
        want[name] = (np.mean(falls), np.std(falls))
    assert [r["feature"] for r in sorted(found, key=lambda r: r["rank"])] == ["x", "y", "z"]
    for r in found:
        mean, std = want[r["feature"]]
        assert abs(r["baseline"] - baseline) < 1e-12 and abs(r["mean_decrease"] - mean) < 1e-12 and abs(r["std_decrease"] - std) < 1e-12
        assert r["is_important"] == (mean > std) and r["unimportant"] == (mean <= 0.005) and abs(r["normalised"] - mean / want["x"][0]) < 1e-12
    assert chance.permutation_importance(df.limit(0), names, lambda c: c["x"] > 0, "label").count() == 0


def test_live_confidence_over_blocks(spark):
    rng = random.Random(6)
    trades = [(k, t, t, rng.choice([1.0, 0.5, -1.0, 0.0] if k == "a" else [-1.0, -0.2, 0.1])) for k, n in (("a", 6000), ("b", 120)) for t in range(n)]
    df = spark.createDataFrame(trades, "k string, ts_event long, seq long, pnl double").repartition(4)
    rules = {**discovery.LEARNING, "alpha": 0.2}
    got = {(r["k"], r["seq"]): r for r in discovery.live_confidence(df, ["k"], start=0.6, baseline_confidence=0.6, baseline_win_rate=0.4, rules=rules).collect()}
    assert len(got) == len(trades)
    for k in "ab":
        score, wins, losses = 0.6, 0, 0
        for n, (_, _, s, pnl) in enumerate((t for t in trades if t[0] == k), 1):
            wins, losses = wins + (pnl > 0), losses + 1 if pnl < 0 else 0
            if n >= 30:
                score = score * 0.8 + (pnl > 0) * 0.2
            alerts = ["CONFIDENCE_DROP"] * (0.6 - score > 0.15) + ["CONSECUTIVE_LOSSES"] * (losses >= 10) + ["WINRATE_DROP"] * (n >= 30 and 0.4 - wins / n > 0.1)
            r = got[k, s]
            assert (r["trades"], r["wins"], r["losses_in_row"]) == (n, wins, losses) and abs(r["confidence"] - score) < 1e-12 and r["alerts"] == alerts
    none = discovery.live_confidence(df.filter("k = 'b'"), ["k"]).filter(F.size("alerts") > 0).count()
    assert none == 0


def test_gate(spark):
    rng = random.Random(2)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick("a", None), t // 3 * pick(1, 100), t, pick(0.5, 0.7, 0.9, None), pick(-1, 0, 1, None), pick(0, 1, 2, None), pick(0, 2, 3, None), pick(0.0, 1e-4, 0.5, None), pick(100.0, 0.0, None)) for t in range(500)]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, score double, regime_trend int, regime_volatility int, regime_spread int, spread double, mid double")
    rules = {**spacing.GATE, "cooldown_ms": 90}
    got = {r["seq"]: (r["allow"], r["reason"]) for r in spacing.gate(df, ["k"], rules).collect()}
    last = {}
    for k, t, s, score, trend, vol, wide, spread, mid in sorted(rows, key=lambda r: (r[1], r[2])):
        ratio = 0.0 if mid == 0 else (spread or 0.0) / (1.0 if mid is None else mid)
        if (0 if trend is None else trend) < -0.5:
            why = "regime_trend"
        elif (1 if vol is None else vol) < 0:
            why = "regime_volatility"
        elif (1 if wide is None else wide) > 2:
            why = "regime_spread"
        elif score is None or score < 0.6:
            why = "signal_strength"
        elif k in last and t - last[k] < 90:
            why = "cooldown"
        elif ratio > 0.001:
            why = "spread_penalty"
        else:
            why, last[k] = "all_gates_passed", t
        assert got[s] == (why == "all_gates_passed", why)
    assert len({why for _, why in got.values()}) == 6
