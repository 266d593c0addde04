import itertools
import random

import pytest
from tidemark.operators import decisions as d


def plain(signals, mode, min_strength=0.3, min_signals=2, least=0.5):
    strong = [s for s in signals if s[1] >= min_strength]
    if not strong:
        return "HOLD", 0.0, "no_valid_signals"
    longs, shorts = [s for s in strong if s[0] > 0], [s for s in strong if s[0] < 0]
    word = {1: "long", -1: "short"}
    if mode == "majority":
        best = longs if len(longs) > len(shorts) else shorts if len(shorts) > len(longs) else []
        if len(best) < min_signals:
            return "HOLD", 0.0, "no_majority"
        return word[best[0][0]].upper(), sum(s[1] for s in best) / len(strong), "majority_" + word[best[0][0]]
    if mode == "unanimous":
        if len(strong) < min_signals:
            return "HOLD", 0.0, "insufficient_signals"
        if longs and shorts:
            return "HOLD", 0.0, "not_unanimous"
        return word[strong[0][0]].upper(), sum(s[1] for s in strong) / len(strong), "unanimous_" + word[strong[0][0]]
    whole = sum(s[2] or s[1] for s in strong)
    net = sum(s[0] * (s[2] or s[1]) * s[1] for s in strong) / whole
    side = 1 if net > 0 else -1
    return (word[side].upper(), abs(net), "weighted_" + word[side]) if abs(net) >= least else ("HOLD", abs(net), "below_threshold")


def test_rules():
    report = [{"feature": n, "alpha_score": a, "label_correlation": c} for n, a, c in (("x", 0.2, 0.5), ("y", 0.9, -0.2), ("z", 0.5, 0.001), ("w", 0.1, 1.0), ("v", 0.01, 1.0))]
    got = d.rules_of(report, top=4, min_score=0.05)
    assert [(r.feature, round(r.threshold, 9), r.rising) for r in got] == [("y", 0.005, False), ("z", 0.01, True), ("x", 0.002, True), ("w", 0.001, True)]


@pytest.mark.parametrize("mode", ["majority", "unanimous", "weighted"])
def test_combinations(spark, mode):
    rng = random.Random(7)
    values = [None, float("nan"), 0.0, 0.05, -0.05, 0.5, -0.5, 3.0, -3.0]
    rows = [(i, *v, rng.choice([0.5, 1.0, 2.0])) for i, v in enumerate(itertools.chain(itertools.product(values, repeat=2), [(rng.choice(values), rng.choice(values)) for _ in range(60)]))]
    rows = [(i, a, b, rng.choice(values), m) for i, a, b, m in rows]
    rules = [d.Rule("a", 0.05, 0.8, True), d.Rule("b", 0.02, 0.6, False), d.Rule("c", 0.1, 0.9, True)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, m double")
    x = d.combine(d.with_signals(df, rules, df["m"]), mode)
    for r in x.collect():
        signals = []
        for rule in rules:
            v, bar = r[rule.feature], rule.threshold * r["m"]
            if v is not None and v == v and abs(v) > bar:
                side = (1 if v > 0 else -1) * (1 if rule.rising else -1)
                signals.append((side, min(1.0, abs(v) / bar / 10) * rule.weight, rule.weight))
        assert [(s["direction"], round(s["strength"], 9)) for s in r["signals"]] == [(s[0], round(s[1], 9)) for s in signals]
        total = sum(s[1] for s in signals)
        assert abs(r["consensus"] - (sum(s[0] * s[1] for s in signals) / total if total else 0.0)) < 1e-12
        action, confidence, reason = plain(signals, mode)
        assert (r["action"], r["reason"]) == (action, reason) and abs(r["confidence"] - confidence) < 1e-12, (r, signals)


def test_unknown_mode_and_no_rules(spark):
    with pytest.raises(ValueError, match="first"):
        d.combine(d.with_signals(spark.range(1), [d.Rule("id", 1.0, 1.0, True)]), "first")
    with pytest.raises(ValueError, match="no feature"):
        d.with_signals(spark.range(1), [])
