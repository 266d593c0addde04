"""The baseline's positions, days, states, cells and rankings against plain versions."""

import random
import statistics

import pytest
from tidemark.operators import features, rollups, stats


def decide(position, r, mid, spread, t=0.5, most=25.0):
    if spread / mid * 10_000 > most:
        return "FLAT", "spread_too_wide"
    up, down = r is not None and r > t, r is not None and r < -t
    if position:
        leaves = down if position == 1 else up
        return (("EXIT_LONG" if position == 1 else "EXIT_SHORT"), "momentum_reversal") if leaves else ("FLAT", "holding_long" if position == 1 else "holding_short")
    return ("LONG", "positive_momentum") if up else ("SHORT", "negative_momentum") if down else ("FLAT", "no_signal")


@pytest.mark.parametrize("seed", range(3))
def test_positions_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i // 2, i, 100.0, rng.choice((0.1, 0.2, 0.9)), rng.choice((None, 0.0, 0.4, 0.6, -0.6, 2.0, -0.5))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, mid_price double, spread double, return_1 double")
    got = {r["seq"]: r for r in features.baseline_actions(df, ["k"], 0.5, 25.0).collect()}
    held, seen = {"a": 0, "b": 0}, set()
    for k, _, seq, mid, spread, r in rows:
        want = decide(held[k], r, mid, spread)
        assert (got[seq]["position"], got[seq]["action"], got[seq]["reason"]) == (held[k], *want), seq
        assert got[seq]["confidence"] == (None if want[0] == "FLAT" else min(1, abs(r) / 0.5))
        held[k] = {"LONG": 1, "SHORT": -1, "EXIT_LONG": 0, "EXIT_SHORT": 0}.get(want[0], held[k])
        seen.add(want)
    assert len(seen) == 8 and features.baseline_actions(df.limit(0), ["k"], 0.5, 25.0).count() == 0


def test_runs_of_days_by_hand(spark):
    df = spark.createDataFrame([("a", d) for d in (1, 2, 2, 5, 9, 10)] + [("b", 1)], "k string, day int")
    runs = lambda **kw: sorted(tuple(r) for r in rollups.sliding_lists(df, ["k"], "day", 2, **kw).collect())
    assert runs() == [("a", 1, 2), ("a", 2, 5), ("a", 5, 9), ("a", 9, 10)]
    assert runs(lookback=3) == [("a", 5, 9), ("a", 9, 10)] and runs(last=1) == [("a", 9, 10)] and runs(lookback=1) == []


def test_state_times_by_hand(spark):
    df = spark.createDataFrame([("k", 0, 0, "x"), ("k", 10, 1, "y"), ("k", 40, 2, "x"), ("k", 45, 3, None), ("j", 0, 4, "x")], "k string, ts_event long, seq long, s string")
    got = {(r["k"], r["s"]): (r["n"], r["gaps"], r["avg_ms"], r["share"]) for r in rollups.state_times(df, ["k"], "s").collect()}
    assert got == {("k", "x"): (2, 2, 7.5, 0.5), ("k", "y"): (1, 1, 30.0, 0.25), ("k", None): (1, 0, None, 0.25), ("j", "x"): (1, 0, None, 1.0)}


def test_cells_equal_a_plain_summary(spark):
    rng = random.Random(4)
    names = ("DIRECTIONAL", "DIRECTIONAL", "DIRECTIONAL", "ANTI_EDGE", "NO_EDGE")
    cells = {c: [(rng.choice(names), rng.uniform(1, 6)) for _ in range(10 + c % 2)] for c in range(20)} | {98: [("DIRECTIONAL", 3.0)] * 10, 99: [("INSUFFICIENT_SUPPORT", None)] * 10}
    df = spark.createDataFrame([(c, *w) for c, ws in cells.items() for w in ws], "cell long, verdict string, mean double")
    got = {r["cell"]: r for r in rollups.cell_summary(df, ["cell"], 10).collect()}
    for c, ws in cells.items():
        means, verdicts = sorted(m for _, m in ws if m is not None) or [0.0], [v for v, _ in ws]
        p10, rate = means[int((len(means) - 1) * 0.1)], verdicts.count("DIRECTIONAL") / len(ws)
        assert (got[c]["windows"], got[c]["directional"], got[c]["insufficient"]) == (len(ws), verdicts.count("DIRECTIONAL"), verdicts.count("INSUFFICIENT_SUPPORT"))
        assert (got[c]["median_mean"], got[c]["p10_mean"], got[c]["min_mean"]) == pytest.approx((statistics.median(means), p10, means[0]))
        assert got[c]["promising"] == (len(ws) == 10 and "INSUFFICIENT_SUPPORT" not in verdicts and statistics.median(means) >= 2 and p10 >= 1.5 and rate >= 0.8)
    assert got[98]["promising"] and not got[99]["promising"]


def test_ranking_puts_unknown_last(spark):
    df = spark.createDataFrame([(float(i), float(-i), 1.0, float(i % 2), i >= 5) for i in range(10)], "a double, b double, c double, d double, y boolean").withColumn("y", stats.F.col("y").cast("int"))
    got = stats.label_ranking(df, ["d", "c", "b", "a"], "y").orderBy("rank").collect()
    assert [r["feature"] for r in got] == ["a", "b", "d", "c"] and got[3]["size"] == 0 and got[0]["strength"] == "STRONG"
