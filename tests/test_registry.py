import pytest
from pyspark.sql import functions as F
from tidemark.operators import features, registry, scans
from tidemark.sources.events import quotes


def test_steps_come_behind_what_they_need():
    for names in (registry.FEATURES, registry.FEATURES[::-1], ("regime_stability", "liquidity_pressure"), ("ema",), ("spread_compression", "return_1")):
        steps, done = registry.plan(names), set()
        for step in steps:
            assert set(step.needs) <= done
            done |= set(step.makes)
        assert set(names) <= done and len(steps) == len(set(steps))
        assert sum(set(s.makes) & set(registry.TREND + registry.SMOOTH) != set() for s in steps) <= 1
    assert [s.makes for s in registry.plan(["rsi"])] == [("rsi",)]
    assert len(registry.FEATURES) == len(set(registry.FEATURES)) == 27


def test_unknown_names_and_circles(spark):
    with pytest.raises(ValueError, match="no feature mid"):
        registry.plan(["mid"])
    step = lambda a, b: registry.Step((a,), (b,), None)
    with pytest.raises(ValueError, match="a > b > a"):
        registry.resolve(["a"], [step("a", "b"), step("b", "a")])
    with pytest.raises(ValueError, match="no window"):
        registry.feature_table(spark.range(1), [], windows={"ema": 3})


def test_blocks_give_what_one_group_gives(spark):
    """One key over several blocks, against every step over the whole key at once."""
    q = quotes(spark, "/root/testdata/sf0.01").filter("seq < 4000").withColumn("k", F.lit(1))
    enabled = [n for n in registry.FEATURES if n not in ("mid_price",)]
    windows = {"quote_ranks": 60}
    got = registry.feature_table(q, ["k"], enabled, windows, warm=False, size=1)  # as small as the look-back allows
    x, w = q, {**registry.WINDOWS, **windows}
    for step in registry.resolve(enabled):
        x = step.build(x, ["k"], w)
    want = {r["seq"]: r for r in x.select("seq", *enabled).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == q.count()
    assert len(rows) > 2 * registry.look_back(w)
    for r in rows:
        for n in enabled:
            a, b = r[n], want[r["seq"]][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (r["seq"], n, a, b)
    warm = registry.feature_table(q, ["k"], enabled, windows, size=1).select("seq").collect()
    assert {r["seq"] for r in warm} == {s for s, r in want.items() if all(r[n] is not None for n in enabled)}


def test_windows_over_known_values_skip_what_is_unknown(spark):
    rows = [("a", t, t, None if t % 3 == 0 else float(t % 7)) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, return_1 double")
    got = {r["seq"]: r["volatility"] for r in features.volatility(df, ["k"], 5).collect()}
    import statistics

    known = [r for r in rows if r[3] is not None]
    for i, r in enumerate(known):
        if i < 4:
            assert got[r[2]] is None
        else:
            assert abs(got[r[2]] - statistics.pstdev(x[3] for x in known[i - 4 : i + 1])) < 1e-12
    assert all(got[r[2]] is None for r in rows if r[3] is None)


def test_memory_is_below_the_last_digit():
    for a in (0.5, 0.1, features.span(50)):
        assert (1 - a) ** scans.memory(a) <= 1e-20 < (1 - a) ** (scans.memory(a) - 1)


def test_a_task_sorts_its_rows_once(spark):
    q = quotes(spark, "/root/testdata/sf0.001")
    plan = registry.feature_table(q, ["stream"])._jdf.queryExecution().executedPlan().toString().splitlines()
    blocks = next(n for n, line in enumerate(plan) if "_blk" in line and "Exchange" in line)
    assert sum("Sort [" in line for line in plan[:blocks]) == 1
