"""Numbers, windows, ranks and greedy choices that are spread over blocks, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import discovery, features, scans, spacing, stats

SCHEMA = "k string, ts_event long, seq long, v double"


def rows(spark, n=500, seed=1, span=5000, one_key=True):
    rng = random.Random(seed)
    keys = ["a"] if one_key else ["a", "b", None]
    data = [(rng.choice(keys), rng.randint(0, span), i, rng.choice([None, 1.0, 2.0, 2.5, round(rng.uniform(-9, 9), 3)])) for i in range(n)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


def in_order(data):
    by = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def test_numbers(spark):
    data, df = rows(spark, one_key=False)
    for width in (37, 10**6):
        got = {r["seq"]: (r["_i"], r["_n"]) for r in scans.number(df, ["k"], width=width).collect()}
        assert got == {r[2]: (i, len(own)) for own in in_order(data).values() for i, r in enumerate(own)}
    whole = scans.number(df, [], width=100).select("_i").collect()
    assert sorted(r[0] for r in whole) == list(range(len(data)))
    assert scans.number(df.limit(0), ["k"]).count() == 0


def test_windows_over_blocks_equal_windows_over_keys(spark):
    data, df = rows(spark, one_key=False)
    columns = {"back": lambda w: F.lag("seq", 3).over(w), "ahead": lambda w: F.lead("seq", 5).over(w), "mean": lambda w: F.avg("v").over(w.rowsBetween(-4, 2))}
    for size in (5, 64):
        got = {r["seq"]: (r["back"], r["ahead"], r["mean"]) for r in scans.along(df, ["k"], columns, 4, 5, size, width=50).collect()}
        assert len(got) == len(data)
        for own in in_order(data).values():
            for i, r in enumerate(own):
                near = [x[3] for x in own[max(0, i - 4) : i + 3] if x[3] is not None]
                back, ahead, mean = got[r[2]]
                assert back == (own[i - 3][2] if i >= 3 else None) and ahead == (own[i + 5][2] if i + 5 < len(own) else None)
                assert (mean is None and not near) or abs(mean - sum(near) / len(near)) < 1e-12
    with pytest.raises(ValueError):
        scans.along(df, ["k"], columns, before=10, size=9)


def test_a_recursive_average_over_blocks(spark):
    """One key in blocks: the memory of the average is all that a block takes from the one before."""
    data, df = rows(spark, n=3000)
    fold = lambda g: {"e": features.ema(g["v"], 0.2, 5)}
    back = scans.memory(0.2) * 2  # a quarter of the values is unknown
    blocks = scans.in_blocks(scans.number(df, ["k"], width=100), ["k"], before=back, size=500)
    got = scans.at_home(features.recursive(blocks, ["k", "_blk"], ["e"], fold)).collect()
    value, count, want = None, 0, {}
    for r in in_order(data)["a"]:
        if r[3] is not None:
            value, count = r[3] if value is None else value + 0.2 * (r[3] - value), count + 1
        want[r[2]] = value if r[3] is not None and count >= 5 else None
    assert len(got) == 3000
    for r in got:
        assert (r["e"] is None) == (want[r["seq"]] is None) and (r["e"] is None or abs(r["e"] - want[r["seq"]]) < 1e-12)


def test_a_hot_key_takes_many_tasks(spark):
    hot = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") * 1000).alias("ts_event"), F.col("id").alias("seq"), F.lit(1.0).alias("v"))
    found = scans.in_blocks(scans.number(hot, ["k"], width=1_000_000), ["k"], before=10, size=500).groupBy("_blk").count().collect()
    assert len(found) == 40 and max(r["count"] for r in found) <= 510


def test_values_in_order(spark):
    data, df = rows(spark, one_key=False)
    for pieces in (1, 8):
        got = scans.value_counts(df, ["k"], "v", pieces, {"odd": F.col("seq") % 2}).collect()
        want = {}
        for k in ("a", "b", None):
            own = [r for r in data if r[0] == k and r[3] is not None]
            for v in {r[3] for r in own}:
                less, same = [r for r in own if r[3] < v], [r for r in own if r[3] == v]
                odd = lambda x: sum(r[2] % 2 for r in x)
                want[k, v] = (len(same), len(less), len(own), odd(same), odd(less), odd(own))
        assert {(r["k"], r["_value"]): (r["n"], r["before"], r["total"], r["odd"], r["before_odd"], r["total_odd"]) for r in got} == want
    values = sorted(r[3] for r in data if r[3] is not None)
    whole = scans.sorted_values(df, [], "v", {"first": (0.0, lambda n: n - n), "tenth": (0.1, lambda n: F.floor(n / 10)), "last": (1.0, lambda n: n - 1)}).collect()
    assert [tuple(r) for r in whole] == [(values[0], values[len(values) // 10], values[-1])]


def test_places_among_many_values(spark):
    """More values than the approximation keeps, so that most are only counted."""
    x = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.pmod(F.hash("id"), F.lit(50_000)).cast("double").alias("v"))
    places = {f"p{q}": (q, lambda n, q=q: F.floor(F.lit(q) * n)) for q in (0.01, 0.25, 0.5, 0.99)}
    rows = x.collect()
    for accuracy in (200, 3000, 10_000):
        for r in scans.sorted_values(x, ["k"], "v", places, accuracy).collect():
            own = sorted(v for k, v in rows if k == r["k"])
            assert tuple(r)[1:] == tuple(own[int(q * len(own))] for q in (0.01, 0.25, 0.5, 0.99))


def test_places_among_few_values(spark):
    """Every number of values from 1 to 90, where a place is further than the approximation's margin from its share."""
    x = spark.range(91).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.col("id"))).alias("v")).filter("v <= k and k > 0")
    places = {f"p{k}": (q, lambda n, q=q: F.least(F.floor(F.lit(q) * n), n - 1)) for k, q in enumerate((0.0, 0.1, 0.25, 0.5, 0.8, 1.0))}
    places["last"] = (0.8, lambda n: F.floor(F.lit(0.8) * (n - 1)))
    for r in scans.sorted_values(x, ["k"], "v", places).collect():
        n = r["k"]
        assert tuple(r)[1:] == (*[min(int(q * n), n - 1) + 1 for q in (0.0, 0.1, 0.25, 0.5, 0.8, 1.0)], int(0.8 * (n - 1)) + 1)


def test_statistics_of_ties_and_nulls(spark):
    data, df = rows(spark, one_key=False)
    for r in stats.distribution(df, ["k"], "v").collect():
        own = sorted(x[3] for x in data if x[0] == r["k"] and x[3] is not None)
        assert (r["n"], r["q1"], r["q3"], r["median"]) == (len(own), own[len(own) // 4], own[3 * len(own) // 4], float(np.median(own)))
    for r in stats.average_rank(df, ["k"], "v", "rank").collect():
        own = [x[3] for x in data if x[0] == r["k"] and x[3] is not None]
        assert r["rank"] == (None if r["v"] is None else sum(x < r["v"] for x in own) + (own.count(r["v"]) + 1) / 2)
    q = discovery.quartile_win_rates(df.filter("v is not null"), ["k"], "v", "v").collect()
    assert sum(r["n"] for r in q) == sum(x[3] is not None for x in data)
    for k in ("a", "b", None):
        own = sorted((x for x in data if x[0] == k and x[3] is not None), key=lambda x: (x[3], x[1], x[2]))
        for quartile in range(4):
            part = [x[3] > 0 for i, x in enumerate(own) if min(3, i // (len(own) // 4)) == quartile]
            assert any(r["k"] == k and r["quartile"] == quartile and r["n"] == len(part) and abs(r["win_rate"] - sum(part) / len(part)) < 1e-12 for r in q)


def greedy(own, interval, fit):
    last, out = None, {}
    for r in own:
        take = fit(r) and r[1] is not None and (last is None or r[1] - last >= interval)
        out[r[2]] = (take, last)
        last = r[1] if take else last
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spacing_against_a_plain_loop(spark, seed):
    data, df = rows(spark, n=400, seed=seed, span=[300, 5000, 40_000, 2_000_000][seed], one_key=seed % 2 == 0)
    for fit, plain in ((None, lambda r: True), (F.col("v") > 1.5, lambda r: r[3] is not None and r[3] > 1.5)):
        want = {s: x for own in in_order(data).values() for s, x in greedy(own, 90, plain).items()}
        for reach in (1, 7, 4096) if fit is None else (2,):
            found = spacing.spaced(df, ["k"], 90, fit, reach).collect()
            assert {r["seq"]: (r["kept"], r["last_kept"]) for r in found} == want and len(found) == len(data)


def test_spacing_of_nothing_and_of_rows_without_a_time(spark):
    df = spark.createDataFrame([("a", None, 1, 1.0), ("a", 5, 2, None), ("a", 5, 3, 1.0)], SCHEMA)
    got = {r["seq"]: (r["kept"], r["last_kept"], r["v"]) for r in spacing.spaced(df, ["k"], 10).collect()}
    assert got == {1: (False, None, 1.0), 2: (True, None, None), 3: (False, 5, 1.0)}
    assert spacing.spaced(df.limit(0), ["k"], 10).count() == 0
    assert spacing.spaced(df, ["k"], 10, F.lit(False)).filter("kept").count() == 0
