"""Hand-computed cases, one for each rule that is easy to get wrong."""

import pytest
from pyspark.sql import functions as F
from tidemark.operators import bars, clusters, execution, features, hypotheses, rollups, slices, stats, temporal


def test_bucket_modes(spark):
    df = spark.createDataFrame([(t,) for t in (2499, 2500, 2501, 7499, 7500, 7501, -1)], "t long")
    got = df.select("t", bars.bucket(F.col("t"), 5000).alias("f"), bars.bucket(F.col("t"), 5000, "round").alias("r")).collect()
    assert [(r["f"], r["r"]) for r in got] == [(0, 0), (0, 0), (0, 5000), (5000, 5000), (5000, 10000), (5000, 10000), (-5000, 0)]
    with pytest.raises(ValueError):
        bars.bucket(F.col("t"), 5000, "ceil")
    with pytest.raises(ValueError):
        bars.rebucket(df, 5000, 5000)


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 5, 2), ("b", 7, 3)], "k string, ts_event long, seq long")
    right = spark.createDataFrame([("a", 10, 1, 1.0), ("a", 10, 2, 2.0), ("a", 12, 3, None), ("a", 4, 0, 4.0)], "k string, ts_event long, seq long, v double")
    back = {r["seq"]: r["r_seq"] for r in temporal.asof_backward(left, right, ["k"], ["v"]).collect()}
    ahead = {r["seq"]: r["r_seq"] for r in temporal.asof_forward(left, right, ["k"], ["v"]).collect()}
    near = {r["seq"]: r["r_seq"] for r in temporal.nearest(left, right, ["k"], ["v"], 1).collect()}
    assert back == {1: 2, 2: 0, 3: None} and ahead == {1: 1, 2: 1, 3: None} and near == {1: 2, 2: 0, 3: None}


def fill(side, qty, price, ts, fee=1.0):
    return {"side": side, "qty": qty, "fill_price": price, "fill_value": qty * price, "fee": fee, "ts_event": ts, "seq": ts}


def test_position_open_add_reduce_flip_close():
    steps = execution.position_steps([fill("BUY", 2, 10, 1), fill("BUY", 2, 20, 2), fill("SELL", 1, 30, 3), fill("SELL", 5, 10, 4), fill("BUY", 2, 5, 5), fill("BUY", 1, 1, 6, None)])
    assert [s[0] for s in steps] == [2, 4, 3, -2, 0, 1]
    assert [s[1] for s in steps] == [10, 15, 15, 10, 0, 1]
    assert [s[2] for s in steps] == [-1, -2, 12, -4, 5, 5]


def test_round_trips():
    f = [fill("BUY", 2, 10, 1), fill("BUY", 2, 20, 2), fill("SELL", 1, 30, 3), fill("SELL", 4, 10, 4)]
    assert [r[0] for r in execution.average_cost_steps(f)] == [None, None, 30 - 15 - 1 - 0.5, 40 - 60 - 1 - 2.0]
    assert execution.fifo_steps(f) == [(None, None), (None, None), (1, (30 - 10) * 1 - 0.5 - 1), (2, (10 - 20) * 3 - 1.5 - 1)]


def test_constant_series(spark):
    df = spark.createDataFrame([(1, i, i, 5.0, 5.0, 5.0) for i in range(30)], "k long, ts_event long, seq long, mid double, bid_price double, ask_price double")
    x = features.rsi(features.bollinger_position(df, ["k"]), ["k"]).orderBy("seq").collect()
    assert [r["rsi"] for r in x[:15]] == [None] * 14 + [100.0] and [r["bollinger_pos"] for r in x[18:20]] == [None, 0.5]
    one = df.groupBy("k").agg(stats.pearson(F.col("mid"), F.col("seq")).alias("r"), stats.t_stat(F.col("mid")).alias("t")).first()
    assert (one["r"], one["t"]) == (0.0, 0.0)


def test_warm_up_holds_exactly_n(spark):
    df = spark.createDataFrame([(1, i, i, float(i % 3 + 1)) for i in range(25)], "k long, ts_event long, seq long, mid double")
    x = features.volatility(features.with_returns(df, ["k"]), ["k"], 20).orderBy("seq").collect()
    assert [r["volatility"] is None for r in x] == [True] * 20 + [False] * 5


def test_cooldown_and_interval(spark):
    df = spark.createDataFrame([(1, t, t, p) for t, p in [(0, 1.0), (1, 2.0), (2, 4.0), (12, 8.0), (13, 8.1), (25, 20.0)]], "k long, ts_event long, seq long, price double")
    assert [r["ts_event"] for r in hypotheses.jumps(df, ["k"], "price", 0.5, 10).orderBy("ts_event").collect()] == [1, 12, 25]
    assert [r["ts_event"] for r in slices.min_interval(df, 12, ["k"]).orderBy("ts_event").collect()] == [0, 12, 25]


@pytest.mark.parametrize(
    ("signals", "state"),
    [((0, 0, 0, 0, 0, 0, None), "GOOD"), ((1, 0, 0, 0, 0, 0, 500), "BAD"), ((0, 95, 0, 0, 0, 0, None), "BAD"), ((0, 10, 0, 0, 700, 200, None), "DEGRADED"), ((0, 10, 0, 0, 700, 700, None), "BAD"),
     ((0, 10, 5, 0, 0, 0, None), "DEGRADED"), ((0, 10, 5, 0, 0, 0, 101), "GOOD"), ((0, 60, 5, 0, 0, 0, 101), "DEGRADED"), ((None,) * 7, "GOOD")],
)
def test_quality_rules(spark, signals, state):
    df = spark.createDataFrame([signals], "a long, b long, c long, d long, e long, f long, g long")
    got, why = rollups.quality(*[F.col(c) for c in "abcdefg"])
    row = df.select(got.alias("q"), why.alias("w")).first()
    assert row["q"] == state and (state == "GOOD" or row["w"])


def test_cursor_round_trip_and_paging(spark):
    df = spark.createDataFrame([(t, s) for t in range(5) for s in range(3)], "ts_event long, seq long")
    seen, cursor = [], None
    while rows := slices.page(df, cursor, 4).collect():
        seen += [tuple(r) for r in rows]
        cursor = seen[-1]
    assert seen == [(t, s) for t in range(5) for s in range(3)]
    c = df.select(slices.encode_cursor(F.col("ts_event"), F.col("seq")).alias("c"), "ts_event", "seq")
    assert c.filter(slices.decode_cursor(F.col("c"))["seq"] != F.col("seq")).count() == 0


def test_pushdown_of_page(spark, sf, tmp_path):
    spark.range(100).selectExpr("id ts_event", "id seq", "id other").write.parquet(str(tmp_path / "t"))
    plan = slices.after(spark.read.parquet(str(tmp_path / "t")), 5, 1).select("seq")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts_event,5)" in plan and "other" not in plan.split("ReadSchema")[-1]


def test_correlated_columns_share_the_first_leader(spark):
    names = ["a", "b", "c", "d"]
    one = spark.createDataFrame([(0.9, 0.1, 0.2, 0.95, 0.0, 0.85)], "a_b double, a_c double, a_d double, b_c double, b_d double, c_d double")
    got = {r["feature"]: r["cluster"] for r in stats.correlation_clusters(one, names).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}  # c goes with b, but b leads no cluster
    assert abs(stats.correlation_clusters(one, names).first()["redundancy"] - (0.95 + 0.9 + 0.85 + 0.2 + 0.1) / 5) < 1e-12


def test_offsets_of_one_sort_equal_joins_one_by_one(spark):
    rows = [(k, t * 7 % 50, i, float(t)) for i, (k, t) in enumerate((k, t) for k in "ab" for t in range(25))]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, v double")
    for forward, one in ((False, temporal.asof_backward), (True, temporal.asof_forward)):
        offsets = {"x": 5, "y": -9, "z": 0}
        got = {r["seq"]: (r["x"], r["y"], r["z"]) for r in temporal.asof_each(df, df, ["k"], "v", offsets, forward, 6).collect()}
        want = [{r["seq"]: r["r_v"] for r in one(df, df, ["k"], ["v"], o, 6).collect()} for o in offsets.values()]
        assert got == {s: tuple(w[s] for w in want) for s in want[0]}


def test_clusters_of_distant_groups(spark):
    centres = [(0.0, 100.0), (10.0, 0.0), (20.0, 300.0), (30.0, 50.0)]
    rows = [(i, c[0] + i % 5 * 0.1, c[1] + i % 3, float(g)) for g, c in enumerate(centres) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, None, 1.0, 0.0), (98, float("nan"), 1.0, 0.0)], "i long, x double, y double, r double")
    c = clusters.fit(df, ["x", "y"])
    got = clusters.predict(df, c).collect()
    for row in got:
        if row["i"] > 90:
            assert row["cluster"] is None and row["confidence"] == 0 and row["cluster_regime"] is None
            continue
        far = [((row["x"] - a) ** 2 + (row["y"] - b) ** 2) ** 0.5 for a, b in c.centroids]
        assert row["cluster"] == far.index(min(far)) == row["r"] and abs(row["distance"] - min(far)) < 1e-9
        assert abs(row["confidence"] - max(0, 1 - min(far) / c.reach[row["cluster"]])) < 1e-9 and (row["cluster_regime"] is None) == (row["confidence"] < 0.3)
    scan = {r["cluster"]: r for r in clusters.cluster_scan(df, c, "r").collect()}
    assert {k: (r["n_in"], r["n_out"], r["mean_in"]) for k, r in scan.items()} == {g: (40, 122, float(g)) for g in range(4)}
    assert clusters.predict(df, clusters.fit(df.limit(0), ["x", "y"])).filter("cluster is not null").count() == 0
