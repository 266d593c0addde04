"""What larger tables bring: moves at a threshold, ties, windows of many rows, keys of many rows."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark import catalogue
from tidemark.operators import chance, edges, execution, features, hypotheses, slices, stats, temporal
from tidemark.plans import files as plans_files
from tidemark.streaming import stateful


def test_exit_at_the_threshold(spark):
    df = spark.createDataFrame([(1, 0.2, 0.3), (-1, 0.05, 0.07), (1, 0.2, 0.29), (-1, 0.0, 1.0)], "size int, entry double, price double")
    got = [r[0] for r in df.select(execution.forced_exit(F.col("size"), F.col("entry"), F.col("price"), 0.5, 0.4)).collect()]
    assert got == ["take_profit", "stop_loss", None, None]


def test_order_faults_of_one_arrival(spark):
    rows = [("a", 5, 1, 7), ("a", 4, 2, 7), ("a", 4, 1, 7), ("a", 4, 3, 6), ("a", 5, 1, 7)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "k string, ts_event long, seq long, arrival long").coalesce(1)
        assert [tuple(r) for r in slices.order_faults(df, ["k"], "arrival").collect()] == [("a", 5, 1, 1)]


def test_order_guard_of_one_arrival(spark, tmp_path):
    rows = [("a", t, 0, n, 7) for n, t in enumerate([5, 4, 6, 6, 4])]
    schema = "k string, ts_event long, seq long, id long, arrival long"
    found = set()
    for k, order in enumerate((rows, rows[::-1], rows[2:] + rows[:2])):
        path = str(tmp_path / f"in{k}")
        spark.createDataFrame(order, schema).coalesce(1).write.parquet(path)
        x = stateful.ordered(spark.readStream.schema(schema).parquet(path), ["k"], "arrival")
        x.writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start().awaitTermination()
        found.add(tuple(sorted((r["id"], r["status"]) for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect())))
    assert found == {((0, "accepted"), (1, "accepted"), (2, "accepted"), (3, "duplicate"), (4, "duplicate"))}


def test_order_guard_in_many_batches(spark, sf, monkeypatch):
    sizes, ordered = [], stateful.ordered

    def counted(stream, *rest):
        files = plans_files.drained(stream.withColumn("f", F.col("_metadata.file_path"))).groupBy("f").agg(F.count("*").alias("n"), F.min("arrival").alias("a"), F.max("arrival").alias("b"))
        sizes.append(sorted((r["a"], r["b"], r["n"]) for r in files.collect()))
        return ordered(stream, *rest)

    monkeypatch.setattr(plans_files.stateful, "ordered", counted)
    whole = sorted(map(tuple, catalogue.QUERIES["T6_order_guard"](spark, sf).collect()))
    monkeypatch.setattr(plans_files, "FILE_ROWS", 60, raising=False)
    assert sorted(map(tuple, catalogue.QUERIES["T6_order_guard"](spark, sf).collect())) == whole and len(whole) == 1000
    assert [sum(n for *_, n in files) for files in sizes] == [1000, 1000]
    assert max(n for *_, n in sizes[1]) <= 60 and all(x[1] < y[0] for x, y in zip(sizes[1], sizes[1][1:], strict=False))


class Held:
    """A key's state outside of a stream."""

    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, at):
        self.until = at

    def getCurrentWatermarkMs(self):
        return 0


def one_key(spark, monkeypatch):
    """What the order guard does with the rows of a key."""
    monkeypatch.setattr(stateful, "_stateful", lambda df, by, out, state, run, timeout: run)
    run = stateful.ordered(spark.createDataFrame([], "k string, ts_event long, seq long, arrival long"), ["k"], "arrival")
    return lambda x, held: pd.concat(run(("a",), iter([x.assign(k="a", event_time=pd.to_datetime(0))]), held))


def test_order_guard_holds_no_object_a_row(spark, monkeypatch):
    rng, n = np.random.default_rng(4), 300_000
    x = pd.DataFrame({"ts_event": rng.integers(0, 2**60, n), "seq": rng.integers(0, 3, n), "arrival": rng.permutation(n)})
    guard = one_key(spark, monkeypatch)
    tracemalloc.start()
    got = guard(x, Held())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and peak < 200 * n, peak / n


def test_order_guard_of_large_numbers(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(2**60 + rng.randint(0, 5), 2**55 + rng.randint(0, 2)) for _ in range(300)]
    guard, held, got = one_key(spark, monkeypatch), Held(), []
    for some in (range(100), range(100, 300)):
        got += guard(pd.DataFrame([(*rows[n], n) for n in some], columns=["ts_event", "seq", "arrival"]), held)["status"].tolist()
    want, last = [], (0, 0)
    for row in rows:
        want.append("accepted" if row > last else "duplicate" if row == last else "out_of_order")
        last = max(row, last)
    assert got == want and held.get == last


def test_order_guard_of_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert catalogue.QUERIES["T6_order_guard"](spark, str(tmp_path)).count() == 0


def test_shares_stay_off_the_rows(spark):
    rows = [("a", n, n / 10, n % 3 == 0) for n in range(40)] + [(None, 100 + n, n / 10, n % 2 == 0) for n in range(10)]
    df = spark.createDataFrame(rows, "k string, seq long, v double, hit boolean")
    x = chance.chance_sums(df, ["k"], "v", "hit", rounds=5, chunk_rows=16)
    assert {(r["k"], r["chosen"]) for r in x.collect()} == {("a", 14), (None, 5)} and x.count() == 10
    joins = [line for line in x._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in line]
    assert not any("_shares" in line for line in joins)


def test_trades_of_edges_by_growing_frames(spark):
    always = edges.Edge("e", F.col("f") > 0, F.lit("LONG"), F.col("f"), ((F.col("f") < -1, "out"),), (), 10)
    rows = [("a", t, s, f, 100.0 + t) for t, s, f in ((0, 1, 1.0), (5, 2, -2.0), (5, 3, 1.0), (15, 4, -2.0), (16, 5, 0.0), (16, 6, -2.0), (17, 7, 2.0))]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, f double, p double")
    x = edges.edge_trades(df, ["k"], [always], "p", unit_ms=1)
    assert sorted((r["seq"], r["exit_seq"], r["reason"]) for r in x.collect()) == [(1, 2, "out"), (3, 4, "out"), (7, None, None)]
    assert "unboundedfollowing" not in x._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("activity", [False, True])
def test_volatility_windows_of_many_rows(spark, activity):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randint(-40, 60), n, rng.choice([1.0, 2.0, 3.0, 0.0])) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, v double")
    got = {tuple(r[:3]): r for r in hypotheses.volatility_grid(df, ["k"], "v", [3, 7], [1, 5], activity).collect()}
    assert len(got) == 8
    for (k, d, h), r in got.items():
        mine, points = sorted(row[1:] for row in rows if row[0] == k), []
        for a, b in zip([None, *mine], mine, strict=False):
            if b[2] > 0:
                points.append((b[0], math.log(b[2] / a[2]) ** 2 if a and a[2] > 0 else None))
        pairs = []
        for t, _ in points:
            past = [x for u, x in points if t - d < u <= t]
            past = len(past) if activity else [x for x in past if x is not None]
            ahead = [x for u, x in points if t < u <= t + h and x is not None]
            if (activity or past) and ahead:
                pairs.append((float(past) if activity else math.sqrt(sum(past)), math.sqrt(sum(ahead))))
        assert r["n"] == len(pairs)
        assert math.isclose(r["mean_past"], sum(p for p, _ in pairs) / len(pairs)) and math.isclose(r["mean_next"], sum(f for _, f in pairs) / len(pairs))


def test_no_frame_slides_over_times(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0)], "k string, ts_event long, seq long, v double")
    plan = hypotheses.volatility_grid(df, ["k"], "v", [3], [5])._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe(RangeFrame, 1," not in plan and "specifiedwindowframe(RangeFrame, -" not in plan


def random_rows(n=300):
    rng = random.Random(7)
    return [(rng.choice(["a", "b", None]), rng.randint(-60, 90), k, round(rng.uniform(1, 9), 2)) for k in range(n)]


def slides(df):
    plan = df._jdf.queryExecution().analyzed().toString()
    return any(f"specifiedwindowframe(RangeFrame, {c}" in plan for c in ("-", *"0123456789", "cast("))


@pytest.mark.parametrize("slice_rows", [1, 7])
def test_live_features_by_slices(spark, tmp_path, slice_rows):
    rows = [(k or "c", 10**6 + 1000 * n, n, v) for n, (k, _, _, v) in enumerate(random_rows())]
    found = []
    for size in (10_000, slice_rows):
        stream = plans_files.streamed(spark, spark.createDataFrame(rows, "k string, ts_event long, seq long, mid double"), parts=2, most=40)
        got = plans_files.drained(stateful.live_features(stream, ["k"], {"volatility_long": 30, "quote_ranks": 10}, slice_rows=size))
        found.append(sorted(str(tuple(r)) for r in got.collect()))
    assert found[0] == found[1] and len(found[0]) == 300


def test_streamed_files_are_bounded(spark):
    df = spark.createDataFrame([(n, n) for n in range(100)], "ts_event long, seq long")
    per_file = plans_files.drained(plans_files.streamed(spark, df, parts=2, most=20).select("*", F.col("_metadata.file_path").alias("f"))).groupBy("f").agg(F.count("*").alias("n"), F.min("ts_event").alias("a"), F.max("ts_event").alias("b"))
    assert all(r["n"] <= 20 and r["b"] - r["a"] == r["n"] - 1 for r in per_file.collect())


def test_model_features_slide_over_no_times(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0, 1.0, 3.0, 1.0, 1.0)], "k string, ts_event long, seq long, mid double, bid_price double, ask_price double, bid_qty double, ask_qty double")
    assert not slides(features.model_features(df, ["k"])) and not slides(features.live_features(df, ["k"]))


def test_excursion_of_many_rows(spark):
    rows = random_rows()
    x = temporal.excursion(spark.createDataFrame(rows, "k string, ts_event long, seq long, v double"), ["k"], "v", 9)
    near = lambda k, t: [v for k2, u, _, v in rows if k2 == k and t <= u <= t + 9]
    assert not slides(x)
    assert {r["seq"]: (r["min_v"], r["max_v"]) for r in x.collect()} == {n: (min(near(k, t)), max(near(k, t))) for k, t, n, _ in rows}


@pytest.mark.parametrize("forward", [False, True])
def test_asof_over_blocks(spark, forward):
    rows = random_rows(120)
    df = spark.createDataFrame(rows, "k string, ts_event long, seq long, v double")
    x = temporal.asof_each(df, df.select("k", "ts_event", "seq", "v"), ["k"], "v", {"p": -30, "q": 4}, forward, None, width=7)
    assert "_block" in x._jdf.queryExecution().analyzed().toString()

    def at(k, t):
        found = [(u, n, v) for k2, u, n, v in rows if k2 == k and (u >= t if forward else u <= t)]
        return (min if forward else max)(found)[2] if found else None

    assert {r["seq"]: (r["p"], r["q"]) for r in x.collect()} == {n: (at(k, t - 30), at(k, t + 4)) for k, t, n, _ in rows}


@pytest.mark.parametrize("name", ["W05_W17_ema", "W10_W13_trend", "W16_W19_W22_W23_imbalance"])
def test_recursive_averages_run_in_blocks(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert any("FlatMapGroupsInPandas [" in line and "_blk" in line.split("]")[0] for line in plan.splitlines())


@pytest.mark.parametrize("name", ["positions", "average_cost_trips", "fifo_trips"])
def test_fills_of_a_key_over_many_batches(spark, name):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), t, n, rng.choice(["BUY", "SELL"]), float(rng.randint(1, 9)), float(rng.randint(5, 9))) for n, t in enumerate(rng.sample(range(900), 200))]
    df = spark.createDataFrame([(*r, r[4] * r[5], 0.5) for r in rows], "symbol long, ts_event long, seq long, side string, qty double, fill_price double, fill_value double, fee double")
    x, size = getattr(execution, name)(df), "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert "FlatMapGroups" not in x._jdf.queryExecution().analyzed().toString()
    before, found = spark.conf.get(size), []
    for n in (10_000, 7):
        spark.conf.set(size, n)
        found.append(sorted(str(tuple(r)) for r in x.collect()))
    spark.conf.set(size, before)
    steps = {"positions": execution.position_steps, "average_cost_trips": execution.average_cost_steps, "fifo_trips": execution.fifo_steps}[name]
    want = []
    for key in (1, 2, None):
        own = sorted((r.asDict() for r in df.collect() if r["symbol"] == key), key=lambda r: r["ts_event"])
        want += [str((*f.values(), *s)) for f, s in zip(own, steps(own), strict=True) if s[-1] is not None]
    assert found[0] == found[1] == sorted(want)


def test_percentiles_hold_no_key(spark, sf):
    rng = random.Random(9)
    rows = [(k, v) for k in ("a", "all", None) for v in [rng.choice([None, *map(float, range(50))]) for _ in range(77)]] + [("none", None)]
    x = stats.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.1, "mid": 0.5})
    for r in x.collect():
        mine = sorted(v for k, v in rows if k == r["k"] and v is not None)
        assert r["n"] == (77 if mine else 1) and (r["lo"], r["hi"]) == ((mine[0], mine[-1]) if mine else (None, None))
        for name, share in (("low", 0.1), ("mid", 0.5)):
            at = share * (len(mine) - 1)
            assert (r[name] is None) == (not mine) and (not mine or math.isclose(r[name], mine[math.floor(at)] + (at - math.floor(at)) * (mine[math.ceil(at)] - mine[math.floor(at)])))
    assert x.count() == 4
    assert "percentile(" not in catalogue.QUERIES["A22_grouping_sets"](spark, sf)._jdf.queryExecution().analyzed().toString()
