"""Live state: the same rows in several cuts of the stream, and over a restart."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import features
from tidemark.sources.events import quotes
from tidemark.streaming import stateful


def written(spark, rows, schema, path, parts):
    """A file for each part, older parts first."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


TICKS = "k string, ts_event long, seq long, arrival long, v double"


def guarded(rows):
    last, out = {}, {}
    for k, t, s, arrival, _ in sorted(rows, key=lambda r: r[3]):
        if k not in last or (t, s) > last[k]:
            last[k], out[arrival] = (t, s), "accepted"
        else:
            out[arrival] = "duplicate" if (t, s) == last[k] else "out_of_order"
    return out


def test_order_guard_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), 1_000_000 + n // 3 + rng.choice([0, 0, 1, -2]), rng.randint(0, 2), n, 1.0) for n in range(400)]
    path = str(tmp_path / "in")
    written(spark, rows[:200], TICKS, path, 3)
    run = lambda: stateful.guard(streamed(spark, path, TICKS), ["k"], "arrival", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()  # nothing new
    written(spark, rows[200:], TICKS, path, 2)
    run()
    got = [(r["arrival"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == 400 and dict(got) == guarded(rows)
    assert {s for _, s in got} == {"accepted", "duplicate", "out_of_order"}


REPORTS = "source string, ts_event long, queue_pct double, dropped long, fatal boolean"


@pytest.mark.parametrize("parts", [1, 4])
def test_source_states(spark, tmp_path, parts):
    ok = lambda s, t: (s, t, 5.0, 0, False)
    rows = [ok("a", 0), ok("b", 1000), ("b", 2000, 85.0, 0, False), ok("b", 3000), ("c", 4000, 0.0, 0, True), ok("b", 20_000), ok("b", 29_000),
            ok("b", 45_000), ("b", 46_000, None, 3, None), ok("b", 60_000), ok("c", 61_000), ok("b", 62_000), ok("a", 70_000), ok("b", 99_000), ok("b", 120_000)]
    rows = [(s, t + 10**6, *rest) for s, t, *rest in rows]  # a stream begins with its watermark at 0
    path = written(spark, rows, REPORTS, str(tmp_path / "in"), parts)
    got = drained(spark, stateful.source_states(streamed(spark, path, REPORTS), "source"), tmp_path, f"states_{parts}").collect()
    found = sorted(((r["source"], r["at"] - 10**6, r["before"], r["state"]) for r in got), key=lambda r: (r[0], r[1]))
    assert found == sorted([
        ("a", 0, None, "READY"), ("a", 30_000, "READY", "OFFLINE"), ("a", 70_000, "OFFLINE", "READY"), ("a", 100_000, "READY", "OFFLINE"),
        ("b", 1000, None, "READY"), ("b", 2000, "READY", "DEGRADED"), ("b", 3000, "DEGRADED", "READY"), ("b", 46_000, "READY", "DEGRADED"), ("b", 92_000, "DEGRADED", "OFFLINE"),
        ("b", 99_000, "OFFLINE", "DEGRADED"), ("c", 4000, None, "ERROR"), ("c", 61_000, "ERROR", "READY"), ("c", 91_000, "READY", "OFFLINE"),
    ], key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("parts", [1, 5])
def test_live_features_equal_batch(spark, tmp_path, parts):
    q = quotes(spark, "/root/testdata/sf0.01").filter("seq < 3000 and stream in ('click', 'purchase', 'view')").select("stream", "ts_event", "seq", "mid", "ask_price", "bid_price")
    rows = sorted((tuple(r) for r in q.select("stream", "ts_event", "seq", "mid").collect()), key=lambda r: (r[1], r[2]))
    assert len(rows) > 1000
    schema = "stream string, ts_event long, seq long, mid double"
    windows = {"quote_ranks": 60}
    path = written(spark, rows, schema, str(tmp_path / "in"), parts)
    got = {r["seq"]: r for r in drained(spark, stateful.live_features(streamed(spark, path, schema), ["stream"], windows), tmp_path, f"features_{parts}").collect()}
    by = ["stream"]
    x = features.volatility_regime(features.volatility(features.with_returns(q, by), by), by)
    x = features.quote_intensity(features.bollinger_position(features.rsi(x, by), by), by, 20, 60)
    names = ["volatility", "rsi", "volatility_ratio", "bollinger_pos", "quote_intensity"]
    want = x.select("seq", *[F.col(n) for n in names]).collect()
    assert len(got) == len(want)
    for r in want:
        for n in names:
            a, b = got[r["seq"]][n], r[n]
            assert (a is None or a != a) == (b is None) and (b is None or abs(a - b) < 1e-9 * max(1, abs(b))), (r["seq"], n, a, b)
    assert all(sum(r[n] is not None for r in want) > 100 for n in names)
