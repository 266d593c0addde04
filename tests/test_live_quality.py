"""Silences and grades of live windows against plain versions, for different cuts of the same rows."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators.rollups import quality
from tidemark.streaming import live

SCHEMA = "source string, ts_event long, seq long, dropped long, queue double"
T0 = 1_704_067_200_000  # a full quarter of an hour


@pytest.fixture(scope="module")
def rows():
    rng, out, seq = random.Random(8), [], 0
    for source in ("a", "b"):
        at = T0
        for _ in range(300):
            at += rng.choice((1_000, 5_000, 29_999, 30_001, 95_000))
            out.append((source, at, seq, int(rng.random() < 0.01), rng.uniform(20, 95)))
            seq += 1
    # A third source moves the time on, so that the watermark passes all that is compared.
    out.append(("end", max(r[1] for r in out) + 7_200_000, seq, 0, 0.0))
    return sorted(out, key=lambda r: r[1])


def streamed(spark, rows, parts, tmp_path, name):
    path = str(tmp_path / name)
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, df, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out).filter("source <> 'end'").collect()


@pytest.mark.parametrize("parts", [1, 6])
def test_silences_of_sliding_windows(spark, rows, tmp_path, parts):
    got = drained(spark, live.silence_counts(streamed(spark, rows, parts, tmp_path, "in"), ["source"]), tmp_path, "silences")
    want = {}
    for source in ("a", "b"):
        times = [r[1] for r in rows if r[0] == source]
        for at, after in zip(times, [*times[1:], None], strict=True):
            if after is None or after - at > 30_000:
                fell = at + 30_000 - 1  # a session's time is the last instant within it
                first = (fell // 60_000 - 14) * 60_000
                for start in range(first, first + 15 * 60_000, 60_000):
                    want[source, start] = want.get((source, start), 0) + 1
    assert {(r["source"], r["start"]): r["silences"] for r in got} == want and len(want) > 50
    assert all(r["end"] - r["start"] == 900_000 for r in got)


@pytest.mark.parametrize("parts", [1, 5])
def test_grades_equal_the_batch_rule(spark, rows, tmp_path, parts):
    signals = {"dropped": F.sum("dropped"), "queue_pct": F.max("queue"), "reconnects": F.count("*")}
    got = drained(spark, live.graded_windows(streamed(spark, rows, parts, tmp_path, "in"), ["source"], signals), tmp_path, "grades")
    batch = spark.createDataFrame(rows, SCHEMA).groupBy("source", (F.col("ts_event") - F.col("ts_event") % 900_000).alias("start")).agg(*[c.alias(n) for n, c in signals.items()])
    none = F.lit(None).cast("double")
    grade, why = quality(F.col("dropped"), F.col("queue_pct"), F.col("reconnects"), none, none, none, none)
    want = {(r[0], r[1]): (r[2], r[3]) for r in batch.select("source", "start", grade, why).collect() if r[0] != "end"}
    assert {(r["source"], r["start"]): (r["quality"], r["reasons"]) for r in got} == want and {w[0] for w in want.values()} >= {"BAD", "DEGRADED"}
    with pytest.raises(ValueError):
        live.graded_windows(spark.readStream.format("rate").load(), ["source"], {"other": F.count("*")})
