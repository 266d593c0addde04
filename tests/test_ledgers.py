from pyspark.sql import functions as F
from tidemark.operators import slices
from tidemark.streaming import ledgers

SCHEMA = "k string, i long, v string"


def test_merge_history(spark):
    old = spark.createDataFrame([("a", 0, "old"), ("a", 1, "old too"), (None, 0, "null")], SCHEMA)
    new = spark.createDataFrame([("a", 5, "x"), ("b", 7, "late"), ("b", 6, "first"), (None, 9, "x"), ("c", 8, None), ("c", 8, None)], SCHEMA).repartition(3)
    got = slices.merge_history(old, new, ["k"], ["i", "v"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, [*old.collect(), *new.filter("i = 6").collect(), *new.filter("k = 'c'").limit(1).collect()]))
    assert tuple(slices.merge_counts(old, new, ["k"]).first()) == (2, 4)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path, merge = str(tmp_path / "l"), ledgers.merge_batch(str(tmp_path / "l"), ["k"], ["i"])
    batches = [[("a", 2, "x"), ("a", 1, "y"), (None, 1, "n")], [("a", 0, "z"), ("b", 1, "b")], [(None, 5, "m"), ("b", 9, "c"), ("d", 1, "d")]]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    want = {("a", "y"), (None, "n"), ("b", "b"), ("d", "d")}
    for number in (0, 1, 2, 2, 1, 2):  # replays after failures
        merge(frames[number], number)
    rows = spark.read.parquet(f"{path}/rows").collect()
    assert {(r["k"], r["v"]) for r in rows} == want and len(rows) == 4
    counts = {r["batch"]: (r["inserted"], r["skipped"]) for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {0: (2, 1), 1: (1, 1), 2: (1, 2)}


def test_a_stream_over_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 5, k * 5 + 10).select((F.col("id") % 12).cast("string").alias("v")).coalesce(1).write.mode("append").parquet(source)
        stream = ledgers.fingerprinted(spark.readStream.schema("v string").parquet(source))
        ledgers.ledger(stream, str(tmp_path / "out"), ["fingerprint"], ["v"], str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert sorted(int(r["v"]) for r in rows) == list(range(12))
    assert spark.read.parquet(f"{tmp_path}/out/counts").agg(F.sum("inserted"), F.sum("skipped")).first()[:] == (12, 18)
