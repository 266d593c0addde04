"""Round trips through each file format, and the rules of discovery that have no SQL."""

import pytest
from pyspark.sql import functions as F
from tidemark.operators import discovery
from tidemark.sources import files


@pytest.fixture
def few(spark):
    return spark.createDataFrame([("x", "bbo", "a", "20260101", 2, 0, 0.1), ("x", "bbo", "a", "20260101", 1, 1, 2.0), ("x", "bbo", "b", "20260102", 3, 0, -1.5)], "exchange string, stream string, symbol string, date string, ts_event long, seq long, v double")


def test_archive(spark, few, tmp_path):
    path = str(tmp_path / "a")
    files.write_archive(few, path)
    schema = "ts_event long, seq long, v double, exchange string, stream string, symbol string, date string"
    back = files.archive(spark, path, schema, date=["20260101"])
    assert [(r["ts_event"], r["date"]) for r in back.orderBy("ts_event").collect()] == [(1, "20260101"), (2, "20260101")]
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString() or "date" in back._jdf.queryExecution().toString()
    assert [r["ts_event"] for r in files.ordered_rows(back)] == [1, 2]


def test_json_lines(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"schema_version": "1", "n": 1}\nbroken\n{"schema_version": "2", "n": 2}\n')
    path, schema = str(tmp_path / "j.json"), "schema_version string, n long"
    lax = files.json_lines(spark, path, schema)
    assert [r["n"] for r in lax.orderBy("n").collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, path, schema, strict=True).collect()
    with pytest.raises(Exception, match="schema_version is not 1: 2"):
        files.with_version(lax, "1").collect()


def test_tsv_and_metrics(spark, few, tmp_path):
    files.write_tsv(few.select("symbol", "seq", "v"), str(tmp_path / "t"), ["symbol", "seq"])
    rows = files.tsv(spark, str(tmp_path / "t")).collect()
    assert sorted(r["v"] for r in rows) == ["-1.500000000000000", "0.100000000000000", "2.000000000000000"]
    files.write_metrics(few, str(tmp_path / "m"), "up", ["symbol", "date"], "seq")
    assert 'up{symbol="b",date="20260102"} 0' in [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    for _ in range(2):
        files.append_json(few, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 6


def test_corrupt(spark, few, tmp_path):
    few.select("seq").write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"not parquet")
    good, bad = files.split_corrupt(spark, [str(tmp_path / n) for n in ("good", "bad", "none")], "seq long")
    assert len(good) == 1 and [k for _, k in bad] == ["corrupt", "missing"]


def test_meta(spark):
    m = spark.createDataFrame([(3, 1, 5, "1", "bbo"), (4, 6, 9, "1", "bbo")], "rows long, ts_event_min long, ts_event_max long, schema_version string, stream_type string")
    assert tuple(files.merged_meta(m).first()) == (7, 1, 9, True)
    assert not files.merged_meta(m.union(m.withColumn("schema_version", F.lit("2")))).first()["consistent"]


def test_four_tests(spark):
    score, verdict = discovery.four_tests(F.lit(0.02), F.lit(None).cast("double"), F.lit(0.4), F.lit(True), tests=5)
    assert tuple(spark.range(1).select(score, verdict).first()) == (0.5, "WEAK")
    score, verdict = discovery.four_tests(F.lit(0.001), F.lit(0.2), F.lit(0.6), F.lit(True), tests=5)
    assert tuple(spark.range(1).select(score, verdict).first()) == (0.75, "ACCEPT")
