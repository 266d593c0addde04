import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F
from tidemark.llm import queries, store, warc

SCHEMA = "page_id long, url string, html string, record_key string"


def test_text_sink_writes_whole_members(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (i * 37 % 400), None) for i in range(300)]
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/w")
    for name in os.listdir(tmp_path / "w"):
        if name.startswith("part-"):
            assert gzip.decompress((tmp_path / "w" / name).read_bytes()).count(b"WARC/1.1\r\n") > 0
    expected = sorted((str(i), hashlib.sha1(h.encode()).hexdigest()) for i, _, h, _ in rows)
    for size in (97, 1000, 1 << 25):
        got = warc.read(spark, f"file://{tmp_path}/w", size).collect()
        assert sorted((r["record_key"], r["payload_digest"]) for r in got) == expected
        assert all(r["digest_ok"] for r in got)


def test_ranges_are_dealt_one_by_one(spark, tmp_path):
    rng = random.Random(1)
    warc.write(spark.createDataFrame([(i, "u", rng.randbytes(9000).hex(), None) for i in range(60)], SCHEMA).repartition(2), f"file://{tmp_path}/w")
    x = warc.ranges(spark, f"file://{tmp_path}/w", 20_000)
    n = x.count()
    assert n > 20 and x.rdd.getNumPartitions() == n
    used = x.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert used.count() > n / 2 and used.agg(F.max("count")).first()[0] <= 4
    assert warc.ranges(spark, f"file://{tmp_path}/w", 20_000, max_tasks=3).rdd.getNumPartitions() == 3


def test_broken_members_are_reported(spark, tmp_path):
    made = [warc.member(i, "u", random.Random(i).randbytes(9000), None) for i in range(3)]
    made[1] = made[1][:-3000] + b"\0" * 40 + made[1][-2960:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made) + warc.member(9, "u", b"z" * 90_000, None, 0)[:-50])
    read = lambda how: warc.read(spark, f"file://{tmp_path}", on_broken=how)
    at = len(made[0])
    assert [(r["type"], r["record_key"], r["position"]) for r in read("row").orderBy("position").collect()] == [
        ("response", "0", 0), ("broken", None, at), ("response", "2", at + len(made[1])), ("broken", None, sum(map(len, made))),
    ]
    assert sorted(r["record_key"] for r in read("skip").collect()) == ["0", "2"]
    with pytest.raises(Exception, match="broken record"):
        read("fail").collect()


def test_every_cut_owns_each_record_once():
    inner = b"".join(warc.member(f"in{i}", None, b"x", None) for i in range(3))  # magic inside a payload
    data = b"".join(warc.member(i, "u", p, None, level=0) for i, p in enumerate([b"a" * 50, inner, b"", warc.MAGIC * 9]))
    starts = [p for p, _ in warc.RangeScanner(io.BytesIO(data), 0, len(data))]
    assert len(starts) == 4
    noise = b"junk" + warc.MAGIC + b"more" + gzip.compress(b"no warc") + data
    assert [p - (len(noise) - len(data)) for p, _ in warc.RangeScanner(io.BytesIO(noise), 0, len(noise), block=64)] == starts
    plain = b"".join(warc.member(i, "u", b"ab" * i, None) for i in range(30))
    starts = [p for p, _ in warc.RangeScanner(io.BytesIO(plain), 0, len(plain))]
    for cut in range(1, len(plain), 13):
        both = [p for a, b in ((0, cut), (cut, len(plain))) for p, _ in warc.RangeScanner(io.BytesIO(plain), a, b, block=50)]
        assert both == starts


def test_long_record_gets_an_empty_member(spark, tmp_path):
    text = "y" * (17 << 20)
    warc.write(spark.createDataFrame([(1, None, text, None), (2, "u", "b", None)], SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    got = {r["record_key"]: r["payload_bytes"] for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert got == {"1": 17 << 20, "2": 1}


def test_url_of_a_megabyte(spark, tmp_path):
    noise = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(1 << 14))
    rows = [(1, "http://x/?" + noise, "a", None), (2, "data:," + "y" * (1 << 20), "b", None), (3, "u", "c", None)]
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    for size in (100_000, 1 << 25):
        got = {int(r["record_key"]): r["target_uri"] for r in warc.read(spark, f"file://{tmp_path}/w", size).collect()}
        assert got == {i: u for i, u, _, _ in rows}


def test_revisits(spark, tmp_path):
    long, short = "é" * 500, "e" * 999
    rows = [(1, "u", long, None), (5, "v", long, None), (3, None, long, None), (5, "v", long, None), (None, "w", long, None), (7, "a", short, None), (8, "b", short, None), (9, "c", None, None), (10, "\r\nd", "", None)]
    warc.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    got = sorted((str(r["record_key"]), r["type"], r["refers_to_key"], r["payload_bytes"]) for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    assert got == sorted([("1", "revisit", "5", 1000), ("3", "revisit", "5", 1000), ("5", "response", None, 1000), ("5", "response", None, 1000), ("None", "revisit", "5", 1000), ("7", "response", None, 999), ("8", "response", None, 999), ("9", "response", None, 0), ("10", "response", None, 0)], key=str)


def test_empty_and_query(spark, sf):
    path = store.shared_path(spark, "empty")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0
    got = {r["page_id"]: r for r in queries.op1_warc(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert got[p["page_id"]]["payload_digest"] == hashlib.sha1((p["html"] or "").encode()).hexdigest()


@pytest.mark.parametrize("data", [b"", b"WARC/1.0\r\nA: b", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", b"HTTP/1.1\r\n\r\n"])
def test_headers_that_are_none(data):
    assert warc.parse_header(data) is None
