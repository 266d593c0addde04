import os
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F
from tidemark.llm import filter_audit, queries

DOCS = "doc_id long, text string, lang string, source string, n int, part string, h string"
LABELS = "doc_id long, quality int, toxic int, n int"
LONG = " ".join(f"w{i}" for i in range(300))


def brute(docs, labels):
    """The five filters one after the other, document by document."""
    words = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, _ in docs:
        t = text or ""
        w = words(t)
        fails.append("".join(name for name, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t),
            i is not None and least[t] < i), strict=True) if bad))
    out, removed_by = {}, Counter()
    for part in {lang or "" for _, _, lang in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [k for k, d in enumerate(docs) if (d[2] or "") == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                out[part, order, step] = [
                    len(left), len(here), sum(f in fails[k] for k in gone), sum(fails[k] == f for k in gone + here + left),
                    sum(docs[k][0] in good for k in here), sum(docs[k][0] in toxic for k in here)]
                gone += here
                removed_by[part, f] += len(here)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, "s", 1, "x", "y") for i, t, lang in docs], DOCS).repartition(3)
    found = filter_audit.audit(d, spark.createDataFrame([(*x, 1) for x in labels], LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(got) == len(found)
    return got


def test_against_single_documents(spark):
    docs = [
        (1, "short", "en"), (2, "short", "de"), (2, "short", "en"), (3, None, "en"), (4, "", None), (5, "A B C$", "en"), (6, LONG, "en"),
        (7, LONG, "en"), (8, LONG + " w1" * 200, "en"), (9, LONG.upper(), "de"), (10, "é\u2003x\x0by #", None), (None, LONG, "en"), (None, LONG, "en"),
        (11, "word " * 50_000, "fr"), (6, LONG, "en"), (12, "ÀÉ 中文 " * 80, "fr"), (13, LONG, "de"), (14, "x" * 100_000 + "|", "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (5, None, 1), (6, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (13, 1, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_given_documents(spark, sf):
    docs = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in queries.table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    got = queries.op13_filter_audit(spark, sf).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == brute(docs, labels)


def test_sql(spark, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    got = queries.op13_filter_audit(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    got = run(spark, [(1, "a", "en")], [])
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_copies_are_summed_before_they_meet(spark):
    """A group of copies with many ids comes down to a row per part, label and task before the shuffle by text."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang")).repartition(4)
    r = filter_audit.flagged(d, spark.createDataFrame([], LABELS)).collect()
    assert sorted((x["E"], x["n"]) for x in r) == [(False, 1), (True, 19_999)]


def test_names_of_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.replay(spark.createDataFrame([], "part string"), ["long name"])
