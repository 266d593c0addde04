import os

import __spark_entry__
import corpus_pipeline as cp
from pyspark.sql import functions as F
from tidemark.llm import langid, mixing, queries, store, toxicity

from tests.llm.test_packing import check
from tests.llm.test_signature_join import brute


def stage(name):
    return dict(cp.STAGES)[name]


def test_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxic_passages", "ngram_join", "mix_sources", "packing"]
    assert __spark_entry__.queries()["pipeline"] is cp.run


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    spoken = stage("language_id")(spark, docs, sf)
    assert spoken.columns == docs.columns
    found = {r["doc_id"]: r for r in langid.identify(docs, queries.learn_languages(docs)).collect()}
    with_letters = {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in spoken.collect()} == {i for i in with_letters if found[i]["score"] >= cp.LEAST_LANGUAGE_SCORE} == with_letters

    spoken.write.parquet(f"{tmp_path}/1")
    spoken = spark.read.parquet(f"{tmp_path}/1")
    clean = stage("toxic_passages")(spark, spoken, sf)
    model = queries.learn_toxicity(spoken, queries.table(spark, sf, "labels"))
    scorer = toxicity.Scorer(model)
    keep = {i for i, r in rows.items() if model.probability(scorer.passages(r["text"])[0]) < 0.7}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == keep & {r["doc_id"] for r in spoken.collect()}

    clean.write.parquet(f"{tmp_path}/2")
    clean = spark.read.parquet(f"{tmp_path}/2")
    single = stage("ngram_join")(spark, clean, sf)
    kept = sorted(r["doc_id"] for r in single.collect())
    assert single.columns == docs.columns and kept == sorted({c for _, _, c in brute([(r["doc_id"], r["text"]) for r in clean.collect()])})

    single.write.parquet(f"{tmp_path}/3")
    single = spark.read.parquet(f"{tmp_path}/3")
    mixed = stage("mix_sources")(spark, single, sf)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    out = mixed.collect()
    assert mixed.columns == docs.columns and sorted(r["doc_id"] for r in out) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(r == rows[r["doc_id"]] for r in out)

    renumbered = [r["text"] for r in out]
    numbered = spark.createDataFrame(list(enumerate(renumbered)), "doc_id long, text string")
    check(stage("packing")(spark, numbered, sf).collect(), renumbered)


def test_language_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit("Ωξψ ζθφ ъыэ щюя 漢字 " * 40)).withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in stage("language_id")(spark, docs.unionByName(strange), sf).collect()}
    assert -1 not in kept and len(kept) >= docs.filter("lang is not null and length(text) > 20").count()
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stage("language_id")(spark, unknown, sf).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_run_deletes_what_it_wrote(spark, sf):
    made = []
    opened = store._NAMED.set((made,))
    try:
        assert cp.run(spark, sf).count() > 0
    finally:
        store._NAMED.reset(opened)
    left = [p for p in made if os.path.exists(p.removeprefix("file://"))]
    assert len(made) > 10 and [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left] == ["pipeline-mix_sources"]


def test_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat of the and", "en", None, 3), (1, "the cat of the and", "en", None, 3), (2, None, None, None, None), (None, "a b", None, "s", 1), (3, "12", "en", "s", 2), (4, "THE cat of the and", "en", "s", 2)]
    docs = spark.createDataFrame(rows, schema)
    expected = [4, 4, 2]
    for (_, f), n in zip(cp.STAGES[:3], expected, strict=True):
        docs = f(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == n
    for frame in (docs, docs.limit(0)):
        for _, f in cp.STAGES[3:]:
            frame = f(spark, frame, sf)
        frame.collect()
    for _, f in cp.STAGES[:3]:
        assert f(spark, docs.limit(0), sf).count() == 0
