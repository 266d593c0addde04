import random

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import langid, queries


def grams(text):
    return set(langid.presence(text).tolist())


def test_presence_is_all_ngrams():
    whole = grams("Grüße 12 an Élodie")
    assert whole == grams("GRÜSSE".replace("SS", "ß") + " -- an élodie")
    assert len(grams("ab")) == 3 + 3 + 2 + 1 and grams("ab") < grams("ab abc")


def test_a_very_long_text_is_its_pieces_and_not_saturated(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(300_000))
    whole = grams(text)
    monkeypatch.setattr(langid, "_PIECE", 1000)
    assert grams(text) == whole and len(whole) < (1 << langid.BITS) / 8


def plain_scores(texts, landmarks, fit_texts, labels, ridge):
    """Kernel ridge regression with Nyström features from sets of n-grams, one value at a time."""
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    matrix = lambda xs: np.array([[k(grams(x), grams(m)) for m in landmarks] for x in xs])
    values, vectors = np.linalg.eigh(matrix(landmarks))
    kept = values > 1e-8 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    x, y = matrix(fit_texts) @ whiten, np.where(np.array(labels)[:, None] == np.array(sorted(set(labels))), 1.0, -1.0)
    xm, ym = x.mean(0), y.mean(0)
    beta = np.linalg.solve((x - xm).T @ (x - xm) + ridge * len(labels) * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return (matrix(texts) @ whiten - xm) @ beta + ym


def test_results_against_a_plain_version(spark, sf):
    """All texts teach, so the plain version knows the sample; landmarks are those with the smallest hashes."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").select("doc_id", "text", "lang").limit(60)
    docs = spark.createDataFrame(rows.collect(), rows.schema)
    known = [r for r in docs.withColumn("o", F.xxhash64("doc_id", "text")).collect() if any(c.isalpha() for c in r["text"] or "")]
    known.sort(key=lambda r: (r["lang"], r["o"]))
    landmarks = [r["text"] for lang in sorted({r["lang"] for r in known}) for r in [x for x in known if x["lang"] == lang][:3]]
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs, landmarks_per_class=3, ridge=1e-2)).collect()}
    want = plain_scores([r["text"] for r in known], landmarks, [r["text"] for r in known], [r["lang"] for r in known], 1e-2)
    classes, held = sorted({r["lang"] for r in known}), {c for t in landmarks for c in t.lower() if c.isalpha()}
    for r, s in zip(known, want, strict=True):
        own = [c for c in r["text"].lower() if c.isalpha()]
        score = min(1, max(0, (s.max() + 1) / 2)) * sum(c in held for c in own) / len(own)
        assert got[r["doc_id"]]["lang_pred"] == classes[s.argmax()] and abs(got[r["doc_id"]]["score"] - score) < 1e-4


def test_repeated_ids_bound_the_sample(spark):
    rows = [(7, f"the of and {i % 9}", "en") for i in range(3000)] + [(i, "der die das", "de") for i in range(20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_per_class=50, landmarks_per_class=5)
    assert model.classes == ["de", "en"]


def test_held_out_accuracy(spark, sf):
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, sf).join(lang, "doc_id")
    row = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row["n"] > 20 and row["a"] > 0.9


def test_edges(spark):
    df = spark.createDataFrame([(1, "der die das", "de", "x"), (2, None, "de", "x"), (3, "12 !", None, "x"), (4, "the of and", "en", "x"), (4, "the of and", "en", "x"), (None, "der", None, None)], "doc_id long, text string, lang string, lang_pred string")
    model = langid.learn(df)
    got = langid.identify(df, model).collect()
    assert [r["lang_pred"] for r in got] == ["de", "und", "und", "en", "en", "de"]
    assert got[1]["score"] == 0 and got[3]["score"] > 0.5 and abs(got[3]["score"] - got[4]["score"]) < 1e-5
    assert langid.learn(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
