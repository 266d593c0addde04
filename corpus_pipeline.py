"""A training corpus from ``documents``: language, toxicity, near duplicates, mix, packing.

Each stage takes the documents its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, queries, signature_join, store, toxicity


#: The least score of the best language: half of it and less means that every class is denied. All documents of the
#: test tables that have a language score over 0.3.
LEAST_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts in no language: null, empty or without a letter, or with a best score below LEAST_LANGUAGE_SCORE.

    Where no row has a language to learn from, only texts without a letter go. Rows are judged one by one:
    repeated rows alike, very long texts whole.
    """
    model = queries.learn_languages(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(named), model)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts whose score reaches 0.7. Null and empty texts have the score of no passage; repeated rows are judged
    alike, very long texts whole."""
    model = queries.learn_toxicity(docs, queries.table(spark, sf_dir, "labels"))
    named = {c: f"_own_{c}" for c in ("score", "statistic", "passages") if c in docs.columns}
    kept = toxicity.score(docs.withColumnsRenamed(named), model).filter(F.col("score") < 0.7)
    return kept.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: that with the smallest id, of equal ids that with the least hash.

    Rows are grouped, not ids: different texts under one id stay if they aren't linked, and rows without an id
    that are copies go. Rows without words are linked with nothing and stay. A very long text is compared whole.
    """
    return signature_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns.

    Null and empty texts have size 0 and take copies like others; a null source is a source of its own; repeated rows
    are separate documents, and a document's copies are equal rows.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows; a null or empty text is the end id alone, repeated rows are packed each, and texts of any
    length are cut into windows."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("toxic_passages", toxic_passages),
    ("ngram_join", ngram_join),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Tokens and trained models are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; a stage's tables are deleted once the next one's input is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = store.shared_path(spark, f"pipeline-{name}")
        with store.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            store.delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
