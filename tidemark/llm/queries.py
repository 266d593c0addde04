"""The catalogue's queries for these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, filter_audit, fingerprint, langid, mixing, packing, repair, signature_join, token_counts, toxicity, urlfilter, warc
from .store import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path, with_payload=False, on_broken="fail")
    return records.select(
        F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to_key").cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM q
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.learn(docs.filter(langid.crc_mod(F.col("doc_id"), 3) != 1), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs.select("doc_id", "text"), learn_toxicity(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", (langid.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.fit(docs, token_counts.ranked_model(tokenizer_path("piece_bpe_32k.model"))))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.RULES)


def learn_languages(docs: DataFrame) -> langid.KernelModel | None:
    return langid.learn(docs.filter(langid.crc_mod(F.col("doc_id"), 5) != 0))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), learn_languages(docs))
    return found.select("doc_id", (langid.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h,
         greatest(1, (count(*) OVER () + 8191) // 8192) AS n_buckets
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS full_at,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER p, 0)) /
         (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY source_size * 2.0::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         CASE WHEN full_at < level THEN cap
              ELSE w * (SELECT arg_min(level, full_at) FROM l WHERE NOT full_at < level) END AS target
  FROM l
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY h % n_buckets, size, h, doc_id) AS rnk FROM d
), c AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.rnk,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate,
         ('0x' || substr(md5('20:' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       least(floor(u + rate * rnk)::BIGINT - floor(u + rate * (rnk - 1))::BIGINT, 2) AS copies,
       least(floor(u + rate * rnk)::BIGINT - floor(u + rate * (rnk - 1))::BIGINT, 2) * size AS taken
FROM c
"""

def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows, tokenizer_path()), in_place=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(repair.damage(table(spark, sf_dir, "conversations")), present_col="present")
    turns = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(turns, "\n"), 256).alias("repaired_sha256")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), m AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         [len(words) < 100,
          100 * len(list_distinct(words)) < 80 * len(words),
          100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * len(w.text),
          regexp_matches(w.text, '[#$%&*|]'),
          coalesce(min(w.doc_id) OVER (PARTITION BY w.text) < w.doc_id, false)] AS fails
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id
), g AS (
  SELECT part, fails, len([x FOR x IN fails IF x]) AS n_fails, count(*) AS n, count(*) FILTER (good) AS good_n, count(*) FILTER (toxic) AS toxic_n
  FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT g.*, filter_order, step, ascii(filter_order[step]) - 64 AS own,
         coalesce(list_min([i FOR i IN [1, 2, 3, 4, 5] IF fails[ascii(filter_order[i]) - 64]]), 6) AS first
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
), r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails[own] AND first < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails[own] AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good_n) FILTER (first = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic_n) FILTER (first = step), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

QUERIES = {"op1_warc": op1_warc, "op3_toxicity": op3_toxicity, "op4_token_counts": op4_token_counts, "op5_url_filters": op5_url_filters, "op2_packing": op2_packing, "op6_language_id": op6_language_id, "op7_ann": op7_ann, "op8_fingerprints": op8_fingerprints, "op9_ngram_join": op9_ngram_join, "op10_mixing": op10_mixing, "op11_chat_windows": op11_chat_windows, "op12_conversation_repair": op12_conversation_repair, "op13_filter_audit": op13_filter_audit}
ORACLES = {"op1_warc": OP1_SQL, "op10_mixing": OP10_SQL, "op13_filter_audit": OP13_SQL}
