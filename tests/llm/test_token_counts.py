import math
import random
from collections import Counter

import numpy as np
from tidemark.llm import queries, token_counts
from tidemark.llm.token_counts import MARK, Segmenter, UnigramModel, WordCounts


def brute(word, pieces, byte_score, used=None, count=1):
    """Viterbi over one word by itself: tokens, and the pieces it uses."""
    word = MARK + word
    best = [(0.0, 0, ())] + [None] * len(word)
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + byte_score * size, best[end - 1][1] + size, (end - 1, "<byte>", size))]
        options += [(pieces[word[s:end]] + best[s][0], best[s][1] + 1, (s, word[s:end], 1)) for s in range(end) if word[s:end] in pieces]
        best[end] = max(options, key=lambda x: (x[0], -x[1]))
    at = len(word)
    while used is not None and at:
        at, piece, size = best[at][2]
        used[piece] += size * count
    return best[-1][1]


def test_trie_equals_viterbi_and_shares_prefixes():
    rng = random.Random(2)
    pieces = {"".join(rng.choices("ab▁é", k=rng.randint(1, 4))): -rng.random() * 9 for _ in range(60)}
    model = UnigramModel(list(pieces), np.array(list(pieces.values())), -30.0)
    words = list({"".join(rng.choices("abéz日😀", k=rng.randint(1, 12))) for _ in range(500)})
    counts = np.array([rng.randint(1, 9) for _ in words])
    segmenter, used, expected = Segmenter(model), np.zeros(len(pieces) + 1, np.int64), Counter()
    assert segmenter.segment_all(words, counts, used).tolist() == [brute(w, pieces, -30.0, expected, int(n)) for w, n in zip(words, counts, strict=True)]
    assert segmenter.computed == len({(MARK + w)[:i] for w in words for i in range(1, len(w) + 2)})
    assert {p: n for p, n in zip([*pieces, "<byte>"], used.tolist(), strict=True) if n} == dict(expected)
    alone = np.zeros_like(used)
    assert [segmenter.segment(w, int(n), alone) for w, n in zip(words, counts, strict=True)] == segmenter.segment_all(words).tolist() and (alone == used).all()
    small = WordCounts(model, max_words=20)
    assert small.count([words, words[:9], []]) == [sum(brute(w, pieces, -30.0) for w in x) for x in (words, words[:9], [])]
    assert small.count([["b" * 500, "a"]]) == [brute("b" * 500, pieces, -30.0) + brute("a", pieces, -30.0)]


def test_fitted_scores_are_shares_of_the_pieces_used(spark, sf):
    start = token_counts.ranked_model(queries.tokenizer_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40)
    docs = spark.createDataFrame([*[(r["text"],) for r in docs.collect()], ("日本龘 " + "x" * 90,), (None,)], "text string").repartition(3)
    used, pieces = Counter(), start.as_dict()
    words = Counter(w for r in docs.collect() for w in (r["text"] or "").split())
    for w, n in words.items():
        brute(w, pieces, start.byte_score, used, n)
    model = token_counts.fit(docs, start, flush_words=100)
    total = sum(used.values()) + len(pieces) + 1
    want = [math.log((used[p] + 1) / total) for p in start.pieces]
    assert np.allclose(model.scores, want) and abs(model.byte_score - math.log((used["<byte>"] + 1) / total / 256)) < 1e-9
    assert token_counts.fit(docs.limit(0), start) is start


def test_query_and_edges(spark, sf):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    start = token_counts.ranked_model(path)
    assert abs(np.exp(start.scores).sum() - 1) < 1e-6
    rows = [(1, "the " * 5, 3), (2, None, 1), (2, None, 1), (3, " \n", None), (None, "日本x" * 400, None), (4, "y" * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = token_counts.count_tokens(df, start).collect()
    assert [(r["n_words"], r["n_tokens"]) for r in got] == [(len((t or "").split()), sum(brute(w, start.as_dict(), -30.0) for w in (t or "").split())) for _, t, _ in rows]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted, texts = token_counts.fit(docs, start), {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = fitted.as_dict()
    for r in queries.op4_token_counts(spark, sf).limit(20).collect():
        assert r["n_tokens"] == sum(brute(w, pieces, fitted.byte_score) for w in texts[r["doc_id"]].split())
