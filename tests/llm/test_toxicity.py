import math
import random

import numpy as np
import pytest
from tidemark.llm import queries, toxicity


def brute(values):
    """Maximal segments by definition, recursively: the best segment, then both sides of it."""
    best = max(((sum(values[i:j]), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), key=lambda x: (x[0], x[1] - x[2]), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, i, j = best
    return brute(values[:i]) + [(i, j - 1, s)] + [(a + j, b + j, t) for a, b, t in brute(values[j:])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        values = [rng.choice([-0.5, -rng.randint(1, 40) / 19, rng.randint(1, 90) / 17]) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments_of(np.array(values))
        expected = brute(values)
        assert [g[:2] for g in got] == [e[:2] for e in expected] and np.allclose([g[2] for g in got], [e[2] for e in expected])


def test_lambda():
    p, s = np.array([0.01, 0.002, 0.988]), np.array([2.0, 5.0, -0.5])
    lam = toxicity.solve_lambda(p, s)
    assert abs((p * np.exp(lam * s)).sum() - 1) < 1e-6 and lam > 0.01


def words(rng, n):
    return [f"w{int(rng.expovariate(0.02))}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        w = words(rng, rng.randint(5, 80))
        toxic = i % 6 == 0
        if toxic:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choices(["vile", "scum", "trash"], k=3)
        rows.append((i, " ".join(w), "clash", 1.0))
        if i < 480:
            labels.append((i, 1 - int(toxic), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, h double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_passages(planted):
    docs, labels = planted
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= 0.7) == (i % 6 == 0) for i in range(480, 600))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in range(480, 600, 6):
        found = [text[i][p["start"] : p["end"]] for p in got[i]["passages"]]
        assert any({"vile", "scum", "trash"} & set(f.split()) for f in found)


def model_of(scores):
    model = toxicity.ToxicityModel()
    for w, x in scores.items():
        model.scores[toxicity.place(w)] = x
    return model


def test_every_occurrence_scores():
    bad = [f"bad{i}" for i in range(6)]
    scorer, fill = toxicity.Scorer(model_of(dict.fromkeys(bad, 3.0))), ["fine"] * 200
    _, two = scorer.passages(" ".join([*fill, *bad, *fill, *bad, *fill]))
    assert np.allclose([p["score"] for p in two], 18.0) and len(two) == 2
    alone = [x for w in bad for x in (w, *fill)]
    text = " ".join([*alone, *bad, *fill])
    _, late = scorer.passages(text)
    assert [(text[p["start"] : p["end"]], round(p["score"], 9)) for p in late] == [(" ".join(bad), 18.0)]
    _, near = scorer.segments(" ".join([*bad, *fill[:10], *bad]))
    assert [(a, b, round(x, 9)) for a, b, x in near] == [(0, 21, 22.0)]  # 18 - 5 + 9: repeats inside one segment count half
    _, same = scorer.segments("bad1 " * 500)
    assert max(s for *_, s in same) < 6.001


def test_all_tokens_score_their_log_odds():
    scorer = toxicity.Scorer(model_of({"bad": 3.0, "good": -1.5}))
    assert scorer.values(["BAD", "Good", "other"]).tolist() == [3.0, -2.0, -0.5]
    assert [s[:2] for s in scorer.segments("bad good good bad")[1]] == [(0, 0), (3, 3)]
    assert scorer.segments("bad other bad")[1][0][:2] == (0, 2)


def test_spans_are_places_in_the_text_as_it_is():
    text = "İİİ clean badword"
    _, found = toxicity.Scorer(model_of({"badword": 30.0})).passages(text)
    assert [text[p["start"] : p["end"]] for p in found] == ["badword"]


def test_whole_scores_against_a_plain_version():
    """Tokens, scores, segments by definition, damped repeats, expectations and the curve, one after the other."""
    rng, vocabulary = random.Random(6), [f"w{i}" for i in range(12)]
    scores = {w: round(rng.uniform(-2, 3), 3) for w in vocabulary}
    model = model_of(scores)
    model.lam, model.k, model.a, model.b = 1.1, 0.02, -3.0, 0.8
    value = lambda w: float(np.float32(scores[w])) - (toxicity.DRIFT if scores[w] <= 0 else 0)
    for _ in range(200):
        tokens = [rng.choice(vocabulary) for _ in range(rng.randint(0, 16))]
        found = []
        for first, last, s in brute([value(w) for w in tokens]):
            inside, seen, damped = tokens[first : last + 1], {}, []
            for w in inside:
                damped.append(value(w) * 0.5 ** seen.get(w, 0) if value(w) > 0 else value(w))
                seen[w] = seen.get(w, 0) + 1
            repeats = any(n > 1 and value(w) > 0 for w, n in seen.items())
            found += [x[2] for x in brute(damped)] if repeats else [s]
        expected = [math.log(model.k * max(1, len(tokens))) - model.lam * s for s in found]
        want = 1 / (1 + math.exp(-(model.a + model.b * sum(-e for e in expected if e < math.log(model.max_expected)))))
        assert math.isclose(model.probability(toxicity.Scorer(model).passages(" ".join(tokens))[0]), want, rel_tol=1e-9)


def test_edges(spark, planted):
    docs, labels = planted
    model = toxicity.learn(docs, labels.unionByName(labels.limit(50)))
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "VILE scum trash " + "w1 " * 9), (3, "!! " * 50000)], "doc_id long, text string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] == got[2]["score"] == got[4]["score"] < 0.5 < got[3]["score"]
    assert toxicity.learn(docs, labels.limit(0)).base == 0.0
    assert toxicity.learn(docs.limit(0), labels).base == 0.0


def test_query(spark, sf):
    got = queries.op3_toxicity(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 200


def test_no_training_text_is_lost_to_a_shared_id(spark):
    """Sources that count from 0 share ids; each text teaches once, whichever way rows are stored."""
    rows = [(7, f"toxic text {i}") for i in range(100)] + [(7, "toxic text 3"), (8, "toxic text 3"), (8, "fine"), (9, "fine"), (None, "no id"), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0), (9, 0), (10, 1), (None, 1), (11, 1), (8, None)], "doc_id long, toxic int")
    want = sorted([(f"toxic text {i}", 1) for i in range(100)] + [("toxic text 3", 0), ("fine", 0)])
    for parts in (1, 3, 8):
        got = toxicity.training_texts(docs.repartition(parts), labels, "doc_id", "text", "toxic").collect()
        assert sorted(map(tuple, got)) == want
