import random
import re

import numpy as np
import pytest
from tidemark.llm import shingles, signature_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, component string"


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(11), []
    passage = [f"p{i}" for i in range(60)]
    for i in range(120):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 4, 6, 9, 40, 200, 500]))]
        if i % 3 == 0:
            words += passage
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            rows.append(" ".join(edited(rng, words, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05]))))
    base = [f"h{rng.randrange(4000)}" for _ in range(250)]
    rows += [" ".join(edited(rng, base, 0.015)) for _ in range(150)]
    rows += [rows[-1].upper()] * 3 + [None, "", " \t\n", "a\x0bB c", "A b\x0cC", "a b c", "É x y z w", "é x y z w"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


def as_df(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [512, 7])
def test_against_brute_force(spark, corpus, block_rows):
    got = signature_join.near_duplicates(as_df(spark, corpus), block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == sorted(brute(corpus))


def test_sets_are_the_brute_sets(corpus):
    for _, text in corpus:
        assert len(shingles.shingle_set(text)) == len(brute_set(text))
    a, b = "x " * 3 + "the cat sat on a mat", "one two the cat sat on a mat"
    assert len(np.intersect1d(shingles.shingle_set(a), shingles.shingle_set(b))) == len(brute_set(a) & brute_set(b)) == 2


def test_traversal_drops_no_link(corpus):
    sets = {i: s for i, t in corpus if len(s := shingles.shingle_set(t))}
    members = [(i, len(s), shingles.bitmap(s), i, 0) for i, s in sets.items()]
    found = {frozenset(p) for p in signature_join.group_pairs(members, 80)}
    linked = {
        frozenset((i, j)) for i in sets for j in sets if i < j and len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j]))
    }
    assert linked <= found and len(found) < len(sets) * (len(sets) - 1) / 4
    sides = [(*m[:4], m[0] % 2) for m in members]
    across = {frozenset(p) for p in signature_join.group_pairs(sides, 80)}
    assert {p for p in linked if len({x % 2 for x in p}) == 2} <= across and all(len({x % 2 for x in p}) == 2 for p in across)


def test_miss_probability():
    b = shingles.BandKeys(0.8)
    assert (1 - 0.8**b.rows) ** b.bands <= shingles.MISS


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (9, None), (3, "")]
    got = signature_join.near_duplicates(as_df(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9), (3, 0, 3)], key=str)
    assert signature_join.near_duplicates(as_df(spark, [])).count() == 0


def test_one_of_each_goes_by_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (3, long), (5, "alone and never said before now"), (5, long + " more"),  # id 5: one text of its own, one near copy of 3's
        (None, "no id at all here either"), (None, "no id at all here either"), (None, long), (8, None), (8, ""), (8, ""), (None, " "), (9, long.upper()), (3, long),
    ]
    df = spark.createDataFrame([(i, t, {"k": str(n)}) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra map<string,string>")
    got = signature_join.one_of_each(df)
    assert got.columns == df.columns
    want = [(3, long), (5, "alone and never said before now"), (8, None), (8, ""), (8, ""), (None, "no id at all here either"), (None, " ")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert next(r["extra"] for r in got.collect() if r["doc_id"] == 3) == {"k": "0"}
    assert signature_join.one_of_each(df.limit(0)).count() == 0
