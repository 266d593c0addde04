import zlib
from collections import defaultdict

import numpy as np
import pytest
from tidemark.llm import packing, queries

SCHEMA = "doc_id long, text string, start string"


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


ODD = ["It's we'll, (a) don't 12,5 x..y!? Ünïcode ÇA İstanbul ΣΑΣ été 日本語 a b", "<|endoftext|> in\x1ctext", "", None, "a" * 3000, "x" * 60 + ".", "word " * 9000, ",", "ab, ab. ab,. 'S 'tis"]


def test_cached_ids_are_the_tokenizers_ids():
    got = packing.WordCachedTokenizer(queries.tokenizer_path(), 2, max_words=50)(ODD * 2)
    assert [x.tolist() for x in got] == reference_ids(ODD * 2)


def check(rows, texts):
    ids = {i: np.array(x, "<u4") for i, x in enumerate(reference_ids(texts))}
    spans, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        spans[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own, total in ((spans, None), (windows, 4096)):
        for key, parts in own.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == len(ids[key]) if total is None else at <= 4096
            assert total is None or at == 4096 or at & (at - 1) == 0
    assert set(spans) == set(ids)


def test_round_trip(spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    check(packing.pack(df, queries.tokenizer_path()).collect(), texts)
    check(packing.pack(df, queries.tokenizer_path(), max_open=3).collect(), texts)


def test_level_choice_is_the_smallest_sum_of_squares():
    rng, capacity = np.random.default_rng(3), 40
    packer = packing.SumOfSquaresPacker(capacity, 10_000)
    for n in range(600):
        size, before = int(rng.integers(1, capacity)), packer.count.copy()

        def after(level, size=size, before=before):
            x = before.copy()
            if level:
                x[level] -= 1
            if level + size < capacity:
                x[level + size] += 1
            return (x**2).sum()

        options = [0, *(h for h in range(1, capacity - size + 1) if before[h])]
        list(packer.add(n, np.zeros(size, "<u4")))
        assert (packer.count**2).sum() == min(map(after, options))


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(7, "a", "b"), (7, "a", "b")]])
def test_edges(spark, rows):
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), queries.tokenizer_path(), with_ids=True).collect()
    assert len(got) >= len(rows) and sum(r["length"] for r in got) == sum(len(r["ids"]) for r in got)


def test_waiting_pieces_hold_themselves_alone():
    packer = packing.SumOfSquaresPacker(40)
    assert len(list(packer.add(0, np.zeros(1010, "<u4")))) == 25
    assert [p[2].base is None and len(p[2]) for windows in packer.open for w in windows for p in w] == [10]
