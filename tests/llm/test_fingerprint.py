import hashlib
import itertools
import random
import string
import struct
from collections import Counter

import xxhash
from tidemark.llm import fingerprint as f

SCHEMA = "doc_id long, text string, sig string, next_text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<q", p) if isinstance(p, int) else struct.pack("<i", p[0])
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain_tokens(text):
    unspaced = lambda c: 0xE00 <= ord(c) <= 0x109F or 0x1780 <= ord(c) <= 0x17FF or ord(c) >= 0x2000
    cut = lambda c: c in "fkpwxzFKPWXZ06ÆÌÒØÞäêðöü" + string.punctuation
    letter = lambda c: not unspaced(c) and not cut(c) and c not in " \t\n\x0b\f\r"
    out, i = [], 0
    while i < len(text):
        n = len(list(itertools.takewhile(letter, text[i : i + 24])))
        if unspaced(text[i]):
            out.append("".join(itertools.takewhile(unspaced, text[i : i + 3])))
        elif n == 24:
            out.append(text[i : i + 3])
        elif n or cut(text[i]):
            out.append(text[i : i + n] + (text[i + n] if i + n < len(text) and cut(text[i + n]) else ""))
            i += len(out[-1]) - 1
        i += 1
    return out


def brute(text, sketches=64, size=2):
    """Number, hash, select, put back in order and hash again, one after the other."""
    tokens = plain_tokens(text)
    padded = tokens + [""] * max(0, 4 - len(tokens)) if tokens else []
    kmers = [xx(*padded[i : i + 4]) for i in range(len(padded) - 3)] if tokens else []
    seen, elements = Counter(), {}
    for at, h in enumerate(kmers):
        top = h >> 26
        mixed = xx(top, (seen[top],))
        seen[top] += 1
        elements.setdefault((mixed & ((1 << 64) - 1)) >> 58, []).append((mixed >> 26, at))
    out = [0] * sketches
    for sketch, own in elements.items():
        chosen = sorted(at for _, at in sorted(own)[:size])
        out[sketch] = max(1, xx(",".join(str(kmers[at] >> 26) for at in chosen)) & 0xFFFFFFFF)
    return out


def like(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, cut = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = brute(t), brute(edited), brute(nxt)
        text = ["".join(f"{x:08x}" for x in s) for s in (a, b)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *text, like(a, b), like(a, c)))
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA).repartition(3)
    got = f.fingerprint_edits(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_documents(spark, sf):
    compare(spark, [(r["doc_id"] * 7 - 300, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()])


def test_edges(spark):
    compare(spark, [(5, "a b a b a b a b c " * 40), (9, None), (1, ""), (3, " \n"), (3, "𝒳éñ日" * 90), (3, "x y"), (11, "a" * 23 + " " + "b" * 24 + "," + "c" * 25 + "k" + "d" * 60), (12, "A" * 26 + "日" + "acgt" * 30 + "f" + "a" * 23 + "z"), (None, "one"), (None, "a b"), (7, "z"), (7, "z"), (2, "a " * 3000)])
    compare(spark, [(4, "only one"), ])
    compare(spark, [(None, "u v w"), (None, "x")])
    assert f.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_successors_over_many_buckets(spark):
    rng = random.Random(3)
    ids = [rng.randrange(10**12) for _ in range(500)] + [17, 17, 17]
    df = spark.createDataFrame([(i, str(n)) for n, i in enumerate(ids)], "doc_id long, text string")
    got = f.with_next(df, "doc_id", ["text"], rows_per_bucket=20).collect()
    order = sorted(((i, str(n)) for n, i in enumerate(ids)), key=lambda r: (-r[0], r[1]))
    assert {r["text"]: r["next_text"] for r in got} == {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))} and len(got) == len(ids)


def test_bounds_in_blocks(spark):
    known = [x * 3 for x in range(1000, 0, -1)]
    df = spark.range(0, 3100, 7)
    got = df.select("id", f.bounds_from(known, f.F.col("id"), fan=16).alias("n")).collect()
    assert all(r["n"] == sum(b >= r["id"] for b in known) for r in got)


def test_one_inserted_character_keeps_the_likeness(spark):
    rng = random.Random(8)
    texts = {
        "words": " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(500)),
        "ascii": "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=3000)),
        "lower": "".join(rng.choices(string.ascii_lowercase, k=3000)),
        "cjk": "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000)),
        "thai": "".join(chr(rng.randrange(0xE01, 0xE2E)) for _ in range(3000)),
        "emoji": "".join(chr(rng.randrange(0x1F600, 0x1F640)) for _ in range(3000)),
        "acgt": "".join(rng.choices("acgt", k=3000)),
        "capitals": "".join(rng.choices("ABCDEGHIJLMNOQ", k=3000)),
        "cyrillic": "".join(chr(rng.randrange(0x410, 0x450)) for _ in range(3000)),
        "one": "a" * 3000,
    }
    rows = [(n, how, {"same": t, "front": "q" + t, "own": t[0] + t, "middle": t[:1500] + "日" + t[1500:]}[how]) for n, t in texts.items() for how in ("same", "front", "own", "middle")]
    got = {(r["name"], r["how"]): r["sig"] for r in spark.createDataFrame(rows, "name string, how string, text string").withColumn("sig", f.signature(f.F.col("text"))).collect()}
    for name in texts:
        assert all(like(got[name, "same"], got[name, how]) > 0.85 for how in ("front", "own", "middle")), name
        assert like(got[name, "same"], got["words" if name != "words" else "cjk", "same"]) < 0.1


def test_order_matters(spark):
    words = [f"word{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    rng = random.Random(1)
    shuffled = [w for i in range(0, 400, 2) for w in (words[i + 1], words[i])]
    rows = [("same", words), ("swapped", swapped), ("shuffled", shuffled), ("changed", [w if rng.random() < 0.97 else "x" for w in words])]
    df = spark.createDataFrame([(n, " ".join(w)) for n, w in rows], "name string, text string").withColumn("sig", f.signature(f.F.col("text")))
    sig = {r["name"]: r["sig"] for r in df.collect()}
    assert like(sig["same"], sig["shuffled"]) < 0.1 < like(sig["same"], sig["swapped"]) < 0.95 and like(sig["same"], sig["changed"]) > 0.6
