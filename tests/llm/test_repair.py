import hashlib
import itertools
import random
import zlib

from tidemark.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, present string"


def all_repairs(turns):
    """Every sequence of edits of few turns with at most len + 2 insertions: (cost, audit, initials)."""
    n, found = len(turns), []
    grow = lambda at, left: [("I" + a, c + 3, r + x) for r in "ua" for a, c, x in ways(at, left - 1)] if left else []

    def ways(at, left):
        out = grow(at, left)
        if at == n:
            return [*out, ("", 0, "")]
        initial, fault = turns[at]
        for a, c, x in ways(at + 1, left):
            out.append(("D" + a, c + 4, x))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                out.append(("K" + a, c + more, initial + x))
                out += [("R" + a, c + more + 3, r + x) for r in "ua"]
        return out

    for a, c, x in ways(0, 2 + n // 2):
        rest = x[1:] if x[:1] == "s" else x
        if not x or (rest and rest == "ua" * (len(rest) // 2)):
            found.append((c, a))
    return min(found)


def test_search_against_all_sequences_of_edits():
    faults = (None, "blank", "duplicate", "truncated")
    for n in range(3):
        for turns in itertools.product(itertools.product("sua?", faults), repeat=n):
            assert repair.cheapest_edits(turns) == all_repairs(turns), turns
    rng = random.Random(3)
    for _ in range(150):
        turns = [(rng.choice("sua?"), rng.choice(faults)) for _ in range(rng.randint(3, 5))]
        assert repair.cheapest_edits(turns) == all_repairs(turns), turns


def plain(turns):
    """Best (cost, edits) by turn and state, one turn after the other."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        for _ in range(4):
            for q, (c, e) in list(best.items()):
                for r in set("ua") & step[q].keys():
                    best[step[q][r]] = min(best.get(step[q][r], (9e9, "")), (c + 3, e + "I"))
        return best

    best = inserted({"": (0, "")})
    for initial, fault in turns:
        new = {}
        for q, (c, e) in best.items():
            options = [(q, c + 4, "D")]
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                options += [(step[q].get(initial), c, "K")] * (initial in step[q])
                options += [(step[q][r], c + 3, "R") for r in set("ua") & step[q].keys()]
            for to, cost, edit in options:
                new[to] = min(new.get(to, (9e9, "")), (cost, e + edit))
        best = inserted(new)
    return min(best[q] for q in ("", "a") if q in best)


def test_blocks_give_what_one_search_gives():
    rng = random.Random(4)
    for _ in range(60):
        turns = [(rng.choice("uausu?"), rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 60))]
        want = plain(turns)
        assert all(repair.cheapest_edits(turns, block) == want for block in (1, 2, 7, 16, 256))
    many = [("ua"[i % 2] if rng.random() < 0.9 else "s", None) for i in range(4000)]
    assert repair.cheapest_edits(many) == plain(many)


def expect(rows):
    """The contract's columns of whole conversations, row by row; rows: (conv_id, turn, role, text)."""
    out, by_conv = {}, {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, own in by_conv.items():
        after = []
        for _, turn, role, text in own:
            shown = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
            role, text = (" " if role is None else role), (" " if text is None else text)
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            role = "user" if kind == 4 else role
            after += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = {t for t, _, _ in after if t is not None}
        turns, seen = [], []
        for _, role, text in after:
            bare = text.strip("\t\n\x0b\x0c\r ")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.append((role, text))
            turns.append((role[:1], fault))
        cost, audit = plain(turns)
        left, kept = iter(after), []
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e != "D":
                kept.append((role if e == "K" else "assistant" if kept and kept[-1][0][0] == "u" else "user", text))
        count = lambda f: sum(x == f for _, x in turns)  # noqa: B023, E731
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in itertools.pairwise(turns))
        said = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def run(spark, rows, block=repair.BLOCK):
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    found = repair.repair(repair.damage(d), present_col="present", block=block)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    out = {}
    for r in found.collect():
        said = "\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"])
        assert r["conv_id"] not in out
        out[r["conv_id"]] = (*tuple(r)[1:8], hashlib.sha256(said.encode()).hexdigest())
    return out


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf).collect()}
    assert got == expect(rows)


def test_odd_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [
        (1, 0, "user", "Hi."), (1, 1, None, None), (1, 1, "assistant", "Hi."), (1, None, "user", "First!"), (1, None, "user", "First!"),
        (None, 3, "user", "x"), (None, None, None, None), (gone, 0, "user", "Dropped."), (3, 5, "tool", "What?"), (3, 9, "", "."),
        (4, 2, "assistant", " \t\x0b. "), (4, 2, "assistant", " \t\x0b. "), (4, -2**40, "system", "\u2003"), (5, 1, "user", "long " * 200_000),
        (5, 2, "assistant", "b" * 1_000_000 + "."), (6, 0, "User", "A."), (6, 1, "Assistant", "B."),
    ]
    rng = random.Random(8)
    rows += [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"Then {t}.", f"so {t}", ""])) for t in range(700)]
    want = expect(rows)
    assert run(spark, rows) == want == run(spark, rows, block=5)
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert run(spark, []) == {}
