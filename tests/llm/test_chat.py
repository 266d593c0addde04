import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, window string, loss string"
PIECES = ["\\", "#", "###", "</turn>", "<", "/turn>", "\n", ":\n", "### user:\n", "<|", "<|endoftext|>", "|", "é", "𝄞", "a", " "]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=4))
def test_texts_come_back(said):
    turns = [chat.as_turn(role, text, len) for role, text in said]
    for turn, (_, text) in zip(turns, said, strict=True):
        assert "##" not in turn.body and "</turn>" not in turn.body and "<|" not in turn.body
        assert chat.unescape(turn.body) == text
    text, _ = chat.render(chat.Window(turns, 0))
    assert [(role, chat.unescape(text[a:b])) for role, a, b in chat.parse(text)] == said


def test_what_is_not_made_of_turns_is_an_error():
    good = chat.as_turn("user", "x", len).text
    for bad in ("x", good + "x", good[:-1], good[1:]):
        with pytest.raises(ValueError):
            list(chat.parse(bad))


def make(spec):
    return [chat.Turn({"s": "system", "u": "user", "a": "assistant"}[c], "h", f"{k}{c}", size) for k, (c, size) in enumerate(spec)]


def test_windows_by_hand():
    turns = make([("s", 10), ("u", 10), ("a", 30), ("u", 10), ("a", 40), ("u", 5), ("a", 20), ("u", 5)])
    got = [("".join(t.body for t in w.turns), w.repeated) for w in chat.windows(turns, 100, 20)]
    # 90 places beside the system turn; turn 5 would fit but waits for its answer; of the turns before none is under 20.
    assert got == [("0s1u2a3u4a", 0), ("0s5u6a7u", 1)]
    got = [("".join(t.body for t in w.turns), w.repeated) for w in chat.windows(turns, 76, 45)]
    # Turns 3 and 4 leave no place for history. Turn 4 is repeated before 5 and 6, so 7 doesn't fit; it has 5 and 6 before it.
    assert got == [("0s1u2a", 0), ("0s3u4a", 1), ("0s4a5u6a", 2), ("0s5u6a7u", 3)]


def test_windows_keep_every_turn_once_and_the_budget():
    rng = random.Random(1)
    for _ in range(500):
        spec = [(rng.choice("uua" if k else "sua"), rng.choice([1, 5, 20, 60, 130])) for k in range(rng.randint(1, 30))]
        turns, budget, history = make(spec), 100, rng.choice([0, 20, 99])
        seen = list(chat.windows(turns, budget, history))
        assert [t for w in seen for t in w.turns[w.repeated :]] == turns
        has_system = turns[0].role == "system"
        done = 0
        for k, w in enumerate(seen):
            new = w.turns[w.repeated :]
            total = sum(t.tokens for t in w.turns)
            again = w.turns[has_system : w.repeated] if k else []
            assert not has_system or w.turns[0] == turns[0]
            assert again == turns[done - len(again) : done] and sum(t.tokens for t in again) <= history
            assert total <= budget or (len(new) - (has_system and not k) <= 1 and not again)
            if k + 1 < len(seen) and any(t.role == "assistant" for t in new):
                assert new[-1].role == "assistant"
            done += len(new)


def expect(rows):
    out, by_conv = {}, {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, own in by_conv.items():
        own = sorted(((t, r or "", x or "") for _, t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        target = "".join(x for _, r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    return out


def digests(found):
    rows = found.collect()
    out = {r["conv_id"]: tuple(r)[1:5] for r in rows}
    assert len(out) == len(rows)
    return out


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = queries.op11_chat_windows(spark, sf)
    assert digests(found) == expect(rows)
    assert all(r["formatted_chars"] > 0 and r["n_windows"] > 0 for r in found.collect())


def test_odd_rows_windows_and_storage(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(["some", "words", "###", "</turn>", "\\n"], k=rng.randint(0, 40)))) for t in range(300)]
    rows += [(1, -1, "system", "Be ### kind.")] + [(2, 0, "assistant", None), (2, 0, None, "x"), (2, None, "assistant", "first"), (2, None, "assistant", "first")]
    rows += [(None, 4, "assistant", "𝄞 end"), (3, 1, "assistant", "word " * 100_000), (3, 2, "user", "<|endoftext|>"), (4, 0, "system", "alone"), (5, 0, "a:\nb\\", "")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    windows = chat.format_conversations(docs, queries.tokenizer_path(), budget=200, history=60)
    assert digests(chat.read_back(windows, in_place=True)) == expect(rows)
    windows.repartition(5, "text").write.parquet(f"{tmp_path}/w")
    stored = spark.read.parquet(f"{tmp_path}/w")
    assert digests(chat.read_back(stored)) == expect(rows)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    repeats = 0
    for r in stored.collect():
        assert r["tokens"] == len(tokenizer.encode(r["text"], add_special_tokens=False).ids)
        assert r["over_budget"] == (r["tokens"] > 200) and (not r["over_budget"] or r["conv_id"] in (1, 3))
        if r["conv_id"] == 1:
            roles = [role for role, _, _ in chat.parse(r["text"])]
            assert roles[0] == "system" and len(r["loss"]) == roles[r["repeated"] :].count("assistant")
            repeats += r["repeated"] > 1
    assert repeats > 20


def test_empty_table(spark):
    windows = chat.format_conversations(spark.createDataFrame([], SCHEMA), queries.tokenizer_path())
    assert chat.read_back(windows, in_place=True).count() == 0 == chat.read_back(windows).count()
