"""Chat formatting into windows under a token budget.

A conversation's formatted turns have token counts; their prefix sums choose how many whole turns a window takes beside what
it repeats: the system turn, and as many of the turns before as ``history`` tokens and the place left by the next target
allow. A window ends behind an assistant's turn where it holds one. A new assistant text is a target; in repeated turns nothing is. So each assistant text
is under the loss mask once, whatever is repeated.

A turn is written ``### role:``, a new line, the text, ``</turn>`` and a new line. Backslashes keep control strings out of roles and texts:
one goes before a backslash, between neighbouring ``#``, and inside ``</turn>`` and ``<|`` (which begins the tokenizer's
special tokens). Dropping them gives every text back.

Turns stream through a task: it holds the turns of one window and the history, never a conversation.

Defined results: null roles and texts are empty; turns are ordered by number, nulls first, then by role and text; repeated rows are turns of their
own; only a first turn of role ``system`` is retained; a turn that doesn't fit beside the system turn has a window of
its own, without history and over the budget (``over_budget``), as turns are never cut; a null conversation id is a
conversation of its own; an empty table gives no windows. Columns that aren't named are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import WordCachedTokenizer
from .turns import conversations, in_order, results

SYSTEM, TARGET = "system", "assistant"
_OPEN, _SAID, _CLOSE = "### ", ":\n", "</turn>\n"
_CONTROL = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)|(?<=<)\|")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class Turn(NamedTuple):
    role: str
    head: str
    body: str
    tokens: int

    @property
    def text(self) -> str:
        return self.head + self.body + _CLOSE


class Window(NamedTuple):
    turns: list[Turn]
    repeated: int


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text) if "\\" in text or "##" in text or "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def as_turn(role: str, text: str, count: Callable[[str], int]) -> Turn:
    """Roles are escaped like texts, and their new lines too, as a new line ends the role."""
    head, body = _OPEN + escape(role).replace("\n", "\\\n") + _SAID, escape(text)
    return Turn(role, head, body, count(head + body + _CLOSE))


def windows(turns: Iterable[Turn], budget: int, history: int) -> Iterator[Window]:
    """Windows of at most ``budget`` tokens, of which at most ``history`` are repeated turns besides the system turn."""
    system, first = None, True
    waiting, sums, past = [], [0], []

    def close() -> Window:
        nonlocal system, first, waiting, sums, past
        room = budget - (system.tokens if system else 0)
        target = next((k for k, t in enumerate(waiting, 1) if t.role == TARGET), 1)
        needed = sums[target] if target < len(sums) and sums[target] <= room else waiting[0].tokens if waiting else 0
        left, kept = min(history, room - needed), len(past)
        while kept and past[kept - 1].tokens <= left:
            kept -= 1
            left -= past[kept].tokens
        again = past[kept:]
        n = max(1, bisect_right(sums, room - sum(t.tokens for t in again)) - 1)
        if n < len(waiting):
            n = next((k for k in range(n, 0, -1) if waiting[k - 1].role == TARGET), n)
        new, waiting = waiting[:n], waiting[n:]
        found = Window([*([system] if system else []), *again, *new], len(again) + (system is not None and not first))
        past, first, sums = past + new, False, [0]
        held = sum(t.tokens for t in past)
        while past and held > history:
            held -= past.pop(0).tokens
        for t in waiting:
            sums.append(sums[-1] + t.tokens)
        return found

    for at, turn in enumerate(turns):
        if at == 0 and turn.role == SYSTEM:
            system = turn
            continue
        waiting.append(turn)
        sums.append(sums[-1] + turn.tokens)
        # Without history the most fits: no window is closed while its turns may still be all that it takes.
        while waiting and sums[-1] > budget - (system.tokens if system else 0):
            yield close()
    while waiting or (first and system):
        yield close()


def render(window: Window) -> tuple[str, list[dict[str, int]]]:
    """A window's text and the spans (start, end) of its targets in code points."""
    parts, spans, at = [], [], 0
    for k, turn in enumerate(window.turns):
        if k >= window.repeated and turn.role == TARGET:
            start = at + len(turn.head)
            spans.append({"start": start, "end": start + len(turn.body)})
        parts.append(turn.text)
        at += len(parts[-1])
    return "".join(parts), spans


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """Each turn's role and where its escaped text begins and ends; an error where the text isn't made of turns."""
    at = 0
    while at < len(text):
        said = text.find(_SAID, at)
        end = text.find(_CLOSE, said + len(_SAID))
        if not text.startswith(_OPEN, at) or said < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        yield unescape(text[at + len(_OPEN) : said]), said + len(_SAID), end
        at = end + len(_CLOSE)


def format_conversations(rows: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows (conv_id, window, text, tokens, repeated, loss, over_budget), those of a conversation in one task and in order.

    ``repeated``: how many leading turns an earlier window has. ``loss``: spans of the text, in code points, that are targets.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    none = F.lit("")
    ordered = in_order(rows, rows[conv_col], rows[turn_col], F.coalesce(rows[role_col], none), F.coalesce(rows[text_col], none))
    kind = rows.schema[conv_col].dataType
    span = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())])
    fields = [("window", pa.int32()), ("text", pa.string()), ("tokens", pa.int64()), ("repeated", pa.int32()), ("loss", pa.list_(span)), ("over_budget", pa.bool_())]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tokenizer = WordCachedTokenizer(tokenizer_path, 0, max_words=100_000)
        count = lambda text: len(next(tokenizer([text]))) - 1
        for conv, own in conversations(batches):
            turns = (as_turn(role, text, count) for _, role, text in own)
            for at, window in enumerate(windows(turns, budget, history)):
                text, spans = render(window)
                tokens = sum(t.tokens for t in window.turns)
                yield conv, at, text, tokens, window.repeated, spans, tokens > budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return results(batches, conv_col, fields, found, lambda row: len(row[2]))

    return ordered.mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, window int, text string, tokens long, repeated int, loss array<struct<start:long,end:long>>, over_budget boolean")


def read_back(formatted: DataFrame, conv_col: str = "conv_id", in_place: bool = False) -> DataFrame:
    """What windows say, one row per conversation: number and hash of its turns, length and hash of its targets, and the windows' length.

    Turns that a window repeats are skipped, and what the mask covers is unescaped. Windows may lie anywhere, in any order; with
    ``in_place`` they lie as :func:`format_conversations` leaves them and aren't shuffled again. A task holds one window at a time.
    """
    kind = formatted.schema[conv_col].dataType
    x = formatted.select(conv_col, "window", "text", "repeated", "loss")
    x = x if in_place else x.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, own in conversations(batches):
            n_turns = loss_chars = chars = n_windows = 0
            said, learnt = hashlib.sha256(), hashlib.sha256()
            for _, text, repeated, loss in own:
                for k, (role, start, end) in enumerate(parse(text)):
                    if k >= repeated:
                        n_turns += 1
                        said.update(f"{role}\n{unescape(text[start:end])}\n".encode())
                for one in loss:
                    target = unescape(text[one["start"] : one["end"]])
                    loss_chars += len(target)
                    learnt.update(target.encode())
                chars, n_windows = chars + len(text), n_windows + 1
            yield conv, n_turns, said.hexdigest(), loss_chars, learnt.hexdigest(), chars, n_windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return results(batches, conv_col, fields, found, lambda row: 200)

    return x.mapInArrow(run, f"`{conv_col}` {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
