"""Repair of a conversation's structure by the cheapest edits of its turns.

A conversation should read ``s?(ua)+`` in its roles' initials, or be empty. Edits are keeping a turn, giving it another
role, deleting it and inserting an empty one. They span a lattice of nodes (turns read, state of the grammar), which is
never built: Dijkstra's search makes a node's neighbours when it pops the node. Its priority is (cost, edits so
far), so of equally cheap repairs the one whose edits spell the least string wins, and the first accepting node popped
at the end of the turns is the answer.

Of equally cheap paths to a node neither's edits begin the other's, so what is least up to a node stays
least beyond it. That allows a long conversation to be searched in blocks of ``BLOCK`` turns: the search
goes on from the best path to each of the four states at the block's end, less the edits that all of them share. So
paths stay short and time grows with the turns alone; up to ``BLOCK`` turns it is one search.

Defined results: a null role or text is one space, a null turn comes first and is left out of gaps; turns of equal number
are ordered by role and text; repeated rows are turns of their own; conversations whose rows are all marked as absent
have zeros and no turns; a null conversation id is a conversation of its own; an empty table gives no rows. A conversation is one
value, as a text is: a task holds one at a time, however long. Columns that aren't named are left out.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .turns import conversations, in_order, results

#: From a state, by a role's initial, to the next state: the start, after a system turn, after a user's, after an assistant's.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
WRITTEN = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
BLOCK = 256
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"


def search(turns: list[tuple[str, str | None]], starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The best (cost, edits) from ``starts`` (by state) through turns of (initial, fault) to each state behind them; if these
    are the last turns, to the first accepting state alone."""
    heap = [(cost, edits, 0, state) for state, (cost, edits) in starts.items()]
    heapq.heapify(heap)
    popped, ends = set(), {}
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if (at, state) in popped:
            continue
        popped.add((at, state))
        ways = GRAMMAR[state]
        if at == len(turns):
            ends[state] = (cost, edits)
            if last and state in ACCEPTING:
                return {state: (cost, edits)}
        else:
            initial, fault = turns[at]
            heapq.heappush(heap, (cost + DELETE, edits + "D", at + 1, state))
            if fault not in (BLANK, DUPLICATE):
                stays = cost + (TRUNCATED if fault == CUT else 0)
                if initial in ways:
                    heapq.heappush(heap, (stays, edits + "K", at + 1, ways[initial]))
                for role in WRITTEN.keys() & ways.keys():
                    heapq.heappush(heap, (stays + REROLE, edits + "R", at + 1, ways[role]))
        for role in WRITTEN.keys() & ways.keys():
            heapq.heappush(heap, (cost + INSERT, edits + "I", at, ways[role]))
    return ends


def cheapest_edits(turns: Iterable[tuple[str, str | None]], block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of the best repair of turns of (initial, fault)."""
    starts, shared, held = {0: (0, "")}, [], []
    for turn in turns:
        if len(held) == block:
            starts, held = search(held, starts, last=False), []
            common = os.path.commonprefix([edits for _, edits in starts.values()])
            shared.append(common)
            starts = {state: (cost, edits[len(common) :]) for state, (cost, edits) in starts.items()}
        held.append(turn)
    ((cost, edits),) = search(held, starts, last=True).values()
    return cost, "".join(shared) + edits


def apply_edits(edits: str, turns: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns of (role, text) that the edits leave."""
    turns, state, out = iter(turns), 0, []
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = next(WRITTEN[i] for i in GRAMMAR[state] if i in WRITTEN)
        state = GRAMMAR[state][role[:1]]
        out.append((role, text))
    return out


def examine(rows: Iterable[tuple[int | None, str, str]]) -> tuple[dict[str, int], list[tuple[str, str]], list[tuple[str, str | None]]]:
    """Counts of a conversation's faults, its turns of (role, text) and those of (initial, fault)."""
    counts = dict.fromkeys(("gaps", BLANK, DUPLICATE, CUT, "illegal"), 0)
    turns, faults, seen = [], [], set()
    lowest = highest = before = None
    distinct = 0
    for number, role, text in rows:
        if number is not None and number != highest:
            lowest, highest, distinct = number if lowest is None else lowest, number, distinct + 1
        bare = text.rstrip(SPACE)
        fault = BLANK if not bare else DUPLICATE if (role, text) in seen else CUT if bare[-1] not in ENDS else None
        seen.add((role, text))
        counts[fault or BLANK] += fault is not None
        initial = role[:1]
        counts["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        turns.append((role, text))
        faults.append((initial, fault))
    if lowest is not None:
        counts["gaps"] = highest - lowest + 1 - distinct
    return counts, turns, faults


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: counts of faults, the cheapest edits and the repaired turns.

    Returns (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), the last an array of (role,
    text). Rows whose ``present_col`` isn't true only name their conversation.
    """
    space = F.lit(" ")
    present = F.lit(True) if present_col is None else F.coalesce(rows[present_col], F.lit(False))
    ordered = in_order(rows, rows[conv_col], rows[turn_col].cast("long"), F.coalesce(rows[role_col], space), F.coalesce(rows[text_col], space), present=present)
    turn = pa.struct([pa.field("role", pa.string()), pa.field("text", pa.string())])
    counted = ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")
    kind = rows.schema[conv_col].dataType
    fields = [*[(c, pa.int64()) for c in counted], ("audit", pa.string()), ("repaired", pa.list_(turn))]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, own in conversations(batches):
            counts, turns, faults = examine((number, role, text) for number, role, text, there in own if there)
            cost, edits = cheapest_edits(faults, block)
            whole = [{"role": role, "text": text} for role, text in apply_edits(edits, turns)]
            yield (conv, *counts.values(), cost, edits, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return results(batches, conv_col, fields, found, lambda row: sum(len(t["text"]) for t in row[-1]))

    ddl = f"`{conv_col}` {kind.simpleString()}, " + ", ".join(f"{c} long" for c in counted) + ", audit string, repaired array<struct<role:string,text:string>>"
    return ordered.mapInArrow(run, ddl)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present) with known faults, by a checksum of conversation and turn: of twenty parts one each is dropped
    (kept as not present), emptied, stripped of ``[.!?]``, repeated and given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(rows[conv_col].cast("string"), space), F.lit(":"), F.coalesce(rows[turn_col].cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.coalesce(rows[text_col], space)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).when(kind == 0, F.lit("")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(rows[role_col], space))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        rows[conv_col].alias(conv_col), rows[turn_col].alias(turn_col), role.alias(role_col), text.alias(text_col),
        F.explode_outer(F.array_repeat(F.lit(True), copies)).alias("present"),
    )
