"""Greedy spacing: a row is taken if the last one taken is far enough before it.

Whether a row is taken depends on all rows before, but only through the last one taken. So a key's rows are cut into
blocks of ``reach`` intervals, and a block needs to know no more than that one time. Within a block every row points to
the first row an interval later; doubling these pointers gives where each possible entry leads. The first row taken in
a block lies in its first interval or is the first one behind that, so entries are few, one row in ``reach`` about. Only they
are followed from block to block, in order; then each block takes its own rows.

Keys whose rows lie in one block, as most do, have nothing to follow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scans import ORDER, null_safe_join


def next_index(times: np.ndarray, interval: int) -> np.ndarray:
    """For each of the sorted times the first place at least an interval later; their number, if there is none."""
    return np.searchsorted(times, times + interval, side="left")


def last_of_chain(times: np.ndarray, interval: int) -> np.ndarray:
    """The last place that is taken if a place is, found by doubling pointers."""
    to = next_index(times, interval)
    to = np.where(to < len(times), to, np.arange(len(times)))
    while not np.array_equal(further := to[to], to):
        to = further
    return to


def _entries(by: Sequence[str], interval: int, width: int):
    """A block's possible entries, and the last time taken from each; one row without an entry for a block where none can be taken."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(ORDER), kind="stable")
        key = group.iloc[:1][[*by, "_block"]]
        times = group.loc[group["_fit"], "ts_event"].to_numpy()
        if not len(times):
            return key.assign(at=pd.array([None], "Int64"), last=pd.array([None], "Int64"))
        n = int(np.searchsorted(times, group["_block"].iloc[0] * width + interval, side="left")) + 1
        times_of = times[last_of_chain(times, interval)[:n]]
        return pd.concat([key] * len(times_of), ignore_index=True).assign(at=pd.array(times[:n], "Int64"), last=pd.array(times_of, "Int64"))

    return run


def _followed(by: Sequence[str], interval: int):
    """For each block of a key the last time taken before it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        blocks = group[[*by, "_block"]].drop_duplicates("_block").sort_values("_block").reset_index(drop=True)
        found = group.dropna(subset=["at"]).sort_values(["_block", "at"], kind="stable")
        at, last, block = (found[c].to_numpy(dtype="int64") for c in ("at", "last", "_block"))
        taken_in, taken = [], []
        place = 0
        while place < len(at):
            taken_in.append(block[place])
            taken.append(last[place])
            place = max(int(np.searchsorted(at, last[place] + interval, side="left")), int(np.searchsorted(block, block[place], side="right")))
        before = np.searchsorted(np.array(taken_in, dtype="int64"), blocks["_block"].to_numpy(dtype="int64"), side="left") - 1
        known = [int(taken[k]) if k >= 0 else None for k in before]
        return blocks.assign(before=pd.array(known, "Int64"))

    return run


def spaced(df: DataFrame, by: Sequence[str], interval: int, fit: Column | None = None, reach: int = 4096) -> DataFrame:
    """Adds kept, whether a row is taken, and last_kept, the time of the last row taken before it in order (ts_event, seq).

    Only rows that ``fit`` (all by default; null doesn't) can be taken. Rows without a time are never taken and know of none.
    """
    width = interval * reach
    x = df.withColumns({"_fit": F.coalesce(fit, F.lit(False)) if fit is not None else F.lit(True), "_block": F.floor(F.col("ts_event") / width)})
    timed = x.filter("ts_event is not null")
    keys = df.select(*by).schema.fields
    blocks = timed.groupBy(*by, "_block").agg(F.count("*").alias("_rows"))
    blocks = blocks.withColumn("_several", F.count("*").over(Window.partitionBy(*by)) > 1).drop("_rows")
    narrow = null_safe_join(timed.select(*by, *ORDER, "_fit", "_block"), blocks.filter("_several").select(*by, "_block"), [*by, "_block"])
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    entries = narrow.groupBy(*by, "_block").applyInPandas(_entries(by, interval, width), T.StructType([*keys, *long("_block", "at", "last")]))
    before = entries.groupBy(*by).applyInPandas(_followed(by, interval), T.StructType([*keys, *long("_block", "before")]))
    rows = null_safe_join(timed, before, [*by, "_block"], "left")
    out = T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType()), T.StructField("last_kept", T.LongType())])
    columns = df.columns

    def take(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ORDER])
        places = np.flatnonzero(group["_fit"].to_numpy())
        times, known = group["ts_event"].to_numpy(), group["before"][0].as_py()
        own = times[places]
        to, taken = next_index(own, interval), []
        at = 0 if known is None else int(np.searchsorted(own, known + interval, side="left"))
        while at < len(own):
            taken.append(places[at])
            at = to[at]
        taken = np.array(taken, dtype="int64")
        kept = np.zeros(len(times), dtype=bool)
        kept[taken] = True
        last = np.searchsorted(taken, np.arange(len(times)), side="left") - 1
        when = np.append(times[taken], 0 if known is None else known)[last]  # place -1 is what was taken before the block
        last_kept = pa.array(when, pa.int64(), mask=(last < 0) & (known is None))
        return group.select(columns).append_column("kept", pa.array(kept)).append_column("last_kept", last_kept)

    found = rows.groupBy(*by, "_block").applyInArrow(take, out)
    none = x.filter("ts_event is null").select(*df.columns, F.lit(False).alias("kept"), F.lit(None).cast("long").alias("last_kept"))
    return found.unionByName(none)


#: Fixed values of the gate between a signal and an order.
GATE = {"trend_min": -0.5, "volatility_min": 0.0, "spread_max": 2.0, "score_min": 0.6, "cooldown_ms": 5000, "relative_spread_max": 0.001}


def gate(signals: DataFrame, by: Sequence[str], rules: Mapping[str, float] = GATE, score: str = "score", trend: str = "regime_trend", volatility: str = "regime_volatility", spread: str = "regime_spread", width: str = "spread", mid: str = "mid") -> DataFrame:
    """Adds allow and reason to signals: regime, strength, cooldown since the last allowed one, width of the book.

    The reason is the first rule that fails. A regime that isn't known is neutral; an unknown width is none, and an unknown mid one. A
    signal without a score is too weak, one without a time is stopped by its cooldown.
    """
    relative = F.when(F.col(mid) == 0, 0.0).otherwise(F.coalesce(width, F.lit(0.0)) / F.coalesce(mid, F.lit(1.0)))
    before = [
        (F.coalesce(trend, F.lit(0)) < rules["trend_min"], "regime_trend"), (F.coalesce(volatility, F.lit(1)) < rules["volatility_min"], "regime_volatility"),
        (F.coalesce(spread, F.lit(1)) > rules["spread_max"], "regime_spread"), (F.coalesce(F.col(score) < rules["score_min"], F.lit(True)), "signal_strength"),
    ]
    wide = relative > rules["relative_spread_max"]
    x = signals.withColumn("_stop", F.coalesce(*[F.when(c, F.lit(name)) for c, name in before]))
    x = spaced(x, by, int(rules["cooldown_ms"]), F.col("_stop").isNull() & ~wide)
    hot = F.col("ts_event").isNull() | (F.col("ts_event") - F.col("last_kept") < int(rules["cooldown_ms"]))
    reason = F.coalesce("_stop", F.when(hot, "cooldown"), F.when(wide, "spread_penalty"), F.lit("all_gates_passed"))
    return x.withColumns({"allow": F.col("kept"), "reason": reason}).drop("_stop", "kept", "last_kept")
