"""Live operators with state of their own and timers: an order guard, source states, rolling features.

Each key's rows of a micro-batch are put in order before they are used, and all that a later row may need is state, so results
do not depend on how a stream is cut into batches. Timers forget keys that have gone quiet, so state doesn't grow for ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _together(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def _stateful(df: DataFrame, by: Sequence[str], out: T.StructType, state: str, run: Callable, timeout: str) -> DataFrame:
    return df.groupBy(*by).applyInPandasWithState(run, out, state, "append", timeout)


def _verdicts(t: np.ndarray, s: np.ndarray, old: int) -> tuple[np.ndarray, int]:
    """Row by row: 0 if (t, s) is beyond all before it, 1 if it equals the highest of them, else 2; the first ``old`` rows give none. And where the highest is."""
    up = np.lexsort((s, t))
    place = np.empty(len(t), np.int64)
    place[up] = np.concatenate([[0], np.cumsum((t[up][1:] != t[up][:-1]) | (s[up][1:] != s[up][:-1]))])
    before = np.concatenate([[-1], np.maximum.accumulate(place)[:-1]])
    return np.where(place > before, 0, np.where(place == before, 1, 2)).astype(np.int8)[old:], int(np.argmax(place))


VERDICTS = np.array(["accepted", "duplicate", "out_of_order"], dtype=object)


def ordered(df: DataFrame, by: Sequence[str], arrival: str, lateness: str = "1 day", keep_ms: int = 7 * 86_400_000, slice_rows: int = 65_536) -> DataFrame:
    """Rows with status: accepted if (ts_event, seq) is beyond all that the key has accepted, else duplicate of the last, or out_of_order.

    ``arrival`` numbers rows as they came; rows of one number and batch are taken in order of (ts_event, seq), then of their other columns,
    so that reruns agree. What is more than ``lateness`` behind the newest row is left out by the watermark, and a key
    whose last row is ``keep_ms`` behind it is forgotten. A task holds a key's rows of one batch as columns, so it is the stream's
    batches that bound its memory; rows go out by ``slice_rows``.
    """
    columns = df.columns
    order = [arrival, "ts_event", "seq", *[c for c, kind in df.dtypes if c not in (arrival, "ts_event", "seq", *by) and "<" not in kind]]
    df = df.withColumn("event_time", F.timestamp_millis("ts_event")).withWatermark("event_time", lateness)

    def run(key: tuple, rows: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
        if last.hasTimedOut:
            last.remove()
            return
        x = _together((some[columns] for some in rows), order)
        held = [last.get] if last.exists else []
        t, s = (np.concatenate([np.array([h[k] for h in held], np.int64), x[c].astype(np.int64)]) for k, c in enumerate(("ts_event", "seq")))
        verdicts, highest = _verdicts(t, s, len(held))
        last.update((int(t[highest]), int(s[highest])))
        last.setTimeoutTimestamp(max(int(t[highest]), last.getCurrentWatermarkMs()) + keep_ms)
        for k in range(0, len(x), slice_rows):
            yield x.iloc[k : k + slice_rows].assign(status=VERDICTS[verdicts[k : k + slice_rows]])

    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("status", T.StringType())])
    return _stateful(df, by, schema, "ts_event long, seq long", run, GroupStateTimeout.EventTimeTimeout)


def guard(df: DataFrame, by: Sequence[str], arrival: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes accepted and rejected rows of one stream below ``path``, as partitions by batch and status.

    A batch that is replayed after a failure writes the same folder again, so every row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("status").parquet(f"{path}/batch={number}")

    return ordered(df, by, arrival).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATES = ("READY", "DEGRADED", "OFFLINE", "ERROR")
TRANSITIONS = T.StructType().add("at", T.LongType()).add("before", T.StringType()).add("state", T.StringType())


def source_states(df: DataFrame, source: str, silence_ms: int = 30_000, queue_full: float = 80.0, lateness: str = "1 second") -> DataFrame:
    """(source, at, before, state) at every change of a source's state.

    Reports have ts_event, queue_pct, dropped and fatal. ERROR while a report says fatal; OFFLINE ``silence_ms`` after the last report, by a timer
    that the watermark sets off, so other sources' reports are enough; DEGRADED once anything was dropped or while the queue is full; else READY.
    """
    x = df.select(source, "ts_event", F.col("queue_pct").cast("double").alias("queue_pct"), F.col("dropped").cast("long").alias("dropped"), "fatal")
    x = x.withColumn("event_time", F.timestamp_millis("ts_event")).withWatermark("event_time", lateness)

    def run(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, heard, dropped = held.get if held.exists else (None, None, 0)
        changes = []

        def become(new: str, at: int) -> None:
            nonlocal state
            if new != state:
                changes.append((key[0], at, state, new))
                state = new

        def silent(now: int) -> None:
            if heard is not None and state != "ERROR" and now - heard >= silence_ms:
                become("OFFLINE", heard + silence_ms)

        if held.hasTimedOut:
            silent(heard + silence_ms)
        else:
            x = _together(rows, ["ts_event"])
            for at, queue, drops, fatal in zip(x["ts_event"].tolist(), x["queue_pct"], x["dropped"], x["fatal"], strict=True):
                silent(at)
                heard = at if heard is None else max(at, heard)
                dropped += 0 if pd.isna(drops) else int(drops)
                become("ERROR" if not pd.isna(fatal) and fatal else "DEGRADED" if dropped > 0 or queue >= queue_full else "READY", at)
            silent(held.getCurrentWatermarkMs())
        held.update((state, heard, dropped))
        if state not in ("OFFLINE", "ERROR"):
            held.setTimeoutTimestamp(heard + silence_ms)
        yield pd.DataFrame(changes, columns=[source, *TRANSITIONS.names])

    schema = T.StructType([df.schema[source], *TRANSITIONS.fields])
    return _stateful(x, [source], schema, "state string, heard long, dropped long", run, GroupStateTimeout.EventTimeTimeout)


def _last(values: np.ndarray, n: int) -> np.ndarray:
    """Row k: the n values up to k; NaN where there are fewer."""
    padded = np.concatenate([np.full(n - 1, np.nan), values])
    return sliding_window_view(padded, n)


def _over_known(values: np.ndarray, n: int, f, old: int) -> np.ndarray:
    """f of the last n known values at each known place, NaN elsewhere; the first ``old`` values are from before and give no rows."""
    known = ~np.isnan(values)
    out = np.full(len(values), np.nan)
    if known.any():
        out[known] = f(_last(values[known], n))
    return out[old:]


LIVE = ("volatility", "rsi", "volatility_ratio", "bollinger_pos", "quote_intensity")
_KINDS = (np.float64, np.int64, np.float64, np.float64)


def _rolled(x: pd.DataFrame, old: list[np.ndarray], w: Mapping[str, int]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """The features of new rows behind the kept mids, times, known returns and known rates, and what is to be kept of these then."""
    mids, times = np.concatenate([old[0], x["mid"].to_numpy(float)]), np.concatenate([old[1], x["ts_event"].to_numpy(np.int64)])
    m = len(old[0])
    before = np.concatenate([[np.nan], mids[:-1]])
    with np.errstate(all="ignore"):
        change = (mids - before)[m:]
        moved = np.where(before > 0, (mids - before) / before, np.nan)[m:]
        span = np.concatenate([np.full(min(w["quote_intensity"] - 1, len(times)), 0), times[w["quote_intensity"] - 1 :] - times[: max(0, len(times) - w["quote_intensity"] + 1)]])[m:]
        rate = np.where(span > 0, w["quote_intensity"] / (span / 1000.0), np.nan)
        returns, rates = np.concatenate([old[2], moved]), np.concatenate([old[3], rate])
        deviation = lambda size: _over_known(returns, size, lambda v: v.std(axis=1), len(old[2]))
        short, long = deviation(w["volatility_short"]), deviation(w["volatility_long"])
        ratio = np.clip(np.where(long == 0, 1.0, short / long), 0, 5)
        steps = _last(np.concatenate([np.diff(mids, prepend=np.nan)]), w["rsi"])[m:]
        mean_of = lambda v: reduce(np.add, v.T) / v.shape[1]  # in order, as a window adds
        gain, loss = mean_of(np.maximum(steps, 0)), mean_of(np.maximum(-steps, 0))
        rsi = np.where(np.isnan(change + gain), np.nan, np.where(loss == 0, 100.0, np.where(gain == 0, 0.0, 100.0 - 100.0 / (1.0 + gain / loss))))
        bands = _last(mids, w["bollinger_pos"])[m:]
        mean, sd = bands.mean(axis=1), bands.std(axis=1)
        place = np.where(sd == 0, 0.5, np.clip((mids[m:] - mean + 2 * sd) / (4 * sd), 0, 1))
        ranks = _over_known(rates, w["quote_ranks"], lambda v: np.where(np.isnan(v[:, :1]).any(axis=1), np.nan, (v <= v[:, -1:]).mean(axis=1)), len(old[3]))
    keep = lambda v, size: v[len(v) - min(size, len(v)) :]
    known = lambda v: v[~np.isnan(v)]
    back = max(w["bollinger_pos"], w["rsi"] + 1, w["quote_intensity"])
    kept = [keep(mids, back), keep(times, back), keep(known(returns), w["volatility_long"]), keep(known(rates), w["quote_ranks"])]
    return dict(zip(LIVE, (deviation(w["volatility"]), rsi, ratio, place, ranks), strict=True)), kept


def live_features(df: DataFrame, by: Sequence[str], windows: dict[str, int] | None = None, lateness: str = "1 minute", idle: int = 30 * 86_400_000, slice_rows: int = 16_384) -> DataFrame:
    """(by, ts_event, seq) with volatility, rsi, volatility_ratio, bollinger_pos and quote_intensity of quotes, as the batch features say.

    Quotes come in order from batch to batch; mids are known. Of a batch, ``slice_rows`` of a key are worked on at once. A key without quotes for ``idle`` milliseconds, by the watermark, begins anew.
    """
    from ..operators.registry import WINDOWS

    x = df.select(*by, "ts_event", "seq", "mid").withColumn("event_time", F.timestamp_millis("ts_event")).withWatermark("event_time", lateness)
    w = {**WINDOWS, **(windows or {})}
    by = list(by)

    def run(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        x = _together(rows, ["ts_event", "seq"])
        old = [np.frombuffer(b, k) for b, k in zip(held.get, _KINDS, strict=True)] if held.exists else [np.array([], k) for k in _KINDS]
        newest, x = int(x["ts_event"].max()), x[[*by, "ts_event", "seq", "mid"]]
        for k in range(0, len(x), slice_rows):  # a window of each row is held at once
            some = x.iloc[k : k + slice_rows]
            found, old = _rolled(some, old, w)
            yield some[[*by, "ts_event", "seq"]].assign(**found)
        held.update(tuple(v.tobytes() for v in old))
        held.setTimeoutTimestamp(max(newest, held.getCurrentWatermarkMs()) + idle)

    schema = T.StructType([*[df.schema[c] for c in (*by, "ts_event", "seq")], *[T.StructField(n, T.DoubleType()) for n in LIVE]])
    return _stateful(x, by, schema, "mids binary, times binary, returns binary, rates binary", run, GroupStateTimeout.EventTimeTimeout)
