"""Hand-written edges: when to enter, which way, how sure, and when to leave, as conditions over features.

An edge is a few expressions, so any number of them is judged in one pass. A condition over an unknown feature doesn't hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rollups import first_of

LONG, SHORT = "LONG", "SHORT"


class Edge(NamedTuple):
    """``regimes``: values of the regime column in which it may enter (all, if empty). ``horizon``: the longest time held, in units of the query."""

    name: str
    entry: Column
    direction: Column
    confidence: Column
    exits: tuple[tuple[Column, str], ...]
    regimes: tuple = ()
    horizon: int = 10


def manual_edges() -> tuple[Edge, ...]:
    """the three edges from theory; features are columns by the registry's names. Thresholds are fixed values."""
    c = F.col
    ratio, momentum, pressure, reversion = c("volatility_ratio"), c("return_momentum"), c("liquidity_pressure"), c("micro_reversion")
    along = lambda p: ((momentum > 0) & (pressure > p)) | ((momentum < 0) & (pressure < -p))
    against = ((momentum > 0) & (pressure < -0.3)) | ((momentum < 0) & (pressure > 0.3))
    calm = F.coalesce(c("regime_volatility") == 0, F.lit(False)) | F.coalesce(ratio < 0.5, F.lit(False))
    spike = F.coalesce(c("regime_volatility") == 2, F.lit(False)) | F.coalesce(ratio > 2.0, F.lit(False))
    return (
        Edge("mean_rev_low_vol_v1", calm & (reversion > 0.6) & (momentum < -0.3), F.lit(LONG), reversion, ((momentum > 0.2, "reversion_complete"), (spike, "volatility_spike")), (0,), 10),
        Edge(
            "momentum_continuation_v1", (F.abs(momentum) > 0.5) & along(0.3) & (reversion < 0.4) & (c("regime_trend") != 0), F.when(momentum > 0, LONG).otherwise(SHORT), F.abs(momentum),
            ((F.abs(momentum) < 0.2, "momentum_weakened"), (against, "pressure_reversal"), (c("regime_trend") == 0, "regime_change")), (-1, 1), 15,
        ),
        Edge(
            "vol_breakout_compression_v1", (c("volatility_compression_score") > 0.7) & (c("spread_compression") > 0.3) & (c("quote_intensity") > 0.7) & (ratio < 1.0),
            F.when(momentum < -0.1, SHORT).otherwise(LONG), c("volatility_compression_score"), ((ratio > 1.5, "volatility_expanded"), (c("volatility_compression_score") < 0.4, "compression_failed")), (), 20,
        ),
    )


def entries(df: DataFrame, edges: Sequence[Edge], regime: str | None = None) -> DataFrame:
    """one row for each edge that is active on a row: the row's columns, edge, direction, confidence. A regime that is unknown fits no edge that asks for one."""

    def active(e: Edge) -> Column:
        fits = F.col(regime).isin(*e.regimes) if e.regimes and regime else F.lit(True)
        return F.coalesce(fits & e.entry, F.lit(False))

    found = [F.when(active(e), F.struct(F.lit(e.name).alias("edge"), e.direction.alias("direction"), e.confidence.cast("double").alias("confidence"))) for e in edges]
    return df.select("*", F.explode(F.array_compact(F.array(*found))).alias("_found")).select(*df.columns, "_found.*")


def edge_trades(df: DataFrame, by: Sequence[str], edges: Sequence[Edge], price: str, regime: str | None = None, unit_ms: int = 1000) -> DataFrame:
    """(by, seq, edge, direction, confidence, entry_ts, exit_ts, exit_seq, reason, back) for every entry of each edge.

    The exit is the first later row in (ts_event, seq) at which more than the horizon has passed (time_horizon_exceeded, which goes first) or an exit condition holds;
    entries without one are open: null exit. ``back`` is the signed relative move from entry to exit. Groups ``by`` should be
    bounded, such as a stream's days: a group is sorted once for all edges.
    """
    # From the last row back, so that a frame only grows: one that begins at a row and has no end is summed anew for each row.
    back = Window.partitionBy(*by).orderBy(F.desc("ts_event"), F.desc("seq"))
    behind = back.rowsBetween(Window.unboundedPreceding, -1)
    x, held = df, []
    for i, e in enumerate(edges):
        reason = first_of(*e.exits)
        x = x.withColumn(f"_why{i}", reason)
        x = x.withColumn(f"_exit{i}", F.last(F.when(F.col(f"_why{i}").isNotNull(), F.struct("ts_event", "seq", F.col(price).alias("price"), F.col(f"_why{i}").alias("reason"))), ignorenulls=True).over(behind))
        later = Window.partitionBy(*by).orderBy(F.desc("ts_event")).rangeBetween(Window.unboundedPreceding, -(e.horizon * unit_ms + 1))
        x = x.withColumn(f"_late{i}", F.min(F.struct("ts_event", "seq", F.col(price).alias("price"), F.lit("time_horizon_exceeded").alias("reason"))).over(later))
        held.append((e.name, f"_exit{i}", f"_late{i}"))
    x = entries(x, edges, regime)
    place = lambda s: F.struct(F.col(f"{s}.ts_event"), F.col(f"{s}.seq"))
    out = F.lit(None)
    for name, early, late in held:
        sooner = F.col(early).isNotNull() & (F.col(late).isNull() | (place(early) < place(late)))
        out = F.when(F.col("edge") == name, F.when(sooner, F.col(early)).otherwise(F.col(late))).otherwise(out)
    x = x.withColumn("_end", out)
    side = F.when(F.col("direction") == LONG, 1).otherwise(-1)
    return x.select(
        *by, "seq", "edge", "direction", "confidence", F.col("ts_event").alias("entry_ts"), F.col("_end.ts_event").alias("exit_ts"), F.col("_end.seq").alias("exit_seq"), F.col("_end.reason").alias("reason"),
        (F.try_divide(F.col("_end.price") - F.col(price), F.col(price)) * side).alias("back"),
    )
