"""As-of and nearest-time joins by one sort of both sides: n log n, whatever the overlap.

Both sides are united under the group's keys and ordered by time; the last right row seen is carried to
each left row. Nothing is joined pair by pair, and a group may be as large as a sort can be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import DAY_MS, null_safe_join, window_sums


def _carried(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], offset: int, forward: bool, width: int | None = None) -> DataFrame:
    """left with struct ``_hit`` (ts_event, seq, values) of the last right row at or before ts_event + offset,
    or, forward, the first at or after it.

    With ``width``, blocks of so much time are sorted by themselves, and a small table tells each what the blocks before it leave."""
    hit = F.struct("ts_event", "seq", *values)
    nothing = F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType)
    l_rows = left.select(
        *by, (F.col("ts_event") + offset).alias("_q"), F.lit(0 if forward else 1).alias("_side"), "seq", nothing.alias("_v"), F.struct(*left.columns).alias("_row")
    )
    r_rows = right.select(*by, F.col("ts_event").alias("_q"), F.lit(1 if forward else 0).alias("_side"), "seq", hit.alias("_v"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = [F.col(c).desc() if forward else F.col(c).asc() for c in ("_q", "_side", "seq")]
    group, carry = list(by), F.lit(None)
    if width is not None:
        both, group, carry = both.withColumn("_block", F.floor(F.col("_q") / width)), [*by, "_block"], F.col("_carry")
        place = F.when(F.col("_v").isNotNull(), F.struct("_q", "seq"))
        cells = both.groupBy(*group).agg((F.min_by if forward else F.max_by)("_v", place).alias("_edge"))
        passed = Window.partitionBy(*by).orderBy(F.col("_block").desc() if forward else F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
        both = null_safe_join(both, cells.select(*group, F.last("_edge", ignorenulls=True).over(passed).alias("_carry")), group)
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.coalesce(F.last("_v", ignorenulls=True).over(w), carry)).filter(F.col("_row").isNotNull())
    return found.select("_row.*", "_hit")


def _spread(found: DataFrame, columns: Sequence[str], values: Sequence[str], prefix: str) -> DataFrame:
    return found.select(*columns, *[F.col(f"_hit.{v}").alias(prefix + v) for v in ("ts_event", "seq", *values)])


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], offset: int = 0, tolerance: int | None = None, prefix: str = "r_") -> DataFrame:
    """The last right row with time <= left time + offset, ties to the larger seq.

    With a tolerance, a row further away than that is no match. Left columns not in ``by`` keep their
    names; the match's time, seq and values get the prefix, and are null without one.
    """
    return _spread(_within(_carried(left, right, by, values, offset, False), offset, tolerance), left.columns, values, prefix)


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], offset: int = 0, tolerance: int | None = None, prefix: str = "r_") -> DataFrame:
    """The first right row with time >= left time + offset, ties to the smaller seq."""
    return _spread(_within(_carried(left, right, by, values, offset, True), offset, tolerance), left.columns, values, prefix)


def _within(found: DataFrame, offset: int, tolerance: int | None) -> DataFrame:
    if tolerance is None:
        return found
    gap = F.abs(F.col("_hit.ts_event") - F.col("ts_event") - offset)
    return found.withColumn("_hit", F.when(gap <= tolerance, F.col("_hit")))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], offset: int = 0, tolerance: int | None = None, prefix: str = "r_") -> DataFrame:
    """The right row nearest to left time + offset; ties to the smaller time, then seq.

    Candidates are the last row strictly before and the first row at or after.
    """
    before = _carried(left, right, by, values, offset - 1, False).withColumnRenamed("_hit", "_before")
    both = _carried(before, right, by, values, offset, True).withColumnRenamed("_hit", "_after")
    at = F.col("ts_event") + offset

    def ranked(name: str) -> Column:
        gap = F.abs(F.col(f"{name}.ts_event") - at)
        fine = F.col(name).isNotNull() & (F.lit(True) if tolerance is None else gap <= tolerance)
        return F.when(fine, F.struct(gap.alias("gap"), *[F.col(f"{name}.{v}").alias(v) for v in ("ts_event", "seq", *values)]))

    found = both.withColumn("_hit", F.least(ranked("_before"), ranked("_after"))).drop("_before", "_after")
    return _spread(found, left.columns, values, prefix)


def asof_each(left: DataFrame, right: DataFrame, by: Sequence[str], value: str, offsets: dict[str, int], forward: bool = False, tolerance: int | None = None, width: int = DAY_MS) -> DataFrame:
    """A column for each named offset: the right value as of left time + offset, before or, forward, after.

    Rows are dealt to their offsets, so one shuffle and one sort serve all, in blocks of ``width`` of time, so that no
    key is one task. Left rows are told apart by (by, ts_event, seq), and hold no maps.
    """
    dealt = left.withColumn("_row", F.struct(*left.columns)).withColumn("_offset", F.explode(F.array(*map(F.lit, offsets.values()))))
    dealt = dealt.select(*by, (F.col("ts_event") + F.col("_offset")).alias("ts_event"), "seq", "_offset", "_row")
    found = _within(_carried(dealt, right, by, [value], 0, forward, width), 0, tolerance)
    each = [F.max(F.when(F.col("_offset") == o, F.col(f"_hit.{value}"))).alias(name) for name, o in offsets.items()]
    return found.groupBy(*by, "_row").agg(*each).select("_row.*", *offsets)


def state_at(left: DataFrame, changes: DataFrame, by: Sequence[str], change: str, name: str = "state") -> DataFrame:
    """The sum of all changes at or before each left row's time."""
    w = Window.partitionBy(*by).orderBy("ts_event", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = changes.withColumn("_state", F.sum(change).over(w))
    found = asof_backward(left, running, by, ["_state"], prefix="_r")
    return found.withColumn(name, F.coalesce("_r_state", F.lit(0.0))).drop("_rts_event", "_rseq", "_r_state")


def excursion(df: DataFrame, by: Sequence[str], value: str, width_ms: int) -> DataFrame:
    """The least and greatest value in [t, t + width], once per row."""
    sides = {f"min_{value}": ("_low", 0, width_ms), f"max_{value}": ("_high", 0, width_ms)}
    x = window_sums(df, by, {"_low": F.min(value), "_high": F.max(value)}, sides, folds={"_low": F.min, "_high": F.max})
    kind = df.schema[value].dataType
    return null_safe_join(df, x.select(*by, "ts_event", *[F.col(c).cast(kind).alias(c) for c in sides]), [*by, "ts_event"])
