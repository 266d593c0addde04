"""Scans, slices, cursors, samplers and selections over the total order (ts_event, seq)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import along, null_safe_join, number
from .spacing import spaced

ORDER = ("ts_event", "seq")


def time_range(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Both ends belong to the range; plain comparisons reach the scan."""
    if first is not None:
        df = df.filter(F.col("ts_event") >= first)
    return df if last is None else df.filter(F.col("ts_event") <= last)


def after(df: DataFrame, ts_event: int, seq: int) -> DataFrame:
    """Rows behind a cursor. The first condition is implied, and lets row groups be skipped."""
    t, s = F.col("ts_event"), F.col("seq")
    return df.filter((t >= ts_event) & ((t > ts_event) | ((t == ts_event) & (s > seq))))


def page(df: DataFrame, cursor: tuple[int, int] | None, size: int) -> DataFrame:
    return (after(df, *cursor) if cursor else df).orderBy(*ORDER).limit(size)


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*ORDER).limit(n)


def tail(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in ORDER]).limit(n).orderBy(*ORDER)


def head_tail(df: DataFrame, n: int) -> DataFrame:
    """floor(n / 2) rows from the start and the rest from the end; a row in both counts once."""
    return head(df, n // 2).unionByName(tail(df, n - n // 2)).dropDuplicates(list(ORDER))


def encode_cursor(ts_event: Column, seq: Column) -> Column:
    return F.base64(F.to_json(F.struct(F.lit(1).alias("v"), ts_event.cast("string").alias("ts_event"), seq.cast("string").alias("seq"))))


def decode_cursor(cursor: Column) -> Column:
    x = F.from_json(F.unbase64(cursor).cast("string"), "v int, ts_event string, seq string")
    return F.struct(x["v"].alias("v"), x["ts_event"].cast("long").alias("ts_event"), x["seq"].cast("long").alias("seq"))


def every_nth(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    return number(df, by).filter((F.col("_i") + 1) % n == 0).drop("_i", "_n")


def min_interval(df: DataFrame, interval_ms: int, by: Sequence[str]) -> DataFrame:
    """Keeps a row if the last one kept is at least an interval before."""
    return spaced(df, by, interval_ms).filter("kept").drop("kept", "last_kept")


def cap_per_group(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The first n rows of each group (a report's cap, off unless asked for)."""
    w = Window.partitionBy(*by).orderBy(*ORDER)
    return df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


OPS = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b,
}


def matches(conditions: Sequence[tuple[str, str, float]], regimes: Sequence[int] | None = None, regime_col: str = "regime") -> Column:
    """All conditions hold; null is no match."""
    out = F.lit(True)
    for name, op, bound in conditions:
        out = out & F.coalesce(OPS[op](F.col(name), F.lit(bound)), F.lit(False))
    return out if regimes is None else out & F.coalesce(F.col(regime_col).isin(list(regimes)), F.lit(False))


def exit_reason(conditions: Sequence[tuple[str, str, float]]) -> Column:
    """Why an entry no longer holds: the first missing feature or failed condition; null while all hold."""
    out = F.lit(None).cast("string")
    for name, op, bound in reversed(conditions):
        out = F.when(F.col(name).isNull(), F.lit(f"missing_{name}")).when(~OPS[op](F.col(name), F.lit(bound)), F.lit(f"{name}_condition")).otherwise(out)
    return out


def merged(df: DataFrame, by: Sequence[str], file_col: str, row_col: str) -> DataFrame:
    """O2: files merged by (ts_event, file, row) with a dense seq from 0 in each group.

    The group is a symbol's day, as files are; Spark's external sort takes the place of a heap.
    """
    w = Window.partitionBy(*by).orderBy("ts_event", file_col, row_col)
    return df.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def order_faults(df: DataFrame, by: Sequence[str], arrival: str, width: int = 1_000_000) -> DataFrame:
    """Rows, duplicates and regressions of (ts_event, seq) in order of arrival, a number; ``width`` of it are sorted together.

    Rows that arrive at the same number are taken in order of (ts_event, seq), so that reruns agree."""
    x = along(df.select(*by, *ORDER, arrival), by, {"_last": lambda w: F.lag(F.struct(*ORDER)).over(w)}, before=1, order=(arrival, *ORDER), width=width)
    key, last = F.struct(*ORDER), F.col("_last")
    x = x.select(*by, F.when(last.isNull(), "first").when(key == last, "duplicate").when(key < last, "regression").otherwise("ok").alias("_s"))
    count = lambda s: F.count_if(F.col("_s") == s)
    return x.groupBy(*by).agg(F.count("*").alias("n"), count("duplicate").alias("duplicates"), count("regression").alias("regressions"))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last row; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def first_new(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each new key's first row in order, of keys that aren't there yet; a null key is one like others."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*").select(*new.columns)
    return null_safe_join(first, existing.select(*keys), keys, "left_anti")


def merge_history(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Existing rows as they are, and the first new row of each key that isn't among them."""
    return existing.unionByName(first_new(existing, new, keys, order))


def merge_counts(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(inserted, skipped) new rows."""
    fresh = null_safe_join(new.select(*keys).distinct(), existing.select(*keys), keys, "left_anti").agg(F.count("*").alias("inserted"))
    return fresh.join(new.agg(F.count("*").alias("_n"))).select("inserted", (F.col("_n") - F.col("inserted")).alias("skipped"))  # a row each


def append_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose content isn't there yet, once each."""
    mark = lambda d: F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(d.columns)])), 256)
    return new.withColumn("fingerprint", mark(new)).join(existing.withColumn("fingerprint", mark(existing)).select("fingerprint"), "fingerprint", "left_anti").dropDuplicates(["fingerprint"])


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def round_robin(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """First every key's best row, then every key's second, until n are taken."""
    x = ranked(df, [by], order, "_turn")
    return x.orderBy("_turn", by).limit(n).drop("_turn")


def validate(df: DataFrame, schema: Mapping[str, str]) -> list[str]:
    """What is wrong with a table's columns; an empty list if nothing is."""
    have = dict(df.dtypes)
    return [f"missing {c}" for c in schema if c not in have] + [f"{c} is {have[c]}, not {t}" for c, t in schema.items() if have.get(c, t) != t]


def best_of_family(df: DataFrame, family: str, value: str, low: Sequence, ties: Sequence[Column]) -> DataFrame:
    """Each family's best row: the largest value, or the smallest for the families of ``low``, then the least of ``ties``; unknown values come last.

    One aggregate of the least key, so nothing is sorted. Rows of an unknown family are one family.
    """
    sign = F.when(F.col(family).isin(*low), 1.0).otherwise(-1.0) if low else F.lit(-1.0)
    rank = F.struct(F.col(value).isNull(), F.col(value) * sign, *ties)
    return df.groupBy(family).agg(F.min_by(F.struct(*[c for c in df.columns if c != family]), rank).alias("_best")).select(family, "_best.*")


def content_hash(df: DataFrame, by: Sequence[str], text: Column, order: Sequence[str] = ("ts_event", "seq"), size: int = 65_536) -> DataFrame:
    """(by, rows, fingerprint) of ordered parts: SHA-256 over the hashes of their blocks of ``size`` rows in order.

    A block is hashed by itself, so no task holds more than ``size`` texts and the part's list of block hashes. A null text is empty.
    """
    from .scans import number

    x = number(df.select(*by, *order, F.coalesce(text.cast("string"), F.lit("")).alias("_text")), by, order)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_text"))), lambda r: r["_text"])
    blocks = x.groupBy(*by, F.floor(F.col("_i") / size).alias("_block")).agg(F.count("*").alias("_rows"), F.sha2(F.array_join(rows, ""), 256).alias("_hash"))
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("_block", "_hash"))), lambda b: b["_hash"])
    return blocks.groupBy(*by).agg(F.sum("_rows").alias("rows"), F.sha2(F.array_join(hashes, ""), 256).alias("fingerprint"))


# Fixed values of the review.
TIER_SCORES = {"PROMOTE_STRONG": 50.0, "PROMOTE": 30.0}


def review_score(tier: Column, passed: Column, supported: Column, rss_kb: Column, elapsed_s: Column, bonus: Column) -> Column:
    """The tier's score and 20 for the share of repeats that agreed, less memory and time (10 each at most), to six places. Absent figures are 0."""
    base = F.lit(0.0)
    for name, score in TIER_SCORES.items():
        base = F.when(F.upper(F.trim(tier)) == name, score).otherwise(base)
    of = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    ratio = of(passed) / F.greatest(of(supported), F.lit(1.0))
    return F.round(base + 20 * ratio - F.least(of(rss_kb) / 200_000, F.lit(10.0)) - F.least(of(elapsed_s) / 60, F.lit(10.0)) + of(bonus), 6)
