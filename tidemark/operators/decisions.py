"""From feature values to a decision: thresholded signals, their consensus, and three ways of combining them.

All of it is expressions within a row, as the features that may signal are few: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG, SHORT = 1, -1


class Rule(NamedTuple):
    """A feature's threshold and weight, and whether large values speak for a rise."""

    feature: str
    threshold: float
    weight: float
    rising: bool


def rules_of(report: Sequence[Mapping], base: float = 0.001, least: float = 0.0001, most: float = 0.01, top: int = 10, min_score: float = 0.0) -> list[Rule]:
    """Rules for the ``top`` features of a report (feature, alpha_score, label_correlation) by score.

    The threshold is ``base`` over the size of the correlation, within bounds; ``most`` where it is below one in a hundred.
    """
    best = sorted((r for r in report if r["alpha_score"] >= min_score), key=lambda r: -r["alpha_score"])[:top]
    size = lambda r: abs(r["label_correlation"])
    return [Rule(r["feature"], most if size(r) < 0.01 else min(most, max(least, base / size(r))), r["alpha_score"], r["label_correlation"] > 0) for r in best]


def with_signals(df: DataFrame, rules: Sequence[Rule], multiplier: Column | float = 1.0) -> DataFrame:
    """Adds signals, an array of (feature, direction, strength, weight), and consensus, their mean direction by strength.

    A feature signals beyond its threshold times ``multiplier`` (a regime's); null and NaN don't. Strength is how far beyond, a tenth of
    the multiple and 1 at most, times the weight.
    """
    if not rules:
        raise ValueError("no feature may signal")
    scale = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    found = []
    for r in rules:
        v, bar = F.nanvl(F.col(r.feature).cast("double"), F.lit(None).cast("double")), F.lit(r.threshold) * scale
        side = F.when(v > bar, LONG if r.rising else SHORT).otherwise(SHORT if r.rising else LONG)
        strength = F.least(F.lit(1.0), F.abs(v) / bar / 10) * r.weight
        found.append(F.when(F.abs(v) > bar, F.struct(F.lit(r.feature).alias("feature"), side.alias("direction"), strength.alias("strength"), F.lit(r.weight).alias("weight"))))
    x = df.withColumn("signals", F.array_compact(F.array(*found)))
    consensus = F.try_divide(_total("signals", lambda s: s["direction"] * s["strength"]), _total("signals", lambda s: s["strength"]))
    return x.withColumn("consensus", F.coalesce(consensus, F.lit(0.0)))


def _total(signals: Column | str, value) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda total, s: total + value(s))


def _when(signals: Column, side: int, value) -> Column:
    return _total(signals, lambda s: F.when(s["direction"] == side, value(s)).otherwise(0.0))


def combine(df: DataFrame, mode: str = "weighted", min_strength: float = 0.3, min_signals: int = 2, least_confidence: float = 0.5) -> DataFrame:
    """Adds action (LONG, SHORT, HOLD), confidence and reason from the signals that are strong enough.

    ``majority``: the side with more signals, if they are enough; ``unanimous``: the one side of all, if they are enough; ``weighted``: the
    side of the net strength by weight, if it reaches ``least_confidence``.
    """
    strong = F.filter("signals", lambda s: s["strength"] >= min_strength)
    n, one, size = F.size(strong), (lambda s: F.lit(1.0)), (lambda s: s["strength"])
    longs, shorts = _when(strong, LONG, one), _when(strong, SHORT, one)
    side = F.when(longs > shorts, LONG).when(shorts > longs, SHORT)
    some = F.greatest(longs, shorts)
    if mode == "majority":
        taken = side.isNotNull() & (some >= min_signals)
        confidence = F.when(taken, some / n * (F.when(side == LONG, _when(strong, LONG, size)).otherwise(_when(strong, SHORT, size)) / some)).otherwise(0.0)
        why = F.when(taken, F.when(side == LONG, "majority_long").otherwise("majority_short")).otherwise("no_majority")
    elif mode == "unanimous":
        taken = (n >= min_signals) & (some == n)
        confidence = F.when(taken, _total(strong, size) / n).otherwise(0.0)
        why = F.when(n < min_signals, "insufficient_signals").when(~taken, "not_unanimous").when(side == LONG, "unanimous_long").otherwise("unanimous_short")
    elif mode == "weighted":
        weight = lambda s: F.when(s["weight"] == 0, s["strength"]).otherwise(s["weight"])
        by_weight = lambda s: weight(s) * s["strength"]
        whole = _total(strong, weight)
        net = F.coalesce(F.try_divide(_when(strong, LONG, by_weight), whole) - F.try_divide(_when(strong, SHORT, by_weight), whole), F.lit(0.0))
        confidence, side = F.abs(net), F.when(net > 0, LONG).otherwise(SHORT)
        taken = confidence >= least_confidence
        why = F.when(whole == 0, "zero_weight").when(~taken, "below_threshold").when(side == LONG, "weighted_long").otherwise("weighted_short")
    else:
        raise ValueError(f"no way to combine signals: {mode}")
    none = n == 0
    return df.withColumns({
        "action": F.when(none | ~F.coalesce(taken, F.lit(False)), "HOLD").when(side == LONG, "LONG").otherwise("SHORT"),
        "confidence": F.when(none, 0.0).otherwise(confidence), "reason": F.when(none, "no_valid_signals").otherwise(why),
    })
