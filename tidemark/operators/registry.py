"""All features by name in one plan.

Features hang together: some come from one window, some from others. The names asked for are resolved to the
steps that make them, each step once and behind those that it needs, so windows are shared and derived features come
last. Rows are dealt to blocks of their key first (one shuffle); a block is put in order once, and all steps run over it
in one pass of array operations, so a task holds a block and not a sorted copy of its rows for each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import features as f
from . import rolling, scans

TREND = ("ema", "ema_slope", "trend_strength", "regime_trend")
SMOOTH = ("imbalance_ema", "liquidity_pressure", "spread_compression", "imbalance_acceleration")


class Step(NamedTuple):
    """What a step makes, what it needs of other steps, and how: from (rows, group, windows by feature name)."""

    makes: tuple[str, ...]
    needs: tuple[str, ...]
    build: Callable[[DataFrame, list[str], Mapping[str, int]], DataFrame]


#: How many rows or values a feature looks at, where it can be chosen.
WINDOWS = {
    "volatility": 20, "rsi": 14, "atr": 14, "roc": 10, "volatility_short": 20, "volatility_long": 100, "spread_ratio": 100, "bollinger_pos": 20,
    "return_momentum": 20, "micro_reversion": 50, "quote_intensity": 20, "quote_ranks": 200, "regime_stability": 100, "volatility_compression_score": 50,
}

STEPS = (
    Step(("mid_price", "spread", "microprice", "imbalance"), (), lambda q, by, w: f.stateless(q)),
    Step(("return_1",), (), lambda q, by, w: f.with_returns(q, by)),
    Step(TREND, (), lambda q, by, w: f.recursive(q, by, TREND, f.trend_fold)),
    Step(SMOOTH, ("imbalance", "spread"), lambda q, by, w: f.recursive(q, by, SMOOTH, f.imbalance_fold)),
    Step(("rsi",), (), lambda q, by, w: f.rsi(q, by, w["rsi"])),
    Step(("atr",), (), lambda q, by, w: f.atr(q, by, w["atr"])),
    Step(("roc",), (), lambda q, by, w: f.roc(q, by, w["roc"])),
    Step(("bollinger_pos",), (), lambda q, by, w: f.bollinger_position(q, by, w["bollinger_pos"])),
    Step(("volatility",), ("return_1",), lambda q, by, w: f.volatility(q, by, w["volatility"])),
    Step(("volatility_ratio", "regime_volatility"), ("return_1",), lambda q, by, w: f.volatility_regime(q, by, w["volatility_short"], w["volatility_long"])),
    Step(("return_momentum",), ("return_1",), lambda q, by, w: f.return_momentum(q, by, w["return_momentum"])),
    Step(("micro_reversion",), ("return_1",), lambda q, by, w: f.micro_reversion(q, by, w["micro_reversion"])),
    Step(("spread_ratio", "regime_spread"), (), lambda q, by, w: f.spread_ratio(q, by, w["spread_ratio"])),
    Step(("quote_intensity",), (), lambda q, by, w: f.quote_intensity(q, by, w["quote_intensity"], w["quote_ranks"])),
    Step(("regime_stability",), ("volatility_ratio", "trend_strength", "spread_ratio"), lambda q, by, w: f.regime_stability(q, by, w["regime_stability"])),
    Step(("behavior_divergence",), ("return_momentum", "liquidity_pressure"), lambda q, by, w: f.behavior_divergence(q, by)),
    Step(("volatility_compression_score",), ("volatility_ratio", "spread_compression", "volatility"), lambda q, by, w: f.compression_score(q, by, w["volatility_compression_score"])),
)
HELPERS = ("imbalance",)
FEATURES = tuple(name for step in STEPS for name in step.makes if name not in HELPERS)


def resolve(names: Iterable[str], steps: Sequence[Step] = STEPS) -> list[Step]:
    """The steps that make the names and all they need, each behind what it needs; an error for a name that none makes."""
    makers = {name: step for step in steps for name in step.makes}
    chosen: list[Step] = []

    def take(name: str, above: tuple[str, ...] = ()) -> None:
        if name not in makers:
            raise ValueError(f"no feature {name}")
        if name in above:
            raise ValueError(f"features need each other: {' > '.join((*above, name))}")
        step = makers[name]
        if step not in chosen:
            for need in step.needs:
                take(need, (*above, name))
            chosen.append(step)

    for name in names:
        take(name)
    return chosen


#: Both groups of recursive averages in one pass, for when both are needed.
BOTH = Step(TREND + SMOOTH, ("imbalance", "spread"), lambda q, by, w: f.recursive(q, by, TREND + SMOOTH, lambda g: {**f.trend_fold(g), **f.imbalance_fold(g)}))


def plan(names: Iterable[str]) -> list[Step]:
    """The steps of :func:`resolve`, with one recursive pass at most."""
    names = list(names)
    steps = resolve(names)
    if sum(s.makes in (TREND, SMOOTH) for s in steps) < 2:
        return steps
    return resolve(names, [*(s for s in STEPS if s.makes not in (TREND, SMOOTH)), BOTH])


#: A step's pass over a block, by what it makes: from (arrays by name, windows by feature name).
PASSES = {
    STEPS[0].makes: rolling.stateless, ("return_1",): rolling.returns, ("rsi",): rolling.rsi, ("atr",): rolling.atr, ("roc",): rolling.roc, ("bollinger_pos",): rolling.bollinger_position,
    TREND: lambda g, w: rolling.recursive(g, w, f.trend_fold), SMOOTH: lambda g, w: rolling.recursive(g, w, f.imbalance_fold),
    TREND + SMOOTH: lambda g, w: rolling.recursive(g, w, lambda x: {**f.trend_fold(x), **f.imbalance_fold(x)}),
    ("volatility",): rolling.volatility, ("volatility_ratio", "regime_volatility"): rolling.volatility_regime, ("return_momentum",): rolling.return_momentum,
    ("micro_reversion",): rolling.micro_reversion, ("spread_ratio", "regime_spread"): rolling.spread_ratio, ("quote_intensity",): rolling.quote_intensity,
    ("regime_stability",): rolling.regime_stability, ("behavior_divergence",): rolling.behavior_divergence, ("volatility_compression_score",): rolling.compression_score,
}
CLASSES = ("regime_volatility", "regime_spread")
BOOK = ("mid", "bid_price", "ask_price", "bid_qty", "ask_qty")


def look_back(windows: Mapping[str, int]) -> int:
    """Rows that the features may look back: the longest chain of windows, and the memory of the slowest average."""
    chain = max(windows["volatility_long"], windows["spread_ratio"], windows["volatility"], scans.memory(f.span(50))) + max(windows["regime_stability"], windows["volatility_compression_score"])
    return max(chain, windows["quote_intensity"] + windows["quote_ranks"]) + 64


def feature_table(q: DataFrame, by: Sequence[str], enabled: Sequence[str] = FEATURES, windows: Mapping[str, int] | None = None, warm: bool = True, size: int = 65_536) -> DataFrame:
    """(by, ts_event, seq, the enabled features) of quotes; with ``warm`` only rows where all of them are known.

    Windows go by rows of a key in order. A window over known values reaches back :func:`look_back` rows at most from the
    beginning of a block of ``size`` rows: where more than all but its n values of these are unknown, it counts as not full.
    """
    unknown = set(windows or ()) - set(WINDOWS)
    if unknown:
        raise ValueError(f"no window {sorted(unknown)}")
    w = {**WINDOWS, **(windows or {})}
    back = look_back(w)
    x = q.select(*by, *scans.ORDER, *BOOK)
    x = scans.in_blocks(scans.number(x, by), by, before=back, size=max(size, back))
    steps, kept = [s.makes for s in plan(enabled)], [*by, *scans.ORDER]
    schema = T.StructType([q.schema[c] for c in kept])
    for name in enabled:
        schema = schema.add(name, T.IntegerType() if name in CLASSES else T.DoubleType())

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_i", kind="stable")
        g = {c: block[c].to_numpy(float) for c in (*BOOK, "ts_event")}
        with np.errstate(divide="ignore", invalid="ignore"):
            for makes in steps:
                g.update(PASSES[makes](g, w))
        home = block["_home"].to_numpy(bool)
        return block.loc[home, kept].assign(**{name: pd.array(g[name][home], "Int32") if name in CLASSES else g[name][home] for name in enabled})

    x = x.drop("_n").groupBy(*by, "_blk").applyInPandas(run, schema)
    return f.complete(x, list(enabled)) if warm else x
