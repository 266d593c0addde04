"""The rolling features of a block of quotes as array operations.

The same rules as in ``features``, where each is a window of its own with its own order of rows: a table of all features
would sort its rows a dozen times in one task. Here a block is put in order once, and a feature is a pass over it. Unknown
values are NaN. Windows are laid over a block a few thousand at a time, so memory goes by the block's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd

from . import features as f

CHUNK = 4096


def full(values: np.ndarray, n: int, stat: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A statistic of the last n values, NaN where there are fewer or one is NaN."""
    out = np.full(len(values), np.nan)
    if len(values) >= n:
        windows = np.lib.stride_tricks.sliding_window_view(values, n)
        for at in range(0, len(windows), CHUNK):
            part = windows[at : at + CHUNK]
            out[at + n - 1 : at + n - 1 + len(part)] = stat(part)
    return out


def known(values: np.ndarray, n: int, stat: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A statistic of the last n values that aren't NaN, NaN where the row's own is and until there are n."""
    out, at = np.full(len(values), np.nan), ~np.isnan(values)
    out[at] = full(values[at], n, stat)
    return out


def total(w: np.ndarray) -> np.ndarray:
    """In the order of rows, as Spark adds."""
    out = np.zeros(len(w))
    for column in w.T:
        out += column
    return out


def mean(w: np.ndarray) -> np.ndarray:
    return total(w) / w.shape[1]


def variance(w: np.ndarray) -> np.ndarray:
    """Of the population, value by value with Spark's own steps: equal values give 0, and what ties there ties here."""
    middle, squares = np.zeros(len(w)), np.zeros(len(w))
    for n, column in enumerate(w.T, 1):
        away = column - middle
        step = away / n
        middle += step
        squares += away * (away - step)
    return squares / w.shape[1]


def deviation(w: np.ndarray) -> np.ndarray:
    return np.sqrt(variance(w))


def no_larger(w: np.ndarray) -> np.ndarray:
    """The share of a window's values that are no larger than its last."""
    return (w <= w[:, -1:]).sum(axis=1) / float(w.shape[1])


def shifted(values: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(len(values), np.nan)
    out[n:] = values[:-n] if n < len(values) else []
    return out


def where(condition: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(condition, value, np.nan)


def of_class(ratio: np.ndarray) -> np.ndarray:
    """0 below a half, 2 above 2, else 1."""
    return where(~np.isnan(ratio), np.where(ratio < 0.5, 0, np.where(ratio > 2, 2, 1)))


def stateless(g: Mapping, w: Mapping[str, int]) -> dict:
    bid, ask, bids, asks = g["bid_price"], g["ask_price"], g["bid_qty"], g["ask_qty"]
    both = bids + asks
    micro = np.where(both == 0, g["mid"], (bid * asks + ask * bids) / both)
    return {"mid_price": g["mid"], "spread": ask - bid, "microprice": micro, "imbalance": where(both != 0, (bids - asks) / both)}


def returns(g: Mapping, w: Mapping[str, int]) -> dict:
    last = shifted(g["mid"])
    return {"return_1": where(last > 0, (g["mid"] - last) / last)}


def recursive(g: Mapping, w: Mapping[str, int], fold: Callable) -> dict:
    frame = pd.DataFrame({c: g[c] for c in ("mid", "imbalance", "spread") if c in g})
    return {name: v.to_numpy(float) for name, v in fold(frame).items()}


def rsi(g: Mapping, w: Mapping[str, int]) -> dict:
    change = g["mid"] - shifted(g["mid"])
    gain, loss = (full(np.maximum(x, 0.0), w["rsi"], mean) for x in (change, -change))
    value = np.where(loss == 0, 100.0, np.where(gain == 0, 0.0, 100.0 - 100.0 / (1.0 + gain / loss)))
    return {"rsi": where(~np.isnan(gain), value)}


def atr(g: Mapping, w: Mapping[str, int]) -> dict:
    move = np.abs(g["mid"] - shifted(g["mid"]))
    return {"atr": full(where(~np.isnan(move), np.fmax(g["ask_price"] - g["bid_price"], move)), w["atr"], mean)}


def roc(g: Mapping, w: Mapping[str, int]) -> dict:
    old = shifted(g["mid"], w["roc"])
    return {"roc": where(old > 0, (g["mid"] - old) / old * 100)}


def bollinger_position(g: Mapping, w: Mapping[str, int], k: float = 2.0) -> dict:
    middle, d = (full(g["mid"], w["bollinger_pos"], s) for s in (mean, deviation))
    return {"bollinger_pos": np.where(d == 0, 0.5, np.clip((g["mid"] - middle + k * d) / (2 * k * d), 0, 1))}


def volatility(g: Mapping, w: Mapping[str, int]) -> dict:
    return {"volatility": known(g["return_1"], w["volatility"], deviation)}


def volatility_regime(g: Mapping, w: Mapping[str, int]) -> dict:
    short, long = (known(g["return_1"], w[n], deviation) for n in ("volatility_short", "volatility_long"))
    ratio = where(~np.isnan(long), np.where(long == 0, 1.0, short / long))
    return {"volatility_ratio": np.clip(ratio, 0, 5), "regime_volatility": of_class(ratio)}


def return_momentum(g: Mapping, w: Mapping[str, int]) -> dict:
    moved = known(g["return_1"], w["return_momentum"], total)
    size = known(np.abs(g["return_1"]), w["return_momentum"], total)
    return {"return_momentum": np.where(size == 0, 0.0, moved / size)}


def micro_reversion(g: Mapping, w: Mapping[str, int]) -> dict:
    signs = np.sign(g["return_1"])
    flip, at = np.full(len(signs), np.nan), ~np.isnan(signs)
    flip[at] = signs[at] * shifted(signs[at])
    flipped = where(~np.isnan(flip), np.where(flip < 0, 1.0, np.where(flip > 0, 0.0, 0.5)))
    return {"micro_reversion": known(flipped, w["micro_reversion"], mean)}


def spread_ratio(g: Mapping, w: Mapping[str, int]) -> dict:
    width = g["ask_price"] - g["bid_price"]
    width = where(width > 0, width)
    ratio = width / known(width, w["spread_ratio"], mean)
    return {"spread_ratio": np.clip(ratio, 0, 5), "regime_spread": of_class(ratio)}


def quote_intensity(g: Mapping, w: Mapping[str, int]) -> dict:
    n = w["quote_intensity"]
    span = g["ts_event"] - shifted(g["ts_event"], n - 1) if n > 1 else np.zeros(len(g["ts_event"]))
    return {"quote_intensity": known(where(span > 0, n / (span / 1000.0)), w["quote_ranks"], no_larger)}


def regime_stability(g: Mapping, w: Mapping[str, int], parts: Mapping[str, float] = f.STABILITY) -> dict:
    at = ~np.isnan([g[c] for c in parts]).any(axis=0)
    steady = lambda c: 1 - np.minimum(known(where(at, g[c]), w["regime_stability"], variance) / 0.67, 1.0)
    return {"regime_stability": sum(share * steady(c) for c, share in parts.items())}


def behavior_divergence(g: Mapping, w: Mapping[str, int]) -> dict:
    return {"behavior_divergence": (g["return_momentum"] - g["liquidity_pressure"]) / 2}


def compression_score(g: Mapping, w: Mapping[str, int]) -> dict:
    ratio, narrow, moves = g["volatility_ratio"], g["spread_compression"], g["volatility"]
    rank = known(where(~np.isnan(ratio + narrow), moves), w["volatility_compression_score"], no_larger)
    return {"volatility_compression_score": 0.4 * np.clip(2 - ratio, 0, 1) + 0.3 * (narrow + 1) / 2 + 0.3 * (1 - rank)}
