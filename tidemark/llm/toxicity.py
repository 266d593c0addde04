"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: tokens and their stems are counted once per labelled text (equal texts count once), by label.
A unit's score is its log-odds between toxic and other texts under an informative Dirichlet prior, drawn
towards 0 by ``z`` standard errors. A token scores the best of its own and its stems' scores if one is
positive; otherwise its own log-odds, at least -``floor``, less a small drift, so that text which says
nothing scores the drift. Every occurrence scores in the scan; inside one segment, each repeat
of a unit has half the score of the one before it, as words come in clumps. Units are hashed to ``2 ** BITS`` places, which bounds the model whatever
the vocabulary.

Scoring: one linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a whole text. Under
the token frequencies of other texts, segments of score s are expected K n exp(-lambda s) times in n
tokens (Karlin and Altschul); lambda solves its defining equation for the scores of all tokens of the
texts labelled 0, K is fitted to these texts' segments.
A segment with an expectation below ``max_expected`` is a passage. A text's statistic is the sum over
its passages of -ln(expectation), and a logistic curve fitted on labelled texts turns it into a score.

Defined results: an empty or null text has no passages and the score of the statistic 0; without
labels of both kinds every score is the share of toxic labels (0 without any). Repeated rows get equal
scores. A doc that is labelled more than once counts once for each label. A very long text is scanned whole.
Spans are places in the text as it is. Extra columns are carried; columns named score, statistic and passages are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import lean, sliced, small_batches, written

BITS = 20
TOKEN = re.compile(r"\w+")
STEMS = (4, 5, 6)
DRIFT = 0.5
BINS = 400
BIN_WIDTH = 0.25
SCORE_BIN = 0.01  # of the token scores that lambda is solved for


def place(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def units(token: str) -> list[str]:
    """The token and its longer stems: inflected and compound forms are rare one by one, their stems are not."""
    return [token, *(token[:n] + "*" for n in STEMS if n < len(token))]


@dataclass
class ToxicityModel:
    """``scores``: shrunken log-odds of every place; 0 where nothing is known."""

    scores: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    lam: float = 1.0
    k: float = 1.0
    a: float = 0.0
    b: float = 0.0
    max_expected: float = 0.1
    base: float | None = None

    def probability(self, statistic: float) -> float:
        if self.base is not None:
            return self.base
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.a + self.b * statistic))))

    def of(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of tokens, and the places that they are from."""
        low = [t.lower() for t in tokens]
        own = np.fromiter(map(place, low), np.int64, len(low))
        stems = [np.fromiter((place(t[:n] + "*") if n < len(t) else p for t, p in zip(low, own.tolist(), strict=True)), np.int64, len(low)) for n in STEMS]
        places = np.stack([own, *stems])
        best = np.take_along_axis(places, self.scores[places].argmax(axis=0)[None], axis=0)[0]
        positive = self.scores[best] > 0
        return np.where(positive, self.scores[best].astype(float), self.scores[own].astype(float) - DRIFT), np.where(positive, best, own)


def maximal_segments(positions: Sequence[int], before: Sequence[float], through: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score) of a sequence, from its positive positions and
    the sums of the sequence before and through each. Linear in the positives, as only they can begin or end one."""
    found: list[list] = []  # first, last, sum before it, sum through it, the nearest earlier one with a smaller sum before
    for at, left, total in zip(positions, before, through, strict=True):
        first = at
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            first, left = found[k][0], found[k][2]
            del found[k:]
        found.append([first, at, left, total, k])
    return [(a, b, r - left) for a, b, left, r, _ in found]


def segments_of(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence of values."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    at = np.flatnonzero(values > 0)
    return maximal_segments(at.tolist(), sums[at].tolist(), sums[at + 1].tolist())


class Scorer:
    """Scores texts; scores of words are kept while they are few."""

    def __init__(self, model: ToxicityModel, max_words: int = 500_000):
        self.model, self.max_words = model, max_words
        self.words: dict[str, float] = {}
        self.places: dict[str, int] = {}  # of words with a positive score

    def values(self, tokens: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > self.max_words:
            known.clear()
            self.places.clear()
        new = list(set(tokens).difference(known))
        if new:
            scores, places = self.model.of(new)
            known.update(zip(new, scores.tolist(), strict=True))
            self.places.update((new[i], int(places[i])) for i in np.flatnonzero(scores > 0))
        out = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
        for token in new:
            if len(token) > 64 and token not in self.places:
                del known[token]
        return out

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Maximal segments of all occurrences; one that holds repeats is cut anew with these damped."""
        tokens = TOKEN.findall(text) if text else []
        values = self.values(tokens)
        out = []
        for first, last, score in segments_of(values):
            at = first + np.flatnonzero(values[first : last + 1] > 0)
            own = [self.places[tokens[i]] for i in at.tolist()]
            if len(set(own)) == len(own):
                out.append((first, last, score))
                continue
            times, damped = {}, values[first : last + 1].copy()
            for i, p in zip(at.tolist(), own, strict=True):
                damped[i - first] = max(values[i] * 0.5 ** min(times.get(p, 0), 60), 1e-12)
                times[p] = times.get(p, 0) + 1
            out += [(first + a, first + b, s) for a, b, s in segments_of(damped)]
        return len(tokens), out

    def passages(self, text: str | None) -> tuple[float, list[dict]]:
        """The statistic, and passages with their character spans."""
        n, segments = self.segments(text)
        m, out, statistic = self.model, [], 0.0
        for first, last, score in segments:
            log_expected = math.log(m.k * max(n, 1)) - m.lam * score
            if log_expected < math.log(m.max_expected):
                out.append((first, last, score, log_expected))
                statistic -= log_expected
        if out:
            spans = [x.span() for x in TOKEN.finditer(text)]
            out = [{"start": spans[a][0], "end": spans[b][1], "score": s, "expected": math.exp(max(e, -700))} for a, b, s, e in out]
        return statistic, out


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of labelled texts, each text once with each of its labels, whichever rows and ids it came with.

    Only ids and digests move until the one join, where a text comes from the least id that has it.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter(F.col("text").isNotNull()).withColumn("h", F.unhex(F.md5("text")))
    y = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).filter("id is not null and toxic is not null")
    y = y.select("id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    reps = rows.select("id", "h").join(y, "id").groupBy("h", "toxic").agg(F.min("id").alias("id"))
    joined = rows.join(reps, ["id", "h"]).dropDuplicates(["id", "h", "toxic"])  # repeated rows of one id
    return written(joined.select("text", "toxic"), "toxicity-train")


class Places(dict):
    """Token to the places of its units; long tokens aren't kept."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        places = tuple(map(place, units(token.lower())))
        if len(token) <= 64:
            self[token] = places
        return places


def count_tokens(train: DataFrame) -> DataFrame:
    """(place, toxic, other): in how many texts of each kind a token of that place is."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, known = np.zeros((2, 1 << BITS), np.int64), Places()
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = set().union(*map(known.__getitem__, set(TOKEN.findall(text))))
                counts[toxic, np.fromiter(places, np.int64, len(places))] += 1
            if len(known) > 200_000:
                known.clear()
        used = np.flatnonzero(counts.sum(0))
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], ["place", "toxic", "other"])

    partial = train.select("text", "toxic").mapInArrow(lean(run), "place long, toxic long, other long")
    return partial.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; there is one if the mean score is negative and some are positive."""
    value = lambda x: (p * np.exp(np.clip(x * s, -700, 700))).sum() - 1
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def fit_logistic(t: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    beta = np.array([math.log((w * y).sum() / max(1e-9, (w * (1 - y)).sum())), 0.1])
    x = np.stack([np.ones_like(t), t], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-2 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior_share: float = 0.05,
    z: float = 3.0,
    floor: float = 2.0,
    max_expected: float = 0.1,
) -> ToxicityModel:
    small_batches(docs.sparkSession)
    train = training_texts(docs, labels, id_col, text_col, label_col)
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicityModel(base=1.0 if 1 in n else 0.0)
    counts = written(count_tokens(train), "toxicity-counts")
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    t, o = float(total["t"] or 1), float(total["o"] or 1)
    prior = F.lit(prior_share) * (F.col("toxic") + F.col("other"))
    odds = lambda c, m: F.log((c + prior) / (F.lit(m + prior_share * (t + o)) - c - prior))
    delta = odds(F.col("toxic"), t) - odds(F.col("other"), o)
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    drawn = F.greatest(F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - F.lit(z) * error), F.lit(-floor))
    table = counts.select("place", drawn.alias("drawn")).filter("drawn <> 0").toPandas()  # 2 ** BITS places at most, and few have a score
    drawn = table["drawn"].to_numpy(float)
    model = ToxicityModel(max_expected=max_expected)
    model.scores[table["place"].to_numpy(np.int64)] = drawn
    if not (drawn > 0).any():
        return ToxicityModel(base=n[1] / (n[0] + n[1]))
    p, s = _frequencies(train, model, floor)
    # There is a root only where the tokens of other texts score below 0 on average.
    model.lam = solve_lambda(p, s) if (p * s).sum() < 0 else 0.1
    model.k = _fit_k(train, model)
    bins = _histogram(train, model)
    model.a, model.b = fit_logistic(*(np.array(x, float) for x in zip(*bins, strict=True)))
    return model


def _frequencies(train: DataFrame, model: ToxicityModel, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The share of the tokens of other texts with each score, in steps of SCORE_BIN, all occurrences counted."""
    low = -floor - DRIFT
    bins = int((float(model.scores.max()) - low) / SCORE_BIN) + 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer, counts = Scorer(model), np.zeros(bins, np.int64)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                at = np.rint((scorer.values(TOKEN.findall(text)) - low) / SCORE_BIN).astype(np.int64)
                counts += np.bincount(at, minlength=bins)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bin", "n"])

    found = train.filter("toxic = 0").select("text").mapInArrow(lean(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    s = np.concatenate([low + found["bin"].to_numpy(float) * SCORE_BIN, [float(model.scores.max())]])
    n = np.concatenate([found["n"].to_numpy(float), [0.5]])  # the best score may not be among them
    return n / n.sum(), s


def _fit_k(train: DataFrame, model: ToxicityModel) -> float:
    """K from the mean of exp(lambda s) scale: other texts' best segments against their lengths.

    For the Gumbel law with location ln(K n) / lambda, the maximum-likelihood K is the number of texts
    over the sum of n exp(-lambda best).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer, texts, weight = Scorer(model), 0, 0.0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                n, segments = scorer.segments(text)
                texts, weight = texts + 1, weight + n * math.exp(-model.lam * max((s for *_, s in segments), default=0.0))
        yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([weight])], ["texts", "weight"])

    row = train.filter("toxic = 0").select("text").mapInArrow(lean(run), "texts long, weight double").agg(F.sum("texts").alias("n"), F.sum("weight").alias("w")).first()
    return max(1e-9, row["n"] / row["w"]) if row["w"] else 1.0


def _histogram(train: DataFrame, model: ToxicityModel) -> list[tuple[float, float, float]]:
    """(statistic, label, texts) over BINS bins at most."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer, counts = Scorer(model), np.zeros((2, BINS + 1), np.int64)
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic, min(BINS, int(scorer.passages(text)[0] / BIN_WIDTH + 0.5))] += 1
        y, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y), pa.array(counts[y, at])], ["bin", "y", "n"])

    rows = train.select("text", "toxic").mapInArrow(lean(run), "bin long, y long, n long").groupBy("bin", "y").agg(F.sum("n").alias("n")).orderBy("bin", "y").collect()
    return [(r["bin"] * BIN_WIDTH, r["y"], r["n"]) for r in rows]


PASSAGE = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("score", T.DoubleType()).add("expected", T.DoubleType())


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with score, statistic and passages."""
    added = ("score", "statistic", "passages")
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", T.DoubleType()).add("statistic", T.DoubleType()).add("passages", T.ArrayType(PASSAGE))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        scorer = Scorer(model)
        for batch in sliced(batches):
            batch = batch.select(kept)
            found = [scorer.passages(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            new = [pa.array([model.probability(s) for s, _ in found], pa.float64()), pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *added])

    small_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(lean(run), schema)
