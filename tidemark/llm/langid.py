"""Language identification with a blended-spectrum string kernel.

Two texts' kernel value is the number of character n-grams (n from 1 to 4, hashed to 2 ** BITS places)
that both hold, over the geometric mean of each text's own number: presence counts, not frequency.
Nyström: a bounded sample of labelled texts are landmarks, and a text is described by its kernel values
with them, whitened by the landmarks' own kernel matrix. One-versus-rest kernel ridge regression is fitted
in that space on a bounded sample, whose kernel values are computed where its texts are. As the map from
n-grams to kernel values to class scores is linear, it is folded into one matrix, n-grams by classes, and
texts are scored by products of batches of their sparse presence rows with it. A text's score is its best
class's, brought to 0 to 1 and scaled by the share of its letters that landmarks hold: a script that nothing was
learned from has score 0.

The sample's bounds are the parameters ``landmarks_per_class`` and ``fit_per_class``: of all rows of a
class, those with the smallest hashes, found among the fraction of hashes that holds enough. Every text is scored whole. A text of a million
characters is hashed in pieces that overlap and fills the same places as in one.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
where there is nothing to learn from. Repeated rows get the same result, up to the rounding of
single-precision sums. Rows with a null label, or left out by ``learn_from``, teach nothing. Columns
lang_pred and score of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import lean, sliced, small_batches, written

BITS = 18
N_GRAMS = (1, 2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20  # characters hashed at a time


def _letters() -> np.ndarray:
    """Code point to lower-case letter; anything but a letter becomes a space."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The code points of a text's letters in lower case."""
    if not _TABLE:
        _TABLE.append(_letters())
    chars = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    found = chars[chars != 32]
    return found if len(found) else np.array([32], np.uint32)  # a letter that Python's table has not


def presence(text: str, places: np.ndarray | None = None) -> np.ndarray:
    """The places of all n-grams of a text, ascending, spaces around it included; ``places`` is a reused row of zeros."""
    if not _TABLE:
        _TABLE.append(_letters())
    out = np.zeros(1 << BITS, bool) if places is None else places
    mask = np.uint32((1 << BITS) - 1)
    padded = " " + text + " "
    for at in range(0, len(padded), _PIECE):
        chars = _TABLE[0][np.frombuffer(padded[at : at + _PIECE + max(N_GRAMS) - 1].encode("utf-32-le", "surrogatepass"), "<u4")]
        rolling = np.zeros(len(chars), np.uint32)
        for n in range(1, max(N_GRAMS) + 1):
            if len(chars) < n:
                break
            rolling = rolling[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :] + np.uint32(n)
            if n in N_GRAMS:
                mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                out[(mixed >> np.uint32(13)) & mask] = True
    found = np.flatnonzero(out)
    out[found] = False
    return found


def products(rows: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Rows of a sparse 0/1 matrix, given by their places, times a dense one."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), matrix.shape[1]))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(matrix[np.concatenate([rows[i] for i in full])], starts, axis=0)
    return out


def norms(rows: list[np.ndarray]) -> np.ndarray:
    return np.sqrt(np.maximum([len(r) for r in rows], 1))


@dataclass
class KernelModel:
    """The landmarks' presence rows folded with the whitening and ridge weights: n-gram to class."""

    classes: list[str]
    weights: np.ndarray  # 2 ** BITS by classes
    bias: np.ndarray
    alphabet: np.ndarray  # code points of the landmarks' letters

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return products(rows, self.weights) / norms(rows)[:, None] + self.bias


def kernel(rows: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Kernel values of rows with landmarks."""
    held = np.zeros((1 << BITS, len(landmarks)), bool)
    for i, places in enumerate(landmarks):
        held[places, i] = True
    shared = np.array([held[r].sum(axis=0, dtype=np.int64) for r in rows]).reshape(len(rows), len(landmarks))
    return shared / norms(rows)[:, None] / norms(landmarks)


def fit(landmarks: list[np.ndarray], k_xl: np.ndarray, labels: list[str], alphabet: np.ndarray, ridge: float = 1e-3) -> KernelModel:
    """Ridge regression from the landmarks and the kernel values of labelled texts with them."""
    classes = sorted(set(labels))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    kept = values > 1e-8 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = k_xl @ whiten
    targets = np.where(np.array(labels)[:, None] == np.array(classes), 1.0, -1.0)
    mean, target_mean = features.mean(0), targets.mean(0)
    centred = features - mean
    gram = centred.T @ centred + ridge * len(labels) * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, centred.T @ (targets - target_mean))
    parts = whiten @ beta / norms(landmarks)[:, None]
    weights = np.zeros((1 << BITS, len(classes)))
    for places, own in zip(landmarks, parts, strict=True):
        weights[places] += own
    return KernelModel(classes, weights.astype(np.float32), (target_mean - mean @ beta).astype(np.float32), alphabet)


def crc_mod(id_col: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def learn(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    landmarks_per_class: int = 64,
    fit_per_class: int = 400,
    ridge: float = 1e-3,
) -> KernelModel | None:
    """Fits on the ``fit_per_class`` texts of each class with the smallest hashes, the first of them as landmarks."""
    x = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[label_col].alias("label"))
    x = x.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    x = x.withColumn("h", F.xxhash64("id", "text"))
    # Different texts set the fraction of hashes that is looked at, so a class of repeated rows is not missed.
    counts = {r["label"]: r["n"] for r in x.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    order = F.col("h").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    fraction = lambda n: min(1.0, 1.5 * fit_per_class / n + 20 / n)
    wanted = F.lit(False)
    for label, n in sorted(counts.items()):
        wanted = wanted | ((F.col("label") == label) & (order < F.lit(fraction(max(1, n)))))
    keys = x.filter(wanted).select("label", "h").distinct()  # repeated rows teach once
    by_hash = Window.partitionBy("label").orderBy("h")
    keys = keys.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= fit_per_class)
    chosen = x.join(F.broadcast(keys), ["label", "h"]).select("label", "rank", "text").dropDuplicates(["label", "rank"])
    chosen = written(chosen, "language-sample")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [presence(t).astype("<u4").tobytes() for t in batch["text"]]
            own = [np.unique(letters(t)).astype("<u4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "rank": batch["rank"], "places": packed, "letters": own})

    first = chosen.filter(F.col("rank") <= landmarks_per_class)
    rows = first.mapInPandas(encode, "label string, rank int, places binary, letters binary").orderBy("label", "rank").collect()
    if not rows:
        return None
    landmarks = [np.frombuffer(r["places"], "<u4").astype(np.int64) for r in rows]
    alphabet = np.unique(np.concatenate([np.frombuffer(r["letters"], "<u4") for r in rows]))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = kernel([presence(t) for t in batch["text"]], landmarks)
                yield pd.DataFrame({"label": batch["label"], "rank": batch["rank"], "k": list(values)})

    sample = chosen.mapInPandas(describe, "label string, rank int, k array<double>")
    sample = sample.orderBy("label", "rank").toPandas()
    return fit(landmarks, np.stack(sample["k"].to_numpy()), sample["label"].tolist(), alphabet, ridge)


def identify(docs: DataFrame, model: KernelModel | None, text_col: str = "text", batch_rows: int = 128) -> DataFrame:
    """docs with lang_pred and score, from 0 to 1."""
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches):
        import pyarrow as pa

        places, known = np.zeros(1 << BITS, bool), np.zeros(0x110000, bool)
        if model:
            known[model.alphabet] = True
        for batch in sliced(batches, batch_rows):
            batch = batch.select(kept)
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            labels, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            spoken = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model else []
            if spoken:
                found = model.scores([presence(texts[i], places) for i in spoken])
                best = found.argmax(1)
                labels[spoken] = np.array(model.classes, object)[best]
                share = np.array([known[letters(texts[i])].mean() for i in spoken])
                scores[spoken] = np.clip((found[np.arange(len(spoken)), best] + 1) / 2, 0, 1) * share
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels.tolist(), pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(lean(run), schema)

