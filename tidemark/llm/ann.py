"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Learning, on a bounded sample (``max_sample`` vectors with the smallest hashes of their ids): the k-nearest-neighbour
graph is cut into balanced parts by recursive bisection, each cut refined by swapping pairs that lower
the number of cut edges. A small softmax classifier is fitted to each vector's own and its
neighbours' parts. Index: every vector goes to its most probable part. Search: a query goes to its
most probable parts, and on to further ones while these hold too few candidates; all vectors there are
compared exactly, in double precision. How many parts: ``probes``, or more where these don't reach
``least_recall``. For that, ``measured`` of the queries are compared with the whole table, and the fewest parts
are taken whose recall among them, less two standard errors, is high enough; all parts always are.

Parts are cut in blocks of ``block_rows`` vectors and ``query_rows`` queries; a task holds one block of
each, whatever the part's size, and sends on each query's best ``k``. Only counts by part reach the driver.

Defined results: a vector that is null, zero, holds a null or non-finite component, or whose length
isn't the table's most frequent (the smaller of two), takes no part, nor does a row without id. Rows
with equal ids are one candidate with its best score, and as a query the least of their vectors.
Ties go to the smaller id. With fewer candidates than ``k``, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

SLACK = 1e-9  # of a product's rounding, beyond which no candidate can be among the best


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) to each unit vector's k nearest others."""
    k = min(k, len(x) - 1)
    out = []
    for at in range(0, len(x), 128):  # few rows at once: this is the driver's memory
        near = x[at : at + 128] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.repeat(np.arange(len(x)), k), np.concatenate(out).ravel()


def _bisect(x: np.ndarray, u: np.ndarray, v: np.ndarray, left_share: float, rounds: int = 30) -> np.ndarray:
    """True for the vectors of the left side, ``left_share`` of all; u, v are edges among them."""
    centred = x - x.mean(axis=0)
    direction = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(30):
        direction = centred.T @ (centred @ direction)
        direction /= max(np.linalg.norm(direction), 1e-300)
    left = np.zeros(len(x), bool)
    left[np.argsort(centred @ direction, kind="stable")[: round(left_share * len(x))]] = True
    for _ in range(rounds):
        across = np.where(left[u] != left[v], 1, -1)
        gain = np.bincount(u, across, len(x)) + np.bincount(v, across, len(x))
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swaps = int((gain[a[:n]] + gain[b[:n]] > 0).sum())
        if not swaps:
            break
        swaps = min(swaps, max(1, len(x) // 20))
        left[a[:swaps]], left[b[:swaps]] = False, True
    return left


def balanced_parts(x: np.ndarray, u: np.ndarray, v: np.ndarray, parts: int) -> np.ndarray:
    """A part for each vector; sizes differ by rounding only."""
    out = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        own, first, n = todo.pop()
        if n == 1 or len(own) < 2:
            out[own] = first
            continue
        place = np.full(len(x), -1)
        place[own] = np.arange(len(own))
        inside = (place[u] >= 0) & (place[v] >= 0)
        left = _bisect(x[own], place[u[inside]], place[v[inside]], (n // 2) / n)
        todo += [(own[left], first, n // 2), (own[~left], first + n // 2, n - n // 2)]
    return out


@dataclass
class Router:
    """A softmax over parts of a unit vector."""

    weights: np.ndarray
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    @property
    def parts(self) -> int:
        return len(self.bias)


def fit_router(x: np.ndarray, targets: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> Router:
    """Cross-entropy against soft targets, by Adam on all rows at once."""
    w, b = np.zeros((x.shape[1], targets.shape[1])), np.log(targets.mean(axis=0) + 1e-6)
    m, s = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (p - targets) / len(x)
        for i, (value, grad) in enumerate(((w, x.T @ miss + decay * w), (b, miss.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.99 * s[i] + 0.01 * grad * grad
            value -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-10)
    return Router(w, b)


def learn(sample: np.ndarray, parts: int, k: int = 10) -> Router:
    x = unit(sample)
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    u, v = neighbour_graph(x, k)
    label = balanced_parts(x, u, v, parts)
    targets = np.zeros((len(x), parts))
    np.add.at(targets, (u, label[v]), 0.5 / (len(v) / len(x)))
    targets[np.arange(len(x)), label] += 0.5
    return fit_router(x, targets)


def best_in_block(ids: np.ndarray, base: np.ndarray, query_id: int, query: np.ndarray, approximate: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best of a block by exact score, then id; approximate scores only leave out what can't be among them."""
    others = ids != query_id
    approximate = np.where(others, approximate, -np.inf)
    n = int(others.sum())
    if not n:
        return []
    bar = np.partition(approximate, len(ids) - min(4 * k, n))[len(ids) - min(4 * k, n)] - SLACK
    near = np.flatnonzero(approximate >= bar)
    near = near[ids[near] != query_id]
    v = base[near]
    score = (v * query).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((query * query).sum()))
    out, seen = [], set()
    for i in np.lexsort((ids[near], -score)):
        name = int(ids[near[i]])
        if name not in seen:
            seen.add(name)
            out.append((name, float(score[i])))
            if len(out) == k:
                return out
    if len(near) < n:  # repeated ids filled the places
        return best_in_block(ids, base, query_id, query, np.where(others, np.inf, -np.inf), k)
    return out


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, n): v is an array of doubles of the table's most frequent length."""
    v = df[vector_col].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    x = df.select(df[id_col].cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    return x.withColumn("n", F.size("v"))


def matrix(vectors: DataFrame, n: int) -> np.ndarray:
    """A bounded frame of one column of vectors of length n, without a Python object for each number."""
    column = vectors.toArrow().column(0)
    return np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]]).reshape(-1, n)


def probes_for(indexed: DataFrame, queries: DataFrame, router: Router, k: int, least_recall: float, measured: int) -> int:
    """The fewest parts whose recall on ``measured`` queries against all of (id, v, part) is high enough."""
    chosen = queries.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(measured).toPandas()
    if chosen.empty:
        return 0
    own, q = chosen["id"].to_numpy(), unit(np.stack(chosen["v"].to_numpy()).astype(float))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int32)]
        for batch in batches:
            for at in range(0, len(batch), 4096):
                rows = batch.iloc[at : at + 4096]
                ids, part = rows["id"].to_numpy(), rows["part"].to_numpy()
                near = q @ unit(np.stack(rows["v"].to_numpy())).T
                near[ids == own[:, None]] = -np.inf
                keep = np.argpartition(-near, min(4 * k, len(ids)) - 1, axis=1)[:, : 4 * k]
                best = [np.concatenate(two, axis=1) for two in zip(best, (np.take_along_axis(near, keep, 1), ids[keep], part[keep]), strict=True)]
                keep = np.argsort(-best[0], axis=1, kind="stable")[:, : 4 * k]
                best = [np.take_along_axis(b, keep, 1) for b in best]
        query = np.repeat(np.arange(len(q)), best[0].shape[1])
        out = pd.DataFrame({"query": query, "id": best[1].ravel(), "part": best[2].ravel(), "score": best[0].ravel()})
        yield out[out["score"] > -np.inf]

    found = indexed.mapInPandas(nearest, "query long, id long, part int, score double")
    found = found.groupBy("query", "id").agg(F.max_by("part", "score").alias("part"), F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "part").toPandas()
    if true.empty:
        return 0
    turn = np.argsort(np.argsort(-router.logits(q), axis=1, kind="stable"), axis=1)
    hits = np.zeros((len(q), router.parts))
    np.add.at(hits, (true["query"], turn[true["query"], true["part"]]), 1)
    hits = hits[hits.sum(axis=1) > 0]
    recall = hits.cumsum(axis=1) / hits.sum(axis=1, keepdims=True)
    return 1 + int(np.argmax(recall.mean(axis=0) - 2 * recall.std(axis=0) / np.sqrt(len(recall)) >= min(least_recall, 1.0) - 1e-12))


def search(
    df: DataFrame,
    k: int = 5,
    query_every: int = 50,
    probes: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    max_parts: int = 1024,
    max_sample: int = 8192,
    block_rows: int = 4096,
    query_rows: int = 1024,
    least_recall: float = 0.9,
    measured: int = 128,
    parts: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_every``."""
    spark = df.sparkSession
    x = valid_vectors(df, id_col, vector_col)
    sizes = x.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    x, n = x.filter(F.col("n") == sizes["n"]).select("id", "v"), sizes["count"]
    parts = parts or int(min(max_parts, 2 ** round(np.log2(max(1.0, np.sqrt(n) / 8)))))
    router = learn(matrix(x.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(max_sample).select("v"), sizes["n"]), parts)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["part"] = router.logits(unit(np.stack(batch["v"].to_numpy()))).argmax(axis=1).astype(np.int32)
                yield batch

    indexed = written(x.mapInPandas(assign, "id long, v array<double>, part int"), "ann-index")
    counts = np.zeros(router.parts, np.int64)
    for r in indexed.groupBy("part").count().collect():
        counts[r["part"]] = r["count"]
    queries = x.filter(F.pmod("id", F.lit(query_every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    if router.parts > probes:
        probes = max(probes, probes_for(indexed, queries, router, k, least_recall, measured))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            order = np.argsort(-router.logits(unit(np.stack(batch["v"].to_numpy()))), axis=1, kind="stable")
            enough = (counts[order].cumsum(axis=1) < 4 * k).sum(axis=1) + 1
            yield batch.assign(part=[o[: max(probes, e)].astype(np.int32) for o, e in zip(order, enough, strict=True)])

    routed = queries.mapInPandas(route, "id long, v array<double>, part array<int>").select("id", "v", F.explode("part").alias("part"))
    routed = written(routed, "ann-queries")
    asked = np.zeros(router.parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    blocks, query_blocks = np.maximum(1, -(-counts // block_rows)), np.maximum(1, -(-asked // query_rows))

    def by_part(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(b)) for b in values]), F.col("part") + 1)

    def dealt(rows: DataFrame, own: str, n_own, other: str, n_other) -> DataFrame:
        """Each row's own block, once for every block of the other side."""
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), n_own).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1)))

    base = dealt(indexed, "block", by_part(blocks), "query_block", by_part(query_blocks))
    asks = dealt(routed, "query_block", by_part(query_blocks), "block", by_part(blocks))
    key = ["part", "block", "query_block"]

    def compare(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(asks):
            ids, v = base["id"].to_numpy(), np.stack(base["v"].to_numpy())
            q = np.stack(asks["v"].to_numpy())
            near = unit(q) @ unit(v).T
            v, q = v / np.abs(v).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
            for i, name in enumerate(asks["id"]):
                out += [(name, *best) for best in best_in_block(ids, v, name, q[i], near[i], k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = base.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
