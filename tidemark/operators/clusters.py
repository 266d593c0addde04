"""Clusters of rows by k-means on z-scores, and what a cluster says of a return.

The fit is Spark's own, over all rows; only k centroids reach the driver. Rows are labelled by expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import welch


@dataclass
class Clusters:
    """Centroids in the columns' own units, ordered by value, and each one's largest distance to a member of the fit."""

    columns: list[str]
    centroids: list[list[float]]
    reach: list[float]


def label(df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Adds cluster and distance: the nearest centroid in the columns' own units, ties to the smaller; null where a column is null or NaN."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    far = []
    for i, centre in enumerate(centroids):
        gaps = [(F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, centre, strict=True)]
        far.append(F.struct(F.sqrt(sum(gaps[1:], gaps[0])).alias("d"), F.lit(i).alias("i")))
    near = F.array_min(F.array(*far))
    return df.withColumn("_near", F.when(known, near)).withColumns({"cluster": F.col("_near.i"), "distance": F.col("_near.d")}).drop("_near")


def fit(df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 42, rounds: int = 100, tolerance: float = 1e-4) -> Clusters:
    """K-means++ on z-scores (a constant column counts as deviation 1). Rows with a missing value don't teach; no rows give no centroids."""
    columns = list(columns)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    x = x.filter(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns))
    moments = x.agg(F.count("*").alias("n"), *[f(c).alias(f"{i}{n}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return Clusters(columns, [], [])
    mean, sd = [moments[f"{i}m"] for i in range(len(columns))], [moments[f"{i}s"] or 1.0 for i in range(len(columns))]
    z = x.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in zip(columns, mean, sd, strict=True)])
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=tolerance, featuresCol="_z").fit(VectorAssembler(inputCols=columns, outputCol="_z").transform(z).select("_z"))
    centroids = sorted([float(v) * s + m for v, m, s in zip(c, mean, sd, strict=True)] for c in model.clusterCenters())
    reach = {r["cluster"]: r["d"] for r in label(x, columns, centroids).groupBy("cluster").agg(F.max("distance").alias("d")).collect()}
    return Clusters(columns, centroids, [reach.get(i) or 1.0 for i in range(len(centroids))])


def predict(df: DataFrame, clusters: Clusters, least_confidence: float = 0.3) -> DataFrame:
    """Adds cluster, distance, confidence (1 - distance / the cluster's reach, 0 at least) and cluster_regime, null below the least confidence."""
    if not clusters.centroids:
        empty = {"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double"), "confidence": F.lit(0.0), "cluster_regime": F.lit(None).cast("int")}
        return df.withColumns(empty)
    x = label(df, clusters.columns, clusters.centroids)
    reach = F.element_at(F.array(*map(F.lit, clusters.reach)), F.col("cluster") + 1)
    x = x.withColumn("confidence", F.coalesce(F.greatest(1 - F.col("distance") / reach, F.lit(0.0)), F.lit(0.0)))
    return x.withColumn("cluster_regime", F.when(F.col("confidence") >= least_confidence, F.col("cluster")))


def cluster_scan(df: DataFrame, clusters: Clusters, value: str) -> DataFrame:
    """Each cluster's rows against all others' (``welch`` on a value); rows without a cluster are among the others."""
    x = predict(df, clusters).select("cluster", F.col(value).alias("_value"))
    ids = F.array(*[F.lit(i) for i in range(len(clusters.centroids))]).cast("array<int>")
    x = x.withColumnRenamed("cluster", "_own").withColumn("cluster", F.explode(ids))
    return welch(x.withColumn("_hit", F.coalesce(F.col("_own") == F.col("cluster"), F.lit(False))), ["cluster"], "_value", "_hit")
