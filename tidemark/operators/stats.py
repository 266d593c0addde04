"""Distribution, correlation, drift and significance, as partial aggregates and windows within a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import null_safe_join, number, sorted_values, value_counts


def t_stat(value: Column) -> Column:
    """Mean over its standard error; 0 for fewer than two values or without variance."""
    sd = F.stddev_samp(value)
    return F.when((F.count(value) <= 1) | F.coalesce(F.min(value) == F.max(value), F.lit(True)), 0.0).otherwise(F.avg(value) / F.try_divide(sd, F.sqrt(F.count(value))))


def pearson(x: Column, y: Column) -> Column:
    """A10: 0 for two pairs or fewer, or where one side is constant; clipped to [-1, 1].

    Merging partial moments of a constant may leave a tiny deviation, so a constant is known by its extremes.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when((F.count(x) <= 2) | constant, 0.0).otherwise(F.coalesce(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)), F.lit(0.0)))


def corr_t(r: Column, n: Column) -> Column:
    return F.when((n <= 2) | (F.abs(r) >= 1), 0.0).otherwise(r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r)))


def _at(q: float, last: bool = False):
    """A share, and its place by index among n sorted values."""
    return q, lambda n: F.least(F.floor(F.lit(q) * (n - (1 if last else 0))), n - 1)


def index_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, last: bool = False) -> DataFrame:
    """(by, quantile): the sorted value at floor(q n), or with ``last`` at floor(q (n - 1))."""
    return sorted_values(df, by, value, {"quantile": _at(q, last)})


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """M1: moments of the population (shape 0 without variance), true median, and quartiles by index."""
    sd = F.stddev_pop(value)
    shape = lambda f: F.when(sd == 0, 0.0).otherwise(F.coalesce(F.nanvl(f(value), F.lit(0.0)), F.lit(0.0)))
    sums = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        shape(F.skewness).alias("skew"), shape(F.kurtosis).alias("excess_kurtosis"),
    )
    places = {"q1": _at(0.25), "q3": _at(0.75), "_low": (0.5, lambda n: F.floor((n - 1) / 2)), "_high": (0.5, lambda n: F.floor(n / 2))}
    out = null_safe_join(sums, sorted_values(df, by, value, places), by, "left")
    return out.withColumns({"median": (F.col("_low") + F.col("_high")) / 2, "iqr": F.col("q3") - F.col("q1")}).drop("_low", "_high")


def outliers(df: DataFrame, by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    d = distribution(df, by, value).select(*by, (F.col("q1") - k * F.col("iqr")).alias("_lo"), (F.col("q3") + k * F.col("iqr")).alias("_hi"))
    return df.join(d, list(by)).filter((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).drop("_lo", "_hi")


def ks_two_sample(df: DataFrame, by: Sequence[str], value: str, side: str) -> DataFrame:
    """M3: the largest distance of two samples' distribution functions (side 0 and 1), and its asymptotic p."""
    of = lambda k: (F.col(side) == k).cast("long")
    steps = value_counts(df.filter(F.col(side).isin(0, 1)), by, value, more={"a": of(0), "b": of(1)})
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("total_a") - (F.col("before_b") + F.col("b")) / F.col("total_b"))
    x = steps.groupBy(*by).agg(F.max(gap).alias("d"), F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"))
    n = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("d")
    term = lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * lam * lam)
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, i: s + term(i))
    return x.withColumn("p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank from 1, ties at their mean; a null has none."""
    ranks = value_counts(df, by, value).select(*by, F.col("_value").alias(value), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return null_safe_join(df, ranks, [*by, value], "left")


def label_balance(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """M7: counts, imbalance ratio and entropy of labels."""
    c = df.groupBy(*by, label).count().withColumn("_p", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))
    e = -F.sum(F.col("_p") * F.log2("_p"))
    return c.groupBy(*by).agg(
        F.sum("count").alias("n"), F.count("*").alias("labels"), (F.max("count") / F.min("count")).alias("imbalance"), e.alias("entropy"),
        F.when(F.count("*") > 1, F.try_divide(e, F.log2(F.count("*").cast("double")))).otherwise(0.0).alias("normalised_entropy"),
    )


def window_drift(df: DataFrame, by: Sequence[str], label: str, size: int = 1000) -> DataFrame:
    """M8: rows in windows of ``size`` with half overlap; drift is half the change of label shares from window to window.

    A row belongs to two windows. Windows that aren't full are left out.
    """
    half = size // 2
    x = number(df, by).withColumn("_h", F.floor(F.col("_i") / half)).withColumn("window", F.explode(F.array(F.col("_h"), F.col("_h") - 1))).filter("window >= 0")
    c = x.groupBy(*by, "window", label).count()
    full = c.groupBy(*by, "window").agg(F.sum("count").alias("_n")).filter(F.col("_n") == size).select(*by, "window")
    c = c.join(full, [*by, "window"])
    a, b = c.alias("a"), c.withColumn("window", F.col("window") + 1).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*by, "window", label)]
    key = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in (*by, "window")]
    step = F.abs(F.coalesce(F.col("a.count"), F.lit(0)) - F.coalesce(F.col("b.count"), F.lit(0))) / size
    j = a.join(b, on, "full_outer").select(*key, step.alias("_d")).groupBy(*by, "window").agg((F.sum("_d") / 2).alias("drift"))
    j = j.join(full, [*by, "window"]).join(full.withColumn("window", F.col("window") + 1), [*by, "window"], "left_semi")
    return j.withColumn("level", F.when(F.col("drift") > 0.3, "HIGH").when(F.col("drift") > 0.2, "DRIFT").otherwise("OK"))


def psi(df: DataFrame, by: Sequence[str], value: str, side: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability of side 1 against side 0, in equal bins over side 0's range; outer values go to the end bins."""
    r = df.filter(F.col(side) == 0).groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0))
    x = df.join(r, list(by)).withColumn("_bin", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)))
    c = x.groupBy(*by, "_bin").agg(F.count_if(F.col(side) == 0).alias("_a"), F.count_if(F.col(side) == 1).alias("_b"))
    totals = c.groupBy(*by).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb")).withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    c = totals.join(c, [*by, "_bin"], "left").fillna(0, ["_a", "_b"])
    p, q = F.greatest(F.col("_a") / F.col("_na"), F.lit(floor)), F.greatest(F.col("_b") / F.col("_nb"), F.lit(floor))
    out = c.groupBy(*by).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return out.withColumn("level", F.when(F.col("psi") < 0.1, "STABLE").when(F.col("psi") < 0.25, "SHIFT").otherwise("UNSTABLE"))


def normal_cdf(x: Column) -> Column:
    """Polynomial form, seven places (constants are fixed values)."""
    k = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def welch(df: DataFrame, by: Sequence[str], value: str, hit: str) -> DataFrame:
    """Rows that match a pattern against those that don't, with population variances.

    p is normal beyond 30 degrees of freedom; up to these, t is first scaled by sqrt(df / (df + 1)). Without rows on
    a side, or without variance on both, t and df are 0 and p is 1.
    """
    part = lambda f, h: f(F.when(F.col(hit) == h, F.col(value)))
    x = df.groupBy(*by).agg(*[part(f, h).alias(f"{n}_{k}") for h, k in ((True, "in"), (False, "out")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_pop, "var"))])
    a, b = F.col("var_in") / F.col("n_in"), F.col("var_out") / F.col("n_out")
    known = (F.col("n_in") > 0) & (F.col("n_out") > 0) & (a + b > 0)
    df_ = F.try_divide((a + b) * (a + b), F.coalesce(F.try_divide(a * a, F.col("n_in") - 1), F.lit(0.0)) + F.coalesce(F.try_divide(b * b, F.col("n_out") - 1), F.lit(0.0)))
    x = x.withColumn("t", F.when(known, (F.col("mean_in") - F.col("mean_out")) / F.sqrt(a + b)).otherwise(0.0)).withColumn("df", F.when(known, df_).otherwise(0.0))
    z = F.abs("t") * F.when(F.col("df") > 30, 1.0).otherwise(F.sqrt(F.col("df") / (F.col("df") + 1)))
    return x.withColumn("p", F.when(known, 2 * (1 - normal_cdf(z))).otherwise(1.0)).drop("var_in", "var_out")


def threshold_grid(df: DataFrame, by: Sequence[str], truth: Column, value: str, thresholds: Sequence[float] = (0.5, 0.55, 0.6, 0.65, 0.7)) -> DataFrame:
    """The confusion at each threshold, and ``best`` at the lowest with a group's largest F1 (nowhere, if all are null)."""
    x = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    c = confusion(x, [*by, "threshold"], truth, F.col(value) >= F.col("threshold"))
    w = Window.partitionBy(*by).orderBy(F.col("f1").desc_nulls_last(), "threshold")
    return c.withColumn("best", (F.row_number().over(w) == 1) & F.col("f1").isNotNull())


def correlation_clusters(matrix: DataFrame, names: Sequence[str], threshold: float = 0.8, top: int = 5) -> DataFrame:
    """M5: (feature, cluster, redundancy) from one row with a column a_b for each pair of names in order.

    A feature joins the first earlier feature that leads a cluster and correlates with it by the threshold, or leads its own.
    Redundancy is the mean of the largest ``top`` absolute correlations of all pairs.
    """
    seeds = []
    for j, name in enumerate(names):
        joins = [F.when((seeds[i] == i) & (F.abs(F.col(f"{names[i]}_{name}")) >= threshold), i) for i in range(j)]
        seeds.append(F.coalesce(*joins, F.lit(j)))
    sizes = F.array_sort(F.array(*[F.abs(F.col(f"{a}_{b}")) for i, a in enumerate(names) for b in names[i + 1 :]]), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    best = F.slice(sizes, 1, top)
    mean = F.try_divide(F.aggregate(best, F.lit(0.0), lambda s, v: s + v), F.size(best))
    labels = F.array(*map(F.lit, names))
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.element_at(labels, s + 1).alias("cluster")) for n, s in zip(names, seeds, strict=True)])
    return matrix.select(F.explode(rows).alias("x"), F.coalesce(mean, F.lit(0.0)).alias("redundancy")).select("x.*", "redundancy")


def confusion(df: DataFrame, by: Sequence[str], truth: Column, guess: Column) -> DataFrame:
    """Counts and rates of a two-class prediction; precision is null without positive guesses."""
    n = lambda c: F.count_if(c)
    x = df.groupBy(*by).agg(n(truth & guess).alias("tp"), n(~truth & guess).alias("fp"), n(~truth & ~guess).alias("tn"), n(truth & ~guess).alias("fn"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    x = x.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "specificity": share("tn", "fp")})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return x.withColumns({"f1": f1, "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2}).drop("specificity")


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins of [0, 1]; values are clamped, the last bin is closed, empty bins are 0."""
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    c = df.groupBy(*by, F.least(F.floor(v * bins), F.lit(bins - 1)).alias("bin")).count()
    grid = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(c, [*by, "bin"], "left").fillna(0, ["count"]).withColumnRenamed("count", "n")


def calibration(df: DataFrame, value: str, label: Column, bins: int) -> DataFrame:
    """R2: count, mean probability and share of positives of each bin."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("avg_p"), F.avg(label.cast("int")).alias("win_rate"))


def label_ranking(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """M6: (feature, correlation, size, strength, rank) of features by the size of their correlation with a label; an unknown one has size 0. Equal sizes go by name."""
    found = df.agg(*[pearson(F.col(f), F.col(label)).alias(f) for f in features])
    x = found.unpivot([], list(features), "feature", "correlation").withColumn("size", F.coalesce(F.abs("correlation"), F.lit(0.0)))
    size = F.col("size")
    strength = F.when(size >= 0.5, "STRONG").when(size >= 0.3, "MODERATE").when(size >= 0.1, "WEAK").otherwise("NEGLIGIBLE")
    return x.withColumns({"strength": strength, "rank": F.row_number().over(Window.orderBy(F.desc("size"), "feature"))})  # a row a feature


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(by, n, lo, hi, a column a share): rows, least and largest value, and percentiles that lie between two values in proportion.

    The two values come from :func:`tidemark.operators.scans.sorted_values`, so no task holds a key's values.
    """
    at = lambda share, n: F.lit(float(share)) * (n - 1)
    places = {f"_{side}_{name}": (share, (lambda n, share=share, end=end: end(at(share, n)))) for name, share in shares.items() for side, end in (("low", F.floor), ("high", F.ceil))}
    x = df.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("_known"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = null_safe_join(x, sorted_values(df, by, value, places), by, "left")
    for name, share in shares.items():
        place, low, high = at(share, F.col("_known")), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        x = x.withColumn(name, F.when(F.ceil(place) == F.floor(place), low).otherwise(between))
    return x.drop("_known", *places)
