"""What to change about edges and families: proposals from features' importance, and families by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import first_of

#: A feature used by less than this share of the edges that it correlates with is new to them.
RARELY_USED = 0.3


def proposals(
    importance: DataFrame, conditions: DataFrame, edges: DataFrame, high: float = 0.6, low: float = 0.15, prune_edges: int = 3, correlated: float = 0.5
) -> DataFrame:
    """(kind, edge, feature, action, priority, value, edges, used) from (edge, feature, importance, correlation).

    ``conditions`` are the (edge, feature) that edges' definitions use, ``edges`` the registered ones. WEIGHT_ADJUST, one for each edge and
    feature of ``high`` importance: a feature in use gets another threshold, another one is added. PRUNE_CANDIDATE: features below ``low`` in
    ``prune_edges`` edges or more, registered or not. NEW_FEATURE_SIGNAL: features whose mean size of correlation over registered edges is
    ``correlated`` or more, and which few of them use. ``value`` is what was compared: importance, mean importance, mean correlation.
    An unknown importance proposes nothing; an unknown correlation doesn't count in the mean. Repeated conditions and edges count
    once; repeated rows of importance count each.
    """
    used = conditions.select("edge", "feature", F.lit(True).alias("_used")).distinct()
    known = edges.select("edge", F.lit(True).alias("_known")).distinct()
    x = importance.select("edge", "feature", "importance", "correlation").join(used, ["edge", "feature"], "left").join(known, ["edge"], "left")
    x = x.withColumns({"_used": F.coalesce("_used", F.lit(False)), "_known": F.coalesce("_known", F.lit(False))})
    weight = x.filter(F.col("_known") & (F.col("importance") >= high)).select(
        F.lit("WEIGHT_ADJUST").alias("kind"), "edge", "feature", F.when(F.col("_used"), "REFINE_THRESHOLD").otherwise("ADD_CONDITION").alias("action"),
        F.when(F.col("_used"), "MEDIUM").otherwise("HIGH").alias("priority"), F.col("importance").alias("value"), F.lit(1).cast("long").alias("edges"), F.col("_used").cast("long").alias("used"),
    )
    unimportant = F.col("importance") < low
    f = x.groupBy("feature").agg(
        F.count_if(unimportant).alias("_low"), F.avg(F.when(unimportant, F.col("importance"))).alias("_mean"), F.count_if("_known").alias("_edges"),
        F.avg(F.when(F.col("_known"), F.abs("correlation"))).alias("_corr"), F.count_if(F.col("_known") & F.col("_used")).alias("_uses"),
    )
    prune = F.when(F.col("_low") >= prune_edges, F.struct(
        F.lit("PRUNE_CANDIDATE").alias("kind"), F.lit("REMOVE").alias("action"), F.when(F.col("_low") >= 5, "HIGH").otherwise("MEDIUM").alias("priority"), F.col("_mean").alias("value"),
        F.col("_low").alias("edges"), F.lit(None).cast("long").alias("used"),
    ))
    new = F.when((F.col("_corr") >= correlated) & (F.col("_uses") < F.col("_edges") * RARELY_USED), F.struct(
        F.lit("NEW_FEATURE_SIGNAL").alias("kind"), F.lit("ADD_TO_SCAN").alias("action"), F.when(F.col("_corr") > 0.7, "HIGH").otherwise("MEDIUM").alias("priority"), F.col("_corr").alias("value"),
        F.col("_edges").alias("edges"), F.col("_uses").alias("used"),
    ))
    both = f.select("feature", F.explode(F.array_compact(F.array(prune, new))).alias("p"))
    return weight.unionByName(both.select("p.*", "feature").withColumn("edge", F.lit(None).cast(x.schema["edge"].dataType)))


# Fixed values of the roles: family, role, and what may become of it as a strategy, at run time and on paper.
DIRECTIONAL = ("PRIMARY_DIRECTIONAL", "PRIMARY_DIRECTIONAL_NOT_IN_TRANSLATOR_SCOPE", "NO_RUNTIME_BINDING_FOR_FAMILY", "PRIMARY_DIRECTIONAL_BUT_NOT_IMPLEMENTED")
GUARD = ("CONTEXT_GUARD", "NOT_FOR_DIRECT_STRATEGY_TRANSLATION", "NOT_FOR_DIRECT_RUNTIME_BINDING", "SUPPORT_ONLY_CONTEXT_FAMILY")
ROLES = (
    ("family_a_patternscanner", "DISCOVERY_RESEARCH", "NOT_FOR_DIRECT_STRATEGY_TRANSLATION", "NOT_FOR_DIRECT_RUNTIME_BINDING", "RESEARCH_ONLY_NOT_READY"),
    ("family_b_simple_momentum", *DIRECTIONAL),
    ("return_reversal_v1", *DIRECTIONAL),
    ("volatility_clustering_v1", *GUARD),
    ("spread_reversion_v1", "CONTEXT_GUARD", "CURRENT_TRANSLATABLE_SUBSET_PRESENT", "CURRENT_BOUND_RUNTIME_PRESENT", "SUPPORT_ONLY_NON_DIRECTIONAL"),
    ("momentum_v1", *DIRECTIONAL),
    ("volume_vol_link_v1", *GUARD),
    ("jump_reversion_v1", *DIRECTIONAL),
)
ROLE_COLUMNS = ("family", "role", "translation", "binding", "paper")


def family_roles(reports: DataFrame, specs: DataFrame, bindings: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Every family with its role and what there is of it: reports (family, pack), specs and bindings (family, status).

    ``families`` (family, ROLE_COLUMNS' rest) may add to or replace ROLES. A family that is listed nowhere has the role UNKNOWN, so that a report isn't
    lost; reports without a family are left out. A spec counts if TRANSLATABLE, a binding if BOUND_SHADOW_RUNNABLE.
    """
    roles = families if families is not None else reports.sparkSession.createDataFrame(ROLES, list(ROLE_COLUMNS))
    n = lambda df, wanted, name: df.filter((F.col("status") == wanted) & F.col("family").isNotNull()).groupBy("family").agg(F.count("*").alias(name))
    x = reports.filter("family is not null").groupBy("family").agg(F.count("*").alias("reports"), F.count_distinct("pack").alias("packs"))
    x = roles.join(x, ["family"], "full").join(n(specs, "TRANSLATABLE", "translated"), ["family"], "full").join(n(bindings, "BOUND_SHADOW_RUNNABLE", "bound"), ["family"], "full")
    x = x.fillna(0, ["reports", "packs", "translated", "bound"]).fillna("UNKNOWN", [c for c in roles.columns if c != "family"])
    support = F.col("role") == "CONTEXT_GUARD"
    return x.withColumns({"translatable_now": F.col("translated") > 0, "bindable_now": F.col("bound") > 0, "use_now": first_of((support, "SUPPORT_ONLY"), default="NOT_READY")})
