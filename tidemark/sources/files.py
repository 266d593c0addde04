"""Reading and writing the file formats of a tick archive: partitioned Parquet, JSON lines, tab-separated tables, text metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("exchange", "stream", "symbol", "date")


def archive(spark: SparkSession, path: str, schema: str, **only: Sequence[str]) -> DataFrame:
    """A partitioned archive; the named partition values prune files. Partition columns stay strings if the schema says so."""
    df = spark.read.schema(schema).parquet(path)
    for name, values in only.items():
        df = df.filter(F.col(name).isin(list(values)))
    return df


def feature_table(df: DataFrame, label: str = "label_dir_10s") -> DataFrame:
    """Time, every column named f_*, and the label; nothing else is read."""
    return df.select("ts_event", *[c for c in df.columns if c.startswith("f_")], label)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Malformed lines are left out, or fail the query if ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def with_version(df: DataFrame, version: str, column: str = "schema_version") -> DataFrame:
    """Fails on the first row of another schema version."""
    message = F.concat(F.lit(f"{column} is not {version}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return df.filter(F.when(F.col(column).eqNullSafe(F.lit(version)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def split_corrupt(spark: SparkSession, paths: Sequence[str], schema: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Paths that can be read, and those that can't with the kind of fault: missing, schema or corrupt. One small job a file."""
    good, bad = [], []
    for p in paths:
        try:
            spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(p).limit(1).collect()
            good.append(p)
        except Exception as fault:  # the kind is read from the message, as Spark has no class for each
            text = str(fault)
            kind = "missing" if "PATH_NOT_FOUND" in text else "schema" if "CONVERT" in text.upper() or "type mismatch" in text.lower() else "corrupt"
            bad.append((p, kind))
    return good, bad


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S11."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_archive(df: DataFrame, path: str, by: Sequence[str] = PARTITIONS, order: Sequence[str] = ("ts_event", "seq")) -> None:
    """K2 to K5: zstd Parquet by partition, in order within each file; Spark's commit protocol takes the place of staging and renaming."""
    df.repartition(*by).sortWithinPartitions(*by, *order).write.partitionBy(*by).option("compression", "zstd").parquet(path)


def fixed_places(df: DataFrame, places: int = 15) -> DataFrame:
    """Doubles as text with a fixed number of places."""
    return df.withColumns({c: F.format_string(f"%.{places}f", c) for c, t in df.dtypes if t in ("double", "float")})


def write_tsv(df: DataFrame, path: str, order: Sequence[str], places: int = 15) -> None:
    """K6: a report in a total order, with fixed places."""
    fixed_places(df, places).orderBy(*order).write.option("sep", "\t").option("header", True).csv(path)


def append_json(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """K7, K8: adds to a ledger of JSON lines; files are cut at a number of rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def exposition(name: str, labels: Sequence[str], value: Column) -> Column:
    """A line of the text format of metrics."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    return F.concat(F.lit(name + "{"), pairs, F.lit("} "), value.cast("string"))


def write_metrics(df: DataFrame, path: str, name: str, labels: Sequence[str], value: str) -> None:
    df.select(exposition(name, labels, F.col(value)).alias("value")).write.text(path)


def write_run(manifest: DataFrame, decisions: DataFrame, statistics: DataFrame, path: str) -> None:
    """K9: a run's three tables."""
    for name, df in (("manifest", manifest), ("decisions", decisions), ("stats", statistics)):
        df.write.json(f"{path}/{name}")


def ordered_rows(df: DataFrame, order: Sequence[str] = ("ts_event", "seq")):
    """Rows in order at the edge, a partition ahead; never the whole table at once."""
    return df.orderBy(*order).toLocalIterator(prefetchPartitions=True)


def merged_meta(metas: DataFrame, same: Sequence[str] = ("schema_version", "stream_type")) -> DataFrame:
    """Sums and extremes of metas; ``consistent`` is false where they disagree."""
    x = metas.agg(F.sum("rows").alias("rows"), F.min("ts_event_min").alias("ts_event_min"), F.max("ts_event_max").alias("ts_event_max"), *[F.countDistinct(c).alias(f"_{c}") for c in same])
    fine = F.lit(True)
    for c in same:
        fine = fine & (F.col(f"_{c}") <= 1)
    return x.withColumn("consistent", fine).drop(*[f"_{c}" for c in same])
