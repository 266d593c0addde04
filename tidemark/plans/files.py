"""Queries over file formats and streams: the ticks are written, read back or streamed, and must be what they were."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import shared_folder
from ..sources import files
from ..sources.events import QUOTES_SQL, TICKS_SQL, quotes, ticks
from ..streaming import ledgers, live, stateful
from .features import whole_stream
from .registry import Catalogue, rounded

CAT = Catalogue()
ROW = "ts_event long, seq long, symbol long, stream string, price double"
COLS = ["ts_event", "seq", "symbol", "stream", "price"]
FILE_ROWS = 500_000  # of a streamed file, of which a batch takes two


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@CAT.add("K2_S12_archive", f"WITH {TICKS_SQL} SELECT ts_event, seq, symbol, stream, price, week::VARCHAR AS week FROM ticks WHERE stream IN ('click', 'view')")
def archive(spark, sf_dir):
    """A sorted archive by stream and week, of which a filter opens two streams' folders only."""
    path = folder(spark)
    files.write_archive(ticks(spark, sf_dir).select(*COLS, F.col("week").cast("string").alias("week")), path, ("stream", "week"))
    return files.archive(spark, path, "ts_event long, seq long, symbol long, price double, stream string, week string", stream=["click", "view"])


@CAT.add("K7_S9_json_ledger", f"WITH {TICKS_SQL} SELECT ts_event, seq, symbol, stream, price FROM ticks")
def json_ledger(spark, sf_dir):
    """A ledger of JSON lines that grows by two batches; broken lines between them are left out."""
    path, t = folder(spark), ticks(spark, sf_dir).select(*COLS)
    for k in (0, 1):
        files.append_json(t.filter(F.col("seq") % 2 == k), path, 10_000)
    t.filter("seq % 50 = 0").select(F.concat(F.lit('{"seq": '), F.col("seq"), F.lit(", broken"))).write.mode("append").text(path)
    return files.json_lines(spark, path, ROW)


@CAT.add("S10_strict_json", f"WITH {TICKS_SQL} SELECT stream, count(*) AS n, '1.0' AS schema_version FROM ticks GROUP BY 1")
def strict_json(spark, sf_dir):
    """Every line has to be whole and of the version that is asked for."""
    path = folder(spark)
    files.append_json(ticks(spark, sf_dir).select("stream", F.lit("1.0").alias("schema_version")), path)
    checked = files.with_version(files.json_lines(spark, path, "stream string, schema_version string", strict=True), "1.0")
    return checked.groupBy("stream", "schema_version").agg(F.count("*").alias("n"))


@CAT.add("K6_S11_tab_separated", f"WITH {TICKS_SQL} SELECT ts_event, seq, symbol, stream, price FROM ticks")
def tab_separated(spark, sf_dir):
    """A report in a total order with fixed places, read by its header."""
    path = folder(spark)
    files.write_tsv(ticks(spark, sf_dir).select(*COLS), path, ["ts_event", "seq"])
    return files.tsv(spark, path, ROW)


@CAT.add("K9_run_archive", f"WITH {TICKS_SQL} SELECT d.stream, d.n, (SELECT count(*) FROM ticks) AS total, d.mean FROM (SELECT stream, count(*) AS n, round(avg(price), 6) AS mean FROM ticks GROUP BY 1) d")
def run_archive(spark, sf_dir):
    """K9: a run's manifest, decisions and statistics, joined after they are read."""
    path, t = folder(spark), ticks(spark, sf_dir)
    files.write_run(t.agg(F.count("*").alias("total")), t.select("seq", "stream"), rounded(t.groupBy("stream").agg(F.avg("price").alias("mean"))), path)
    read = lambda name, schema: files.json_lines(spark, f"{path}/{name}", schema, strict=True)
    n = read("decisions", "seq long, stream string").groupBy("stream").agg(F.count("*").alias("n"))
    return n.join(read("stats", "stream string, mean double"), "stream").join(read("manifest", "total long"))  # one manifest


@CAT.add("K10_exposition", f"WITH {TICKS_SQL} SELECT 'ticks_total{{stream=\"' || stream || '\",week=\"' || week || '\"}} ' || count(*) AS line FROM ticks GROUP BY stream, week")
def exposition(spark, sf_dir):
    path = folder(spark)
    files.write_metrics(ticks(spark, sf_dir).groupBy("stream", "week").agg(F.count("*").alias("n")), path, "ticks_total", ["stream", "week"], "n")
    return spark.read.text(path).withColumnRenamed("value", "line")


@CAT.add("S8_feature_files", f"WITH {QUOTES_SQL} SELECT ts_event, mid AS f_mid, bid_qty - ask_qty AS f_size, (seq % 3 - 1)::INT AS label_dir_10s FROM quotes")
def feature_files(spark, sf_dir):
    """Of a feature file only time, f_ columns and label are read."""
    path = folder(spark)
    q = quotes(spark, sf_dir).select("ts_event", "seq", "symbol", F.col("mid").alias("f_mid"), (F.col("bid_qty") - F.col("ask_qty")).alias("f_size"), (F.col("seq") % 3 - 1).cast("int").alias("label_dir_10s"))
    q.write.parquet(path)
    return files.feature_table(spark.read.parquet(path))


@CAT.add("S4_quarantine", f"WITH {TICKS_SQL} SELECT 'readable' AS kind, count(DISTINCT stream) AS files, count(*) AS n FROM ticks UNION ALL SELECT 'corrupt', 1, 0 UNION ALL SELECT 'missing', 1, 0")
def quarantine(spark, sf_dir):
    """A file a stream, one that isn't Parquet and one that isn't there."""
    path, t = folder(spark), ticks(spark, sf_dir).select(*COLS)
    streams = [r[0] for r in t.select("stream").distinct().orderBy("stream").collect()]  # event types, few
    for s in streams:
        t.filter(F.col("stream") == s).write.parquet(f"{path}/{s}")
    t.limit(1).select(F.lit("not parquet")).write.text(f"{path}/broken")
    good, bad = files.split_corrupt(spark, [f"{path}/{s}" for s in (*streams, "broken", "none")], ROW)
    read = spark.read.schema(ROW).parquet(*good).agg(F.lit("readable").alias("kind"), F.lit(len(good)).cast("long").alias("files"), F.count("*").alias("n"))
    return read.unionByName(spark.createDataFrame([(kind, 1, 0) for _, kind in bad], "kind string, files long, n long"))


def streamed(spark: SparkSession, df: DataFrame, parts: int = 4, most: int = 0, order: Sequence[str] = ("ts_event", "seq")) -> DataFrame:
    """``df`` as a stream of files, older times first, two at a time; with ``most``, files are in order and have no more rows than that.

    The order's first column is a number, and known."""
    path, first = folder(spark), F.col(order[0])
    bounds = df.select(F.percentile_approx(first, [k / parts for k in range(1, parts)])).first()[0] or []  # none of an empty table
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = df if low is None else df.filter(first >= low)
        part = (part if high is None else part.filter(first < high)).coalesce(1)
        (part.sortWithinPartitions(*order) if most else part).write.option("maxRecordsPerFile", most).mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives, by way of files that a checkpoint commits."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@CAT.add("T5_live_numbers", f"WITH {TICKS_SQL} SELECT symbol, ts_event, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS number, ts_event * 1000000 AS ts_ns FROM ticks")
def live_numbers(spark, sf_dir):
    return drained(live.numbered(streamed(spark, ticks(spark, sf_dir).select(*COLS))))


@CAT.add("T10_live_changes", f"WITH {TICKS_SQL}, x AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts_event, seq) AS p FROM ticks) SELECT symbol, ts_event, seq, price FROM x WHERE p IS NULL OR p <> price")
def live_changes(spark, sf_dir):
    return drained(live.changed(streamed(spark, ticks(spark, sf_dir).select(*COLS))))


GRADES_SQL = """b AS (SELECT stream, ts_event // 3600000 * 3600000 AS start, count(*) AS n, count(*) FILTER (WHERE price > 60) AS dropped, max(qty) AS queue FROM ticks GROUP BY 1, 2),
c AS (SELECT *, dropped > 0 OR queue >= 90 AS bad, n >= 5 AS degraded FROM b)"""


@CAT.add("T4_live_quality", f"""WITH {TICKS_SQL}, {GRADES_SQL} SELECT stream, start, n, CASE WHEN bad AND (dropped > 0 OR queue >= 90) THEN 'BAD' WHEN bad OR degraded THEN 'DEGRADED' ELSE 'GOOD' END AS quality,
concat_ws(',', CASE WHEN dropped > 0 THEN 'dropped_events' END, CASE WHEN queue >= 90 THEN 'queue_pct_peak' END, CASE WHEN NOT bad AND n >= 5 THEN 'reconnects' END) AS reasons FROM c WHERE start + 3600000 <= (SELECT max(ts_event) FROM ticks) - 60000""")
def live_quality(spark, sf_dir):
    """Hours of a stream that are over by the watermark, with the batch form's grades."""
    x = streamed(spark, ticks(spark, sf_dir).select("ts_event", "stream", "price", "qty"))
    signals = {"dropped": F.count_if(F.col("price") > 60), "queue_pct": F.max("qty"), "reconnects": F.count("*")}
    return drained(live.graded_windows(x, ["stream"], signals, "1 hour")).withColumn("reasons", F.array_join("reasons", ","))


@CAT.add("T4_live_silences", f"""WITH {TICKS_SQL}, g AS (SELECT stream, ts_event + 3600000 - 1 AS fell, lead(ts_event) OVER (PARTITION BY stream ORDER BY ts_event, seq) - ts_event AS gap FROM ticks),
w AS (SELECT stream, (fell // 21600000 - k) * 21600000 AS start FROM g, (SELECT unnest(range(4)) AS k) WHERE gap > 3600000 OR gap IS NULL)
SELECT stream, start, start + 86400000 AS "end", count(*) AS silences FROM w WHERE start + 86400000 <= (SELECT max(ts_event) FROM ticks) - 60000 GROUP BY 1, 2""")
def live_silences(spark, sf_dir):
    """Silences of over an hour in days that begin every six hours."""
    x = streamed(spark, ticks(spark, sf_dir).select("ts_event", "stream"))
    return drained(live.silence_counts(x, ["stream"], "1 hour", "1 day", "6 hours"))


@CAT.add("T6_order_guard", f"""WITH {TICKS_SQL}, x AS (SELECT stream, seq, ts_event // 3600000 AS hour, (seq * 7919) % 1000003 AS arrival FROM ticks), y AS (SELECT *, max(hour) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
SELECT stream, seq, CASE WHEN before IS NULL OR hour > before THEN 'accepted' WHEN hour = before THEN 'duplicate' ELSE 'out_of_order' END AS status FROM y""")
def order_guard(spark, sf_dir):
    """Rows as they come in a shuffled order, in batches of a million at most; only their hour counts, so that some repeat the last one accepted."""
    arrival = F.coalesce((F.col("seq") * 7919) % 1_000_003, F.lit(1_000_003))  # rows without a number come last
    t = ticks(spark, sf_dir).select("stream", F.floor(F.col("ts_event") / 3_600_000).alias("ts_event"), F.lit(0).cast("long").alias("seq"), F.col("seq").alias("id"), arrival.alias("arrival"))
    rows = streamed(spark, t, most=FILE_ROWS, order=("arrival", "ts_event", "id"))
    return drained(stateful.ordered(rows, ["stream"], "arrival")).select("stream", F.col("id").alias("seq"), "status")


LIVE = "volatility", "rsi", "volatility_ratio", "bollinger_pos", "quote_intensity"


@CAT.add("T12_live_features", f"""SELECT seq, {", ".join(f"round({n}, 6) AS {n}" for n in LIVE)} FROM ({whole_stream("W04_volatility")}) JOIN ({whole_stream("W06_rsi")}) USING (seq)
JOIN ({whole_stream("W09_W12_volatility_regime")}) USING (seq) JOIN ({whole_stream("W18_bollinger")}) USING (seq) JOIN ({whole_stream("W25_quote_intensity")}) USING (seq)""")
def live_features(spark, sf_dir):
    """Five rolling features from a stream in two batches, or in more of a million rows each."""
    x = drained(stateful.live_features(streamed(spark, quotes(spark, sf_dir).select("stream", "ts_event", "seq", "mid"), most=FILE_ROWS), ["stream"], {"quote_ranks": 50}))
    return rounded(x.select("seq", *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in LIVE]))


@CAT.add("O12_live_ledger", f"WITH {TICKS_SQL} SELECT DISTINCT stream, week FROM ticks")
def live_ledger(spark, sf_dir):
    """A stream's distinct rows by the hash of their content, in a ledger that replays don't change."""
    path = folder(spark)
    rows = ledgers.fingerprinted(streamed(spark, ticks(spark, sf_dir).select("ts_event", "stream", "week")).select("stream", "week"))
    ledgers.ledger(rows, path, ["fingerprint"], ["stream"], f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("stream", "week")


QUERIES, ORACLES = CAT.queries, CAT.oracles
