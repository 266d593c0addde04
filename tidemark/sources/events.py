"""The tick stream: one row per event, in the total order (ts_event, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_MS = 604_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks: epoch milliseconds, seq, symbol (the user), stream (the type), price, qty and week."""
    e = table(spark, sf_dir, "events")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        ts.alias("ts_event"), F.col("event_id").alias("seq"), F.col("user_id").alias("symbol"), F.col("event_type").alias("stream"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), F.floor(ts / WEEK_MS).alias("week"),
    )


def half_spread(price: Column, seq: Column) -> Column:
    return price * (F.lit(0.0005) * (1 + seq % 3))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-sided book around every tick with a positive price; sizes come from the tick and its number."""
    t = ticks(spark, sf_dir).filter("price > 0")
    half = half_spread(F.col("price"), F.col("seq"))
    t = t.withColumns({"bid_price": F.col("price") - half, "ask_price": F.col("price") + half, "bid_qty": F.col("qty") + 1.0, "ask_qty": (F.col("seq") % 50 + 1).cast("double")})
    return t.withColumn("mid", (F.col("bid_price") + F.col("ask_price")) / 2)


#: How a venue's trade message names symbol, price, size and time, and what makes it a sale by the taker.
TRADE_MESSAGES = {
    "binance": ("s", "p", "q", "T", lambda m: m["m"] == "true"),
    "bybit": ("s", "p", "v", "T", lambda m: m["S"].isNull() | (m["S"] != "Buy")),
    "okx": ("instId", "px", "sz", "ts", lambda m: m["side"].isNull() | (m["side"] != "buy")),
}


def trades_of(messages: DataFrame, venue: str = "venue", payload: str = "payload", received: str = "ts_recv") -> DataFrame:
    """Adds pair, price, qty, side and ts_event, read from a venue's JSON trade message.

    The pair is upper case without separators; side is -1 where the taker sold, else 1; a message without time takes the time it was received. Messages
    that aren't JSON or name no symbol, and those of other venues, give nulls, as do numbers that can't be read.
    """
    m, out = F.from_json(payload, "map<string,string>"), None
    for name, (pair, price, qty, ts, sold) in TRADE_MESSAGES.items():
        side = F.when(sold(m), -1).otherwise(1)
        found = F.struct(
            F.upper(F.regexp_replace(m[pair], "[-/_]", "")).alias("pair"), m[price].try_cast("double").alias("price"), m[qty].try_cast("double").alias("qty"), side.alias("side"),
            F.coalesce(m[ts].try_cast("long"), F.col(received)).alias("ts_event"),
        )
        known = (F.col(venue) == name) & m[pair].isNotNull()
        out = F.when(known, found) if out is None else out.when(known, found)
    names = ("pair", "price", "qty", "side", "ts_event")
    return messages.withColumn("_trade", out).withColumns({n: F.col(f"_trade.{n}") for n in names}).drop("_trade")


def trade_to_quote(trades: DataFrame, price: str = "price", qty: str = "qty") -> DataFrame:
    """a synthetic book one part in a million wide; sizes that aren't positive become tiny."""
    spread = F.greatest(F.abs(price) * 1e-6, F.lit(1e-8))
    size = F.when(F.col(qty) > 0, F.col(qty)).otherwise(F.lit(1e-9))
    return trades.withColumns({"bid_price": F.col(price) - spread / 2, "ask_price": F.col(price) + spread / 2, "bid_qty": size, "ask_qty": size})


#: The same adapters in SQL.
TICKS_SQL = (
    "ticks AS (SELECT epoch_us(ts) // 1000 AS ts_event, event_id AS seq, user_id AS symbol, event_type AS stream, value AS price, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, epoch_us(ts) // 1000 // 604800000 AS week FROM events)"
)
QUOTES_SQL = (
    TICKS_SQL + ", quotes AS (SELECT *, (bid_price + ask_price) / 2 AS mid FROM (SELECT *, price - price * (0.0005::DOUBLE * (1 + seq % 3)) AS bid_price, "
    "price + price * (0.0005::DOUBLE * (1 + seq % 3)) AS ask_price, qty + 1.0::DOUBLE AS bid_qty, (seq % 50 + 1)::DOUBLE AS ask_qty FROM ticks WHERE price > 0))"
)
