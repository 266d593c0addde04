"""How filters of documents interact: every order of them replayed over all documents.

A document fails or passes each filter by itself, whatever the order; an order only decides which failing filter
meets it first. So documents are reduced to their flags with weights, by partial aggregates: at most ``2 ** filters`` rows
a part, whatever the table's size. These cross the orders, which are broadcast (``factorial(filters)`` rows,
120 for five), each row is exploded into the order's steps, its first failure is the least position among its
failing filters, and conditional sums give what every step keeps and removes.

Copies are found by the text's SHA-256. Groups of copies are never gathered: a text's rows are first summed by
(text, part, label), with the least id of each sum, and only these sums meet to find the text's least id; a text has at
most as many of them as there are parts times four.

Defined results: a null text is empty, and equal to an empty one; a null part is the empty string; a null id
is neither smaller nor larger than another, so its row is never a copy, nor makes one; repeated rows are
separate documents that are not copies of each other, as their ids are equal; a document without a label is neither good
nor toxic, and one with several labels is what any of them says; an empty table gives no rows. Very long
texts are read whole. Columns that aren't named are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"


def text_conditions(text: Column, least_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10, signs: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions of single texts: A few words, B repeated words, C capitals, D signs."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n_words < least_words,
        "B": n_distinct.cast("long") * 100 < n_words.cast("long") * distinct_percent,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * upper_percent,
        "D": F.length(F.translate(text, signs, "")) < F.length(text),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, A to E, n, good_n, toxic_n): documents of a part with equal flags, and how many of them have which label.

    E fails where a smaller id anywhere in the table has the same text.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    conditions = text_conditions(text)
    alone = list(conditions)
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part_col], F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"),
        *[c.alias(name) for name, c in conditions.items()],
    )
    rows = rows.groupBy("id", "h", "part", *alone).agg(F.count("*").alias("n"))
    marks = labels.groupBy(labels[id_col].alias("_id")).agg(
        F.max(F.coalesce(labels[quality_col] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels[toxic_col] == 1, F.lit(False))).alias("toxic")
    )
    good, toxic = (F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic"))
    rows = rows.join(marks, F.col("id") == F.col("_id"), "left").select("id", "h", "part", *alone, "n", good, toxic)
    sums = rows.groupBy("h", "part", "good", "toxic", *alone).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
    )
    is_first = F.col("least") == F.min("least").over(Window.partitionBy("h"))
    first = F.col("unnamed") + F.when(is_first, F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("_first").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("_first")).alias("n")))
    sums = sums.withColumn("_first", first).select("part", "good", "toxic", *alone, F.inline(both)).filter("n > 0")
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(f"{mark}_n")
    return sums.groupBy("part", *alone, "E").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def replay(flags: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters.

    ``flags`` has a boolean column per filter, named by one character, and part, n, good_n and toxic_n. ``shapley`` is
    what the step's filter removes, summed over all orders.
    """
    if any(len(f) != 1 for f in filters) or len(filters) > 7:
        raise ValueError("filters are named by one character, and are seven at most")
    orders = flags.sparkSession.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string")
    order, step, k = F.col("filter_order"), F.col("step"), len(filters)
    crossed = flags.crossJoin(F.broadcast(orders)).withColumn("_first", F.least(*[F.when(F.col(f), F.instr(order, f)) for f in filters], F.lit(k + 1)))
    steps = crossed.withColumn("_failed", sum(F.col(f).cast("int") for f in filters)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumn("_own", F.substring(order, step, F.lit(1)))
    fails = F.coalesce(*[F.when(F.col("_own") == f, F.col(f)) for f in filters])
    here, earlier = F.col("_first") == step, F.col("_first") < step
    total = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    found = steps.groupBy("part", "filter_order", "step", "_own").agg(
        total(F.col("_first") > step, "n", "kept"), total(here, "n", "removed"), total(fails & earlier, "n", "redundant"),
        total(fails & (F.col("_failed") == 1), "n", "unique_fails"), total(here, "good_n", "good_lost"), total(here, "toxic_n", "toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_own"))).drop("_own")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The replay of the five filters' 120 orders over ``docs``, for each part. ``columns``: as :func:`flagged` names them."""
    return replay(flagged(docs, labels, **columns))
