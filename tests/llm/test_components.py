import random

import pytest
from pyspark.sql import functions as F
from tidemark.llm.components import _with_least, connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


SHAPES = {
    "path": [(i, i + 1) for i in range(200)],
    "star": [(500, i) for i in range(300)],
    "pairs": [(2 * i + 1, 2 * i) for i in range(50)] * 2,
    "random": [tuple(random.Random(i).sample(range(400), 2)) for i in range(350)],
}


@pytest.mark.parametrize("hot", [{}, {"hot_rows": 20, "salts": 5}])
@pytest.mark.parametrize("shape", SHAPES)
def test_against_union_find(spark, shape, hot):
    edges = spark.createDataFrame(SHAPES[shape] + [(None, 3), (7, None)], "a long, b long")
    got = connected_components(edges, **hot).collect()
    assert {r["node"]: r["component"] for r in got} == brute(SHAPES[shape]) and len(got) == len(brute(SHAPES[shape]))


def test_a_hub_is_dealt_over_salts(spark):
    rows = spark.createDataFrame([(7, i) for i in range(1000)], "u long, v long")
    least = rows.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    x = _with_least(rows, least, 100, 8)
    assert x.count() == 1000 and x.select("_salt").distinct().count() == 8


def test_none(spark):
    assert connected_components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0
