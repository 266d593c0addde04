import numpy as np
from pyspark.sql import functions as F
from tidemark.operators import classifier as c


def data(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 2.0, 0.5] + [0.0, 1.0, -1.0]
    logits = x @ np.array([[0.5, -0.4, 0.0], [0.0, 0.0, 0.8], [-0.5, 0.6, 0.1]]).T + [0.2, 0.0, -0.1]
    y = np.array([rng.choice(3, p=np.exp(z) / np.exp(z).sum()) for z in logits]) - 1
    return x, y


def plain(x, y, l2, scale, steps=6000, rate=0.4):
    """Gradient descent on the same loss, a step for all rows."""
    z, w = np.column_stack([np.ones(len(y)), x]), np.zeros((3, x.shape[1] + 1))
    for _ in range(steps):
        p = np.exp(z @ w.T)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y + 1] -= 1
        w = w - rate * ((p * scale[y + 1][:, None]).T @ z / len(y) + l2 * w)
    return w


def test_fit_against_plain_descent(spark):
    x, y = data()
    rows = [(*map(float, a), int(b), "clash") for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1, "x"), (1.0, 1.0, 1.0, None, "x"), (1.0, 1.0, 1.0, 7, "x")]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, _y string")
    for weights in (None, c.class_weights(df, "y")):
        model = c.fit(df.repartition(3), ["a", "b", "c"], "y", 0.05, weights)
        want = plain(x, y, 0.05, np.array([1.0 if weights is None else weights[k] for k in c.CLASSES]))
        assert np.abs(np.array(model.weights) - want).max() < 1e-6 and model.rounds <= 12
        again = c.fit(df.orderBy(F.desc("b")).coalesce(1), ["a", "b", "c"], "y", 0.05, weights)
        assert np.abs(np.array(again.weights) - np.array(model.weights)).max() < 1e-9
    p = model.probabilities()
    got = df.select("a", "b", "c", model.label().alias("label"), *[p[k].alias(f"p{k}") for k in c.CLASSES]).collect()
    for r in got:
        if r["a"] is None:
            assert r["label"] is None and r["p1"] is None
            continue
        z = np.array(model.weights) @ np.array([1.0, r["a"], r["b"], r["c"]])
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose([r["p-1"], r["p0"], r["p1"]], q, atol=1e-12) and r["label"] == int(z.argmax()) - 1


def test_edges(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    model = c.fit(df, ["a"], "y")
    assert {r[0] for r in df.select(model.label()).collect()} == {1}
    none = c.fit(df.limit(0), ["a"], "y")
    assert none.weights == ((0.0, 0.0),) * 3 and df.select(none.label()).first()[0] == -1
    apart = spark.createDataFrame([(float(i), (i > 10) + (i > 20) - 1) for i in range(31)], "a double, y int")
    model = c.fit(apart, ["a"], "y", 1e-4)
    assert apart.filter(model.label() == F.col("y")).count() >= 29
