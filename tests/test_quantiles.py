"""Radix selection against numpy."""

import math
import random

import numpy as np
import pytest

from paritylab.functions import quantiles as qn

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns():
    rng = random.Random(4)
    n = 3000
    return {"even": [rng.random() * 1000 - 400 for _ in range(n)], "heavy": [math.exp(rng.gauss(0, 40)) * rng.choice([-1, 1]) for _ in range(n)],
            "few": [float(rng.choice([1, 2, 2, 7])) for _ in range(n)], "one": [3.5] * n, "gaps": [None if rng.random() < 0.7 else float(rng.randint(-5, 10 ** 6)) for _ in range(n)],
            "none": [None] * n, "tiny": [rng.choice([5e-324, -5e-324, 0.0, -0.0, 1e-310]) for _ in range(n)], "ends": [rng.choice([-math.inf, math.inf, 1.0, 1e308, -1e308]) for _ in range(n)],
            "close": [1.0 + rng.randint(0, 5000) * 2.0 ** -52 for _ in range(n)]}


@pytest.mark.parametrize("buckets", [4096, 7])
def test_column_quantiles_equal_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(qn, "BUCKETS", buckets)
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{c}` double" for c in data)).repartition(4)
    got = qn.column_quantiles(df, list(data), PROBS)
    assert set(got) == set(data) - {"none"}
    for c, q in got.items():
        own = np.sort([v for v in data[c] if v is not None])
        for p, v in zip(PROBS, q):
            at = p * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            want = low + (high - low) * (at - math.floor(at))
            assert v == want or (math.isnan(v) and math.isnan(want)), (c, p)
    assert qn.column_quantiles(df.limit(0), ["even"], [0.5]) == {}


def test_no_data_rows_are_shuffled(spark):
    df = spark.range(50_000).selectExpr("cast(id % 9973 as double) * 1.25 AS v")
    assert qn.column_quantiles(df, ["v"], [0.5])["v"] == [np.quantile([(i % 9973) * 1.25 for i in range(50_000)], 0.5)]
    cells = df.selectExpr("0 AS id", "floor(v / 100) AS part", "v AS value")
    plan = qn._buckets(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > 0 and "RangePartitioning" not in plan
