"""The neighbour search of SMOTE against brute force, inside blocks and by joins."""

import numpy as np
import pytest

from paritylab.operators import smote as sm


def brute_force(x, keys, base, k):
    d2 = ((x - x[base]) ** 2).sum(1)
    return [keys[i] for i in sorted((i for i in range(len(x)) if i != base), key=lambda i: (d2[i], keys[i]))[:k]]


@pytest.mark.parametrize("halos", [(16,), (64, 128), (1 << 12, 1 << 15)])
def test_neighbours_equal_brute_force(spark, monkeypatch, halos):
    monkeypatch.setattr(sm, "HALOS", halos, raising=False)
    rng, tables = np.random.default_rng(7), {}
    # far along the axis, but near otherwise: the first window has as many points as the subgroup and still misses them
    tables["edge"] = np.stack([np.arange(33.0), np.where((np.arange(33) == 0) | (np.arange(33) > 16), 1000.0, 0.0)], 1)
    tables["even"] = rng.uniform(0, 100, (300, 2))
    tables["copies"] = np.repeat(rng.integers(0, 4, (20, 2)), 12, 0).astype(float)
    rows, want = [], {}
    for g, x in tables.items():
        keys = rng.permutation(len(x)).tolist()
        order = sorted(range(len(x)), key=lambda i: (x[i, 0], keys[i]))
        x, keys = x[order], [keys[i] for i in order]
        rows += [(g, i + 1, float(a), keys[i], float(a), float(b)) for i, (a, b) in enumerate(x)]
        want |= {(g, b + 1): brute_force(x, keys, b, 5) for b in range(0, len(x), 2)}
    pts = spark.createDataFrame(rows, "_g string, _pos bigint, _p double, row_id int, a double, b double")
    bases = spark.createDataFrame(list(want), "_g string, _b bigint")
    sizes = spark.createDataFrame([(g, len(x)) for g, x in tables.items()], "_g string, _n bigint")
    got: dict = {}
    for r in sm._exact_knn(bases, pts, sizes, 300, ["a", "b"], "row_id", 5).orderBy("_g", "_b", "_j").collect():
        got.setdefault((r["_g"], r["_b"]), []).append((r["_j"], r["_nk"]))
    assert {at: [k for _, k in found] for at, found in got.items()} == want
    assert all([j for j, _ in found] == [0, 1, 2, 3, 4] for found in got.values())


def test_pairs_of_a_window_are_not_shuffled(spark, monkeypatch):
    cut, rows = [], []
    monkeypatch.setattr(sm, "cut_lineage", lambda df, real=sm.cut_lineage: cut.append(df._jdf.queryExecution().toString()) or real(df))
    rows = [(g, p, float(p), p, float(p)) for g in "ab" for p in range(1, 101)]
    pts = spark.createDataFrame(rows, "_g string, _pos bigint, _p double, row_id int, a double")
    bases = spark.createDataFrame([("a", 7)], "_g string, _b bigint")
    sizes = spark.createDataFrame([("a", 100), ("b", 100)], "_g string, _n bigint")
    assert len(sm._exact_knn(bases, pts, sizes, 100, ["a"], "row_id", 5).collect()) == 5
    assert cut and not any("sequence(-" in plan or "row_number" in plan for plan in cut)
