"""Lockstep trainers against plain versions of the same models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritylab.operators import mitigate as mt
from paritylab.operators.split import stratified_folds
from paritylab.plans import fleet as fl
from paritylab.plans import newton, trees
from paritylab.sources.fixtures import load_view
from tests.conftest import SMALL

FEATS = ["c_acctbal", "n_orders", "max_price"]


@pytest.fixture(scope="module")
def customers(spark):
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", "segment", *FEATS).fillna(0.0, subset=FEATS).persist()
    yield d
    d.unpersist()


@pytest.fixture(scope="module")
def fleet(customers):
    f = fl.build([(0, customers, FEATS), (3, customers.where("row_id % 2 = 0"), FEATS[:2])], "y", folds=3, task_rows=700)
    yield f
    f.release()


def matrix(fleet, cell):
    rows = sorted(fleet.rows.where(F.col("cell") == cell).collect(), key=lambda r: r.tie)
    x = np.array([np.frombuffer(r.x) for r in rows])
    return x, *(np.array([r[c] for r in rows]) for c in ("y", "fold", "inner", "tie"))


def plain_newton(x, y, c=1.0):
    xb, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    reg = np.diag([*np.ones(x.shape[1]), 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-xb @ w))
        w -= np.linalg.solve(c * xb.T @ (xb * (p * (1 - p))[:, None]) + reg, c * xb.T @ (p - y) + reg @ w)
    return w


def test_scaled_rows_have_length_one_and_folds_are_stratified(fleet):
    x, y, fold, inner, _ = matrix(fleet, 0)
    assert fleet.parts > 1 and np.allclose((x * x).sum(1), 1)
    for label in (0, 1):
        sizes = np.bincount(fold[y == label])
        assert len(sizes) == 3 and sizes.max() - sizes.min() <= 1
        for f in range(3):
            assert np.ptp(np.bincount(inner[(y == label) & (fold != f)])) <= 3


def test_logistic_equals_plain_newton_in_every_fold(fleet):
    fitted = newton.fit_logistic(fleet)
    for cell in (0, 3):
        x, y, fold, _, _ = matrix(fleet, cell)
        model, (mean, spread) = fitted[cell]
        assert np.allclose(model.members[0][0], plain_newton(x, y), atol=1e-8)
        right = []
        for f in range(3):
            w = plain_newton(x[fold != f], y[fold != f])
            right.append(((x[fold == f] @ w[:-1] + w[-1] > 0) == (y[fold == f] == 1)).mean())
        assert np.isclose(mean, np.mean(right)) and np.isclose(spread, np.std(right))


def test_linear_probability_in_the_plan_is_that_of_the_scaled_rows(fleet, customers):
    model = newton.fit_logistic(fleet)[0][0]
    x, y, *_ = matrix(fleet, 0)
    got = customers.select(model.probability().alias("p")).toPandas()["p"]
    z = x @ model.members[0][0][:-1] + model.members[0][0][-1]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-z))))


def test_svm_members_are_at_their_optimum_and_calibrated(fleet):
    model, _ = newton.fit_svm(fleet)[0]
    x, y, fold, inner, _ = matrix(fleet, 0)
    xb, sign = newton.with_one(x), 2 * y - 1
    for j, (w, (a, b)) in enumerate(model.members):
        train = inner != j
        short = np.maximum(1 - sign * (xb @ w), 0) * train
        assert np.abs(w - 2 * 0.8 * xb.T @ (sign * short)).max() < 1e-7
        z, own = a * (xb @ w) + b, inner == j
        n0, n1 = (own & (y == 0)).sum(), (own & (y == 1)).sum()
        gap = (1 / (1 + np.exp(-z)) - np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))) * own
        assert abs(gap.sum()) < 1e-6 and abs((gap * (xb @ w)).sum()) < 1e-6


def plain_boosting(bins, y, train, out, rounds, patience):
    base = np.log(y[train].sum() / (train.sum() - y[train].sum()))
    raw, made, losses = np.full(len(y), base), [], []

    def grow(rows, depth, node, tree, g, h):
        tree[node] = [-1, 0, -0.05 * g[rows].sum() / (h[rows].sum() + 0.5)]
        if depth == 4 or len(rows) < 40:
            return
        best = (0.0, -1, 0)
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max()):
                left = bins[rows, f] <= b
                n = left.sum()
                if n < 20 or len(rows) - n < 20:
                    continue
                gl, hl, gt, ht = g[rows][left].sum(), h[rows][left].sum(), g[rows].sum(), h[rows].sum()
                if hl < 1e-3 or ht - hl < 1e-3:
                    continue
                gain = round(gl * gl / (hl + 0.5) + (gt - gl) ** 2 / (ht - hl + 0.5) - gt * gt / (ht + 0.5), 9)
                if gain > best[0]:
                    best = (gain, f, b)
        if best[1] >= 0:
            tree[node][:2] = best[1:]
            left = bins[rows, best[1]] <= best[2]
            grow(rows[left], depth + 1, 2 * node + 1, tree, g, h)
            grow(rows[~left], depth + 1, 2 * node + 2, tree, g, h)

    def walk(tree, row):
        node = 0
        while tree[node][0] >= 0:
            node = 2 * node + (1 if row[tree[node][0]] <= tree[node][1] else 2)
        return tree[node][2]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree: dict = {}
        grow(np.flatnonzero(train), 0, 0, tree, p - y, p * (1 - p))
        made.append(tree)
        raw = raw + np.array([walk(tree, r) for r in bins])
        losses.append((np.logaddexp(0, raw) - y * raw)[out].mean())
        if trees.stop_round(losses, patience) is not None:
            break
    return made


@pytest.mark.parametrize("keep", [2, 16])
def test_boosting_equals_a_plain_version(fleet, monkeypatch, keep):
    monkeypatch.setattr(trees, "KEEP", keep)
    monkeypatch.setattr(trees, "BINS", 12)
    fitted = trees.fit_boosting(fleet, rounds=5, patience=2)
    for cell in (0, 3):
        model = fitted[cell][0]
        x, y, _, _, tie = matrix(fleet, cell)
        bins, out = trees.binned(x, model.edges), trees.held_out(tie)
        want = plain_boosting(bins, y, ~out, out, 5, 2)
        assert len(model.trees) == len(want) >= 2
        for t, w in zip(model.trees, want):
            for node, (f, b, v) in w.items():
                assert t.feature[node] == f and (f < 0 or t.bin[node] == b) and np.isclose(t.value[node], v, atol=1e-9)


def test_cells_that_stand_in_one_partition_grow_the_same_trees(fleet, customers):
    whole = fl.build([(0, customers, FEATS), (3, customers.where("row_id % 2 = 0"), FEATS[:2])], "y", folds=3)
    assert whole.whole and not fleet.whole
    here, there = trees.fit_boosting(whole, rounds=4, patience=2), trees.fit_boosting(fleet, rounds=4, patience=2)
    for cell in (0, 3):
        (a, cv_a), (b, cv_b) = here[cell], there[cell]
        assert len(a.trees) == len(b.trees) and np.allclose(a.losses, b.losses) and np.allclose(cv_a, cv_b)
        for t, u in zip(a.trees, b.trees):
            assert (t.feature == u.feature).all() and (t.bin == u.bin).all() and np.allclose(t.value, u.value, atol=1e-9)
    whole.release()


def plain_tree(bins, y, draws, model, tree):
    out: dict = {}

    def grow(rows, depth, node):
        w = draws[rows]
        out[node] = [-1, 0, (w * y[rows]).sum() / w.sum()]
        if depth == trees.FOREST_DEPTH or len(rows) < 5 or out[node][2] in (0.0, 1.0):
            return
        best, (wt, t1) = (0.0, -1, 0), (w.sum(), (w * y[rows]).sum())
        for f in trees.chosen_features(model, np.array([tree]), np.array([node]), bins.shape[1])[0]:
            for b in range(trees.FOREST_BINS):
                left = bins[rows, f] <= b
                if left.sum() < 2 or (~left).sum() < 2:
                    continue
                wl, l1 = w[left].sum(), (w * y[rows])[left].sum()
                fall = round((l1 ** 2 + (wl - l1) ** 2) / wl + ((t1 - l1) ** 2 + (wt - wl - t1 + l1) ** 2) / (wt - wl) - (t1 ** 2 + (wt - t1) ** 2) / wt, 9)
                if fall > best[0]:
                    best = (fall, int(f), b)
        if best[1] >= 0:
            out[node][:2] = best[1:]
            left = bins[rows, best[1]] <= best[2]
            grow(rows[left], depth + 1, 2 * node + 1)
            grow(rows[~left], depth + 1, 2 * node + 2)

    grow(np.flatnonzero(draws > 0), 0, 0)
    return out


@pytest.mark.parametrize("numbers", [12_000_000, 4000])
def test_forest_equals_plain_trees(fleet, monkeypatch, numbers):
    monkeypatch.setattr(trees, "PASS_NUMBERS", numbers)
    monkeypatch.setattr(trees, "FOREST_BINS", 16)
    monkeypatch.setattr(trees, "FOREST_DEPTH", 4)
    monkeypatch.setattr(trees, "TASK_PATHS", 5000)
    model = trees.fit_forest(fleet, trees=4)[0][0]
    x, y, _, _, tie = matrix(fleet, 0)
    bins = trees.binned(x, model.edges)
    draws = trees.bag(tie, 3, 4)
    assert 0.9 < draws.mean() < 1.1
    for t in range(4):
        want = plain_tree(bins, y, draws[:, t], 3, t)
        assert len(want) > 10
        for node, (f, b, v) in want.items():
            assert model.feature[t, node] == f and (f < 0 or model.bin[t, node] == b) and np.isclose(model.value[t, node], v)


def test_copies_of_a_row_share_a_fold(customers):
    for how in ("oversample", "cda"):
        d = mt.mitigate(customers, how, "y", "segment", "BUILDING", ["AUTOMOBILE", "FURNITURE"])
        folded = stratified_folds(d, ["y"], 5)
        per_key = folded.groupBy("row_id", "y").agg(F.countDistinct("fold").alias("n"), F.count(F.lit(1)).alias("rows"))
        top = per_key.agg(F.max("n").alias("n"), F.max("rows").alias("rows")).first()
        assert top.n == 1 and top.rows > 1
        f = fl.build([(0, d, FEATS)], "y")
        assert f.rows.groupBy("tie", "y").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
        f.release()


def test_degenerate_tables(spark, customers):
    empty, one = customers.limit(0), customers.where("y = 1").limit(30)
    f = fl.build([(0, empty, FEATS), (1, one, FEATS), (2, customers.limit(60), [])], "y")
    for fit in (newton.fit_logistic, newton.fit_svm, lambda x: trees.fit_boosting(x, 3, 1), lambda x: trees.fit_forest(x, 3)):
        got = fit(f)
        assert set(got) == {0, 1, 2} and got[0][1] == got[1][1] == (0.0, 0.0)
        for model, _ in got.values():
            p = customers.select(model.probability().alias("p")).agg(F.min("p"), F.max("p"), F.count("p")).first()
            assert 0 <= p[0] <= p[1] <= 1 and p[2] == customers.count()
    f.release()


def counted_passes(monkeypatch):
    calls, real = [], trees.summed
    monkeypatch.setattr(trees, "summed", lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def by_passes(customers):
    f = fl.build([(0, customers, FEATS), (3, customers.where("row_id % 2 = 0"), FEATS[:2])], "y", folds=3, task_rows=100)
    assert not f.units
    return f


def test_boosting_of_cells_in_several_slices_needs_no_pass_a_level(fleet, customers, monkeypatch):
    calls, sliced = counted_passes(monkeypatch), by_passes(customers)
    here = trees.fit_boosting(fleet, rounds=4, patience=2)
    assert fleet.parts > 1 and len(calls) == 1  # the base scores
    there = trees.fit_boosting(sliced, rounds=4, patience=2)
    assert len(calls) > 8
    for cell in (0, 3):
        a, b = here[cell][0], there[cell][0]
        assert np.allclose(a.losses, b.losses) and len(a.trees) == len(b.trees)
        for t, u in zip(a.trees, b.trees):
            assert (t.feature == u.feature).all() and (t.bin == u.bin).all() and np.allclose(t.value, u.value, atol=1e-9)
    sliced.release()


def test_forest_of_cells_in_several_slices_needs_no_pass_a_level(fleet, customers, monkeypatch):
    calls, sliced = counted_passes(monkeypatch), by_passes(customers)
    here = trees.fit_forest(fleet, trees=4)
    assert not calls
    there = trees.fit_forest(sliced, trees=4)
    assert len(calls) >= trees.FOREST_DEPTH - 1
    for cell in (0, 3):
        a, b = here[cell][0], there[cell][0]
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.array_equal(a.value, b.value)
    sliced.release()


def test_boosting_of_grid_sized_cells_needs_no_pass_a_level(spark, monkeypatch):
    calls = counted_passes(monkeypatch)
    d = spark.range(25_000).selectExpr("id AS row_id", "CAST(id % 97 AS DOUBLE) AS a", "CAST(pmod(hash(id), 100) AS DOUBLE) AS b", "CAST(id % 97 > pmod(hash(id), 100) AS INT) AS y")
    f = fl.build([(0, d, ["a", "b"])], "y", folds=2)
    model, (mean, _) = trees.fit_boosting(f, rounds=3, patience=2)[0]
    assert len(calls) == 1 and len(model.trees) == 3 and mean > 0.8
    f.release()


def test_cells_that_stand_in_one_partition_take_newtons_steps_there(fleet, customers, monkeypatch):
    calls, real = [], newton.summed
    monkeypatch.setattr(newton, "summed", lambda *a, **k: calls.append(1) or real(*a, **k))
    whole = fl.build([(0, customers, FEATS), (3, customers.where("row_id % 2 = 0"), FEATS[:2])], "y", folds=3)
    assert whole.whole and not fleet.whole
    for fit in (newton.logistic_coefficients, newton.svm_weights):
        here, n = fit(whole), len(calls)
        there = fit(fleet)
        assert n == 0 and len(calls) > 3
        assert all(np.allclose(here[cell][m], there[cell][m], atol=1e-8) for cell in (0, 3) for m in there[cell])
        calls.clear()
    whole.release()


def test_level_histograms_equal_sums_over_all_rows():
    rng, width = np.random.default_rng(0), 16
    bins = np.asfortranarray(rng.integers(0, width, (500, 3)).astype(np.uint8))
    slope, bend = rng.normal(size=500), rng.random(500)
    pair, tree, found = slope + 1j * bend, trees.Tree.of(4), {}
    counts = trees.node_histograms(bins, np.zeros(500, np.int64), 1, [None], width)[0]
    tree.feature[:7], tree.bin[:7] = [0, 1, -1, 2, 0, -1, -1], [9, 5, 0, 3, 11, 0, 0]  # node 2 is a leaf
    for level, nodes in enumerate(([0], [1, 2], [3, 4], [7, 8, 10])):
        found = trees.level_histograms(bins, pair, counts, tree, nodes, level, found, width)
        want = trees.node_histograms(bins, trees._node_numbers(tree, nodes, bins, level), len(nodes), [slope, bend, None], width)
        assert list(found) == nodes and np.allclose(np.stack([found[p] for p in nodes], 1), want, atol=1e-12)


@pytest.mark.parametrize("more", [0, 2 ** 24, 2 ** 50])
def test_counts_are_exact_as_one_two_or_three_sums(more):
    w = np.append(np.arange(1.0, 50.0), more + 1.0)
    w1, at, row = w * (np.arange(50) % 3 == 1), np.arange(50) % 7, np.arange(5, 50)
    counts = trees.Counts(w, w1)
    assert (counts.one, counts.two) == (more == 0, more < 2 ** 50)
    got = counts.by(at[row], row, 9)
    assert np.array_equal(got, np.stack([np.bincount(at[row], v, 9) for v in (None, w[row], w1[row])]))


def test_models_of_more_than_a_million_rows_grow_in_a_task(customers, monkeypatch):
    calls = counted_passes(monkeypatch)
    f = fl.build([(0, customers, FEATS)], "y", folds=2, task_rows=200)  # eight slices, as 1.6 million rows have
    assert f.units and not f.whole
    assert len(trees.fit_boosting(f, rounds=2, patience=2)[0][0].trees) == 2 and len(calls) == 1
    f.release()


def test_level_histograms_in_portions_of_rows_equal_those_at_once(monkeypatch):
    rng, width = np.random.default_rng(0), 16
    bins, pair = np.asfortranarray(rng.integers(0, width, (500, 3)).astype(np.uint8)), rng.normal(size=500) + 1j * rng.random(500)
    tree, counts = trees.Tree.of(4), trees.node_histograms(bins, np.zeros(500, np.int64), 1, [None], width)[0]
    tree.feature[:3], tree.bin[:3] = [0, 1, 2], [9, 5, 3]

    def levels():
        found, out = {}, []
        for level, nodes in enumerate(([0], [1, 2], [3, 4, 5, 6])):
            found = trees.level_histograms(bins, pair, counts, tree, nodes, level, found, width)
            out.append(np.stack([found[p] for p in nodes]))
        return out

    once = levels()
    monkeypatch.setattr(trees, "BOOST_ROWS", 64)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(once, levels()))


def test_forest_and_boosting_in_portions_of_rows_are_the_same(fleet, monkeypatch):
    def models():
        return trees.fit_forest(fleet, trees=3)[0], trees.fit_boosting(fleet, rounds=3, patience=2)[0]

    (forest, cv), (boosted, cv_boosted) = models()
    monkeypatch.setattr(trees, "FOREST_ROWS", 64)
    monkeypatch.setattr(trees, "BOOST_ROWS", 64)
    (other, other_cv), (other_boosted, other_cv_boosted) = models()
    assert (forest.feature == other.feature).all() and (forest.bin == other.bin).all() and np.array_equal(forest.value, other.value)
    assert cv == other_cv and cv_boosted == other_cv_boosted and np.allclose(boosted.losses, other_boosted.losses)
    for t, u in zip(boosted.trees, other_boosted.trees, strict=True):
        assert (t.feature == u.feature).all() and (t.bin == u.bin).all() and np.allclose(t.value, u.value, atol=1e-9)


def test_a_row_is_scored_by_the_model_that_leaves_it_out_alone(fleet):
    def predict(cell, columns, m):
        assert (columns["fold"] == m).all() and len(columns["x"]) == len(columns["y"])
        return np.full(len(columns["y"]), m == 1)

    got = fl.fold_accuracy(fleet, ["x"], predict)
    for cell in (0, 3):
        _, y, fold, _, _ = matrix(fleet, cell)
        right = [((m == 1) == y[fold == m]).mean() for m in range(3)]
        assert np.allclose(got[cell], (np.mean(right), np.std(right)))


def test_newton_sums_equal_plain_ones():
    rng = np.random.default_rng(0)
    slope, bend = rng.normal(size=(3000, 4)), rng.random((3000, 4))
    for x in (np.asfortranarray(rng.normal(size=(3000, 3))), rng.normal(size=(3000, 4, 2))):
        wide = np.broadcast_to(x[:, None, :], (3000, 4, 3)) if x.ndim == 2 else x
        got = newton.weighted_sums(x, bend, slope, bend)
        want = [bend.sum(0)[:, None], np.einsum("nm,nmd->md", slope, wide), np.einsum("nm,nmd,nme->mde", bend, wide, wide).reshape(4, -1)]
        assert np.allclose(got, np.concatenate(want, 1))
    z = np.array([-800.0, -30.0, -1e-9, 0.0, 2.0, 800.0])
    assert np.allclose(newton.softplus(z), np.logaddexp(0.0, z), rtol=1e-14, atol=0)
