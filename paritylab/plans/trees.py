"""Lockstep trees on binned features: boosting with L2 and patience (T3), level-synchronous forests.

Features are binned once per cell: at most 255 upper bin edges, quantiles that occur among the values. A pass adds up, for
every open node of every model, histograms over (feature, bin); the task that adds a model's histograms finds the
splits, so only splits reach the driver. Among equal gains the lower feature, then the lower bin wins.

A tree is a complete binary array: the children of node p are 2p + 1 and 2p + 2; ``feature`` is -1 at a leaf; rows with
a bin up to ``bin`` go left.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritylab.plans.fleet import Cell, Fleet, add, block, columns_of, fold_accuracy, joined, packed, scaled, summed
from paritylab.plans.newton import expit, softplus
from paritylab.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 255
#: Boosting: rounds, rounds without a lower holdout loss before it stops, share held out, and the usual parameters.
ROUNDS, PATIENCE, HOLDOUT = 1000, 20, 0.1
RATE, L2, BOOST_DEPTH, BOOST_LEAF, BOOST_CURVE = 0.05, 0.5, 4, 20, 1e-3
#: Rounds whose trees every pass applies anew, before the scores of the rows are written.
KEEP = 8
#: Forest, and the histogram numbers that a pass adds up at most (open nodes beyond wait for the next pass).
TREES, FOREST_DEPTH, FOREST_SPLIT, FOREST_LEAF, FOREST_BINS, PASS_NUMBERS = 100, 8, 5, 2, 64, 12_000_000
#: Rows times trees of a model up to which one task grows its forest, and rows that it takes at a time.
TASK_PATHS, FOREST_ROWS = 200_000_000, 1 << 15
#: Rows that boosting in a task takes at a time: their columns stay in a core's cache.
BOOST_ROWS = 1 << 15
HELD_OUT_SALT, SEED = np.uint64(0x5851F42D4C957F2D), 42


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def held_out(tie: np.ndarray, share: float = HOLDOUT) -> np.ndarray:
    return unit(tie.astype(np.uint64) ^ HELD_OUT_SALT) < share


def bin_edges(fleet: Fleet, most: int) -> dict[int, list[np.ndarray]]:
    """Upper bin edges of every feature of a cell, ascending; values above the last fall into one more bin."""
    def unpack(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, c in columns_of(b):
                n, d = c["x"].shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n * d, cell, np.int32)), pa.array(np.repeat(np.arange(d, dtype=np.int32), n)), pa.array(c["x"].T.ravel())],
                                                 names=["cell", "i", "v"])

    share = [q / most for q in range(1, most)]
    found = (fleet.blocks.select("cell", "n", "x").mapInArrow(unpack, "cell int, i int, v double").groupBy("cell", "i")
             .agg(F.percentile_approx("v", share, 20_000).alias("q"), F.max("v").alias("top")).collect())  # BINS numbers a feature
    out = {cell: [np.zeros(0)] * len(c.features) for cell, c in fleet.cells.items()}
    for r in found:
        q = np.unique(np.array(r["q"]))
        out[r["cell"]][r["i"]] = q[q < r["top"]]
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (rows x features); a feature's are contiguous."""
    return np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(edges)]).T if edges else np.zeros((len(x), 0), np.uint8)


BLOCK = "cell int, n int, y binary, bins binary, fold binary, tie binary, out binary"


def binned_rows(fleet: Fleet, edges: dict[int, list[np.ndarray]], share: float = 0.0) -> DataFrame:
    """The fleet's blocks, where they stand, with bins instead of features; ``out`` marks the holdout."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, c in columns_of(b):
                yield block(cell, len(c["y"]), {"y": c["y"], "bins": binned(c["x"], edges[cell]), "fold": c["fold"], "tie": c["tie"], "out": held_out(c["tie"], share)})

    return fleet.blocks.select("cell", "n", "y", "x", "fold", "tie").mapInArrow(run, BLOCK)


def grown_by_units(fleet: Fleet, key: dict[tuple, int], names: list[str], grow: Callable) -> dict[int, np.ndarray]:
    """``grow(cell, model, columns)`` of every model, each in a task that holds the blocks of its cell (UNIT_SLICES slices of
    rows at most); one array a model comes back."""
    unit = {i: cm for cm, i in key.items()}
    own = {cell: [i for (c, _), i in key.items() if c == cell] for cell in fleet.cells}
    own = {cell: units for cell, units in own.items() if units}
    if not own:
        return {}

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for b in batches:
            at = b.schema.get_field_index("unit")
            for i, (_, c) in zip(b.column(at).to_pylist(), columns_of(b.select(["cell", "n", *names]))):
                parts.setdefault(i, []).append(c)
        while parts:
            i, some = parts.popitem()
            yield from packed({i: grow(*unit[i], joined(some))})

    units = F.create_map(*[x for cell, found in own.items() for x in (F.lit(cell), F.array(*[F.lit(i) for i in found]))])
    rows = fleet.blocks.select("cell", "n", *names).withColumn("unit", F.explode(units[F.col("cell")]))
    return {r["key"]: np.frombuffer(r["data"], np.float64) for r in rows.repartitionById(len(unit), F.col("unit").cast("int")).mapInArrow(run, "key bigint, data binary").collect()}


@dataclass
class Tree:
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n))


#: Levels that rows descend by comparing whole columns, all nodes of a level alike; deeper ones look up each row's node.
WIDE_LEVELS = 4


def _either(a, b, right):
    """``b`` where ``right``, else ``a``; None is False everywhere."""
    if right is None or (a is None and b is None):
        return a
    return b & right if a is None else a & ~right if b is None else a ^ ((a ^ b) & right)


def places(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """Place of every row among a tree's 2 ** depth nodes of that depth; a row that stops above stands at the leftmost below."""
    n, at, turns = len(bins), np.zeros(len(bins), np.uint8 if depth <= 8 else np.int32), []
    for level in range(min(depth, WIDE_LEVELS)):
        first = 2 ** level - 1
        go = [bins[:, f] > c if f >= 0 else None for f, c in zip(feature[first:2 * first + 1].tolist(), cut[first:2 * first + 1])]
        for right in turns:
            half = len(go) // 2
            go = [_either(a, b, right) for a, b in zip(go[:half], go[half:])]
        turns.append(go[0])
        at = at << 1
        if go[0] is not None:
            at |= go[0]
    if depth > WIDE_LEVELS:
        inner = feature >= 0
        if not inner[2 ** WIDE_LEVELS - 1:2 ** depth - 1].any():
            return at << (depth - WIDE_LEVELS)
        flat, row = bins.T.ravel(), np.arange(n)
        start, last = np.where(inner, feature, 0).astype(np.int64) * n, np.where(inner, cut, 255).astype(np.uint8)
        for level in range(WIDE_LEVELS, depth):
            here = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            at = (at << 1) | (flat[start[here][at] + row] > last[here][at])
    return at


def step_down(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
    """``places`` of depth ``level`` + 1 for rows that stand at the places ``at`` of depth ``level``."""
    first = 2 ** level - 1
    go = [bins[:, f] > c if f >= 0 else None for f, c in zip(feature[first:2 * first + 1].tolist(), cut[first:2 * first + 1])]
    for bit in range(level - 1, -1, -1):
        half, right = len(go) // 2, (at & (1 << bit)) != 0
        go = [_either(a, b, right) for a, b in zip(go[:half], go[half:])]
    at = at << 1
    if go[0] is not None:
        at |= go[0]
    return at


def bottom_values(feature: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Of each place at the bottom the value of the leaf that its rows stopped at."""
    value = value.copy()
    for p in range(2 ** depth - 1):
        if feature[p] < 0:
            value[2 * p + 1] = value[p]
    return value[2 ** depth - 1:2 ** (depth + 1) - 1]


# ---------------------------------------------------------------- boosting
def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each node (nodes x features x bins: gradient, curvature, rows) the feature, bin and gain of its best split, gradient,
    curvature and rows of the left side, and those of the node; feature -1: none."""
    gl, hl, nl = (np.cumsum(v, 2)[:, :, :-1] for v in (g, h, n))
    gt, ht, nt = (v[:, :1].sum(2)[:, :, None] for v in (g, h, n))
    gr, hr = gt - gl, ht - hl
    gain = gl * gl / (hl + L2) + gr * gr / (hr + L2) - gt * gt / (ht + L2)
    ok = (nl >= BOOST_LEAF) & (nl <= nt - BOOST_LEAF) & (hl >= BOOST_CURVE) & (hr >= BOOST_CURVE)
    gain = np.where(ok, np.round(gain, 9), -1.0)  # sums differ in their last digits from run to run
    flat, i = gain.reshape(len(gain), -1), np.arange(len(gain))
    f, b = np.divmod(flat.argmax(1), gain.shape[2])
    best = gain[i, f, b]
    return np.stack([np.where(best > 0, f, -1), b, best, gl[i, f, b], hl[i, f, b], nl[i, f, b], gt[:, 0, 0], ht[:, 0, 0], nt[:, 0, 0]], 1)


def node_histograms(bins: np.ndarray, node: np.ndarray, nodes: int, weights: list[np.ndarray | None], width: int) -> np.ndarray:
    """Sums of each weight by (node, feature, bin); None counts rows. Rows with node ``nodes`` are left out."""
    out = np.empty((len(weights), nodes, bins.shape[1], width))
    start = node * np.int64(width)
    for j in range(bins.shape[1]):
        at = start + bins[:, j]
        for k, w in enumerate(weights):
            out[k, :, j] = np.bincount(at, w, (nodes + 1) * width)[:nodes * width].reshape(nodes, width)
    return out


def add_root(sums: np.ndarray, bins: np.ndarray, pair: np.ndarray) -> None:
    """Adds ``pair`` by feature and bin."""
    for j in range(len(sums)):
        np.add.at(sums[j], bins[:, j].astype(np.int64), pair)


def level_histograms(bins: np.ndarray, pair: np.ndarray, counts: np.ndarray, tree: Tree, nodes: list[int], level: int, above: dict[int, np.ndarray],
                     width: int, at: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Histograms (gradient, curvature, rows by feature and bin) of the ``nodes`` of one level. Of two siblings only the rows of the one with
    fewer are added up, BOOST_ROWS at a time; the other is what remains of their parent, which ``above`` has. ``pair`` has a row's gradient
    and, as its imaginary part, its curvature; ``counts`` are the rows of the root; ``at`` has the rows' places of the level above and takes
    those of this one."""
    first, d = 2 ** level - 1, bins.shape[1]
    other = {p: p + 1 if p % 2 else p - 1 for p in nodes} if level else {0: 0}

    def size(p: int) -> float:
        up = (p - 1) // 2
        rows, cut = above[up][2, tree.feature[up]], int(tree.bin[up]) + 1
        return (rows[:cut] if p % 2 else rows[cut:]).sum()

    some = sorted({min(pair, key=lambda p: (size(p), p)) for pair in other.items()}) if level and d else list(other)
    number = np.zeros(2 ** level, np.int64)
    number[np.array(some) - first] = np.arange(len(some)) * width
    sums, rows = np.zeros((d, len(some) * width), np.complex128), np.zeros((d, len(some) * width))
    for lo in range(0, len(bins), BOOST_ROWS):
        part, own = bins[lo:lo + BOOST_ROWS], pair[lo:lo + BOOST_ROWS]
        if level == 0:
            add_root(sums, part, own)
            continue
        if at is None:
            here = places(tree.feature, tree.bin, part, level)
        else:
            here = at[lo:lo + BOOST_ROWS] = step_down(tree.feature, tree.bin, part, level - 1, at[lo:lo + BOOST_ROWS])
        use = np.flatnonzero(reduce(np.logical_or, [here == p - first for p in some]))
        own, bin_ = np.take(own, use), np.take(part.T, use, 1)
        bin_ = bin_ + np.take(number, here[use]) if len(some) > 1 else bin_.astype(np.int64)
        for j in range(d):
            np.add.at(sums[j], bin_[j], own)
            np.add.at(rows[j], bin_[j], 1.0)
    if level == 0:
        rows = counts.reshape(d, width)
    sums = np.stack([sums.real, sums.imag, rows]).reshape(3, d, len(some), width)
    found = {p: sums[:, :, i] for i, p in enumerate(some)}
    return {p: found[p] if p in found else above[(p - 1) // 2] - found[other[p]] for p in nodes}


#: Base score, and the features, bins and values of some trees (trees x nodes).
Packed = tuple[float, np.ndarray, np.ndarray, np.ndarray]


def raw_scores(packed: Packed, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """``start`` (the base score) and the values of the trees."""
    base, feature, cut, value = packed
    out = np.full(len(bins), base) if start is None else start.copy()
    depth = int(np.log2(feature.shape[1] + 1)) - 1
    for f, c, v in zip(feature, cut, value):
        out += bottom_values(f, v, depth)[places(f, c, bins, depth)]
    return out


@dataclass
class Boosted:
    """Boosted trees: P(1) is the logistic of ``base`` and the trees' values."""

    cell: Cell
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    depth: int = BOOST_DEPTH

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def packed(self, since: int = 0) -> Packed:
        """What it takes to add the trees from ``since`` on to scores."""
        some, none = self.trees[since:], np.zeros((0, 2 ** (self.depth + 1) - 1))
        return (self.base, *(np.stack([getattr(t, a) for t in some]) if some else none.astype(k) for a, k in (("feature", np.int16), ("bin", np.uint8), ("value", float))))

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return raw_scores(self.packed(), bins)

    def chance(self, bins: np.ndarray) -> np.ndarray:
        return expit(self.raw(bins))

    def chances(self, x: np.ndarray) -> np.ndarray:
        return raw_chances(self, x)

    def probability(self) -> Column:
        return arrow_probability(self)


def raw_chances(model, x: np.ndarray) -> np.ndarray:
    """P(1) of a tree model for rows of raw features."""
    return model.chance(binned(scaled(x, model.cell.mean, model.cell.spread), model.edges))


def arrow_probability(model) -> Column:
    """P(1) of a tree model as an Arrow-batched function of the raw features."""
    cell = model.cell

    def score(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(raw_chances(model, columns.to_numpy(np.float64, na_value=np.nan)[:, :len(cell.features)]))

    fields = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cell.features)]
    return F.pandas_udf(score, "double")(F.struct(*fields, F.lit(0.0).alias("none")))


def fit_boosting(fleet: Fleet, rounds: int = ROUNDS, patience: int | None = PATIENCE) -> dict[int, tuple[Boosted, tuple[float, float]]]:
    """For every cell the boosted model on all rows, and mean and spread of the cross-validated accuracy.

    A model's holdout is a fixed share of its training rows, drawn from the row key; its loss is summed along with the first
    level of the next tree, so a model stops ``patience`` rounds after its lowest loss without a further pass. ``patience=None``:
    all rows, all rounds."""
    edges = bin_edges(fleet, BINS)
    share = HOLDOUT if patience is not None else 0.0
    rows = binned_rows(fleet, edges, share).persist()
    fleet = replace(fleet, blocks=rows)
    models = {cm: Boosted(fleet.cells[cm[0]], edges[cm[0]], 0.0) for cm in by_work(fleet)}
    key = {cm: i for i, cm in enumerate(models)}

    def local_counts(sums, cell, c):
        for m in fleet_models[cell]:
            train = (c["fold"] != m) & ~c["out"]
            add(sums, key[cell, m], np.array([train.sum(), (c["y"] * train).sum()]))

    fleet_models = {cell: fleet.models(cell) for cell in fleet.cells}
    counts = summed(fleet, ["y", "fold", "out"], local_counts)
    for cm, b in models.items():
        n, n1 = counts.get(key[cm], np.zeros(2))
        b.base = float(np.log(max(n1, 0.5) / max(n - n1, 0.5))) if n else 0.0
    open_ = [cm for cm in models if counts.get(key[cm], np.zeros(2))[0] > 0]
    growth = Growth({cm: models[cm] for cm in open_}, {cm: key[cm] for cm in open_}, rounds, patience)
    if fleet.units:
        _grow_in_place(fleet, growth)
    else:
        _grow_by_passes(fleet, growth)
    held = {cell: [models[cell, m].packed() for m in range(fleet.folds)] for cell in fleet.cells if len(fleet.models(cell)) > 1}
    scores = fold_accuracy(fleet, ["bins"], lambda cell, c, m: raw_scores(held[cell][m], c["bins"]) > 0) if held else {}
    rows.unpersist()
    return {cell: (models[cell, fleet.folds], scores.get(cell, (0.0, 0.0))) for cell in fleet.cells}


def by_work(fleet: Fleet) -> list[tuple[int, int]]:
    """(cell, model), those with the most rows and features first: a long task that begins last would run alone."""
    size = {(cell, m): c.rows(keep=lambda f, i: f != m) * len(c.features) for cell, c in fleet.cells.items() for m in fleet.models(cell)}
    return sorted(size, key=lambda cm: -size[cm])


class Growth:
    """Boosted models that grow a level at a time from the splits of their open nodes."""

    def __init__(self, models: dict[tuple, Boosted], key: dict[tuple, int], rounds: int, patience: int | None):
        self.models, self.key, self.rounds, self.patience = models, key, rounds, patience
        self.still = list(models)
        self.written_to, self.slots = 0, {}  # the written scores hold the trees up to written_to; place of a model in them
        self.trees: dict = {}
        self.totals: dict = {}  # open nodes with their gradient, curvature and rows

    def state(self) -> dict[tuple, tuple[Packed, int | None]]:
        """Of each open model the trees that are not in the written scores, and its place in those."""
        return {cm: (self.models[cm].packed(self.written_to if cm in self.slots else 0), self.slots.get(cm)) for cm in self.still}

    def open(self, level: int) -> dict[tuple, list[int]]:
        """The open nodes of a level by model."""
        if level == 0:
            self.trees, self.totals = {cm: Tree.of(BOOST_DEPTH) for cm in self.still}, {cm: {0: None} for cm in self.still}
        nodes = {cm: [p for p in range(2 ** level - 1, 2 ** (level + 1) - 1) if p in self.totals[cm]] for cm in self.still}
        self.opened = {cm: own for cm, own in nodes.items() if own}
        return self.opened

    def ask(self, level: int, state: dict) -> tuple[Callable, Callable] | None:
        """What tasks add up for the open nodes of a level, and how splits are found from it; None if there is none."""
        if not self.open(level):
            return None
        sent: dict = {}
        for (cell, m), own in self.opened.items():
            sent.setdefault(cell, []).append((m, own, self.trees[cell, m]))
        shapes = {self.key[cm]: (len(own), len(self.models[cm].edges)) for cm, own in self.opened.items()}
        return _boost_local(sent, state, self.key, level, BINS + 1), _boost_finish(shapes, BINS + 1)

    def take(self, level: int, got: dict[int, np.ndarray]) -> None:
        for cm, nodes in self.opened.items():
            data, tree, totals = got[self.key[cm]], self.trees[cm], self.totals[cm]
            if level == 0:
                self.models[cm].losses.append(float(data[0] / data[1]) if data[1] else np.nan)
            for p, (f, b, _, gl, hl, nl, g, h, n) in zip(nodes, data[2:].reshape(-1, 9).tolist()):
                tree.value[p] = -RATE * g / (h + L2)
                if f >= 0:
                    tree.feature[p], tree.bin[p] = f, b
                    for child, (cg, ch, cn) in ((2 * p + 1, (gl, hl, nl)), (2 * p + 2, (g - gl, h - hl, n - nl))):
                        tree.value[child] = -RATE * cg / (ch + L2)
                        if cn >= 2 * BOOST_LEAF:
                            totals[child] = (cg, ch, cn)

    def end_round(self) -> None:
        """Models that are through leave; the others keep their new tree. losses[k] is that after k trees; a model without a
        holdout has none and takes all rounds."""
        go = []
        for cm in self.still:
            b = self.models[cm]
            if self.patience is not None and not np.isnan(b.losses[-1]) and stop_round(b.losses[1:], self.patience) is not None:
                continue
            b.trees.append(self.trees[cm])
            if len(b.trees) < self.rounds and b.trees[-1].feature[0] >= 0:
                go.append(cm)
        self.still = go

    def wrote(self) -> None:
        """The rows' scores now hold all trees."""
        self.written_to, self.slots, places_ = len(self.models[self.still[0]].trees), {}, {}
        for cm in self.still:
            self.slots[cm] = places_[cm[0]] = places_.get(cm[0], -1) + 1


def _grow_by_passes(fleet: Fleet, growth: Growth) -> None:
    """A pass a level; every KEEP rounds the rows are written anew with their scores, so that passes apply few trees."""
    rows, written = fleet.blocks, None
    while growth.still:
        state = growth.state()
        for level in range(BOOST_DEPTH):
            asked = growth.ask(level, state)
            if asked is None:
                break
            growth.take(level, summed(fleet, ["y", "bins", "fold", "out", *(["f"] if written is not None else [])], *asked, rows))
        growth.end_round()
        if growth.still and len(growth.models[growth.still[0]].trees) - growth.written_to >= KEEP:
            fresh = cut_lineage(_with_scores(rows, growth.state(), written is not None)).persist()
            if written is not None:
                written.unpersist()
            rows = written = fresh
            growth.wrote()
    if written is not None:
        written.unpersist()


def _grow_in_place(fleet: Fleet, growth: Growth) -> None:
    """The same rounds where a task may hold a model's rows: its sums are then the whole sums, so it goes from level to level, and
    from round to round, without a pass for each. Models grow side by side."""
    size, width = 2 ** (BOOST_DEPTH + 1) - 1, BINS + 1
    rounds, patience, models = growth.rounds, growth.patience, growth.models

    def grow(cell: int, m: int, c: dict) -> np.ndarray:
        cm, inside = (cell, m), c["fold"] != m
        own = Growth({cm: models[cm]}, {cm: 0}, rounds, patience)
        b = own.models[cm]
        (y, bins), (y_out, bins_out) = ((c["y"][use], np.compress(use, c["bins"].T, 1).T) for use in (inside & ~c["out"], inside & c["out"]))
        raw, raw_out = np.full(len(y), b.base), np.full(len(y_out), b.base)
        counts, hist = node_histograms(bins, np.zeros(len(y), np.int64), 1, [None], width)[0], {}
        pair, at, last, deep = np.empty(len(y), np.complex128), np.zeros(len(y), np.uint8), None, 0
        while own.still:
            root = np.zeros((bins.shape[1], width), np.complex128)
            for lo in range(0, len(y), BOOST_ROWS):  # the last tree, the next gradients and the sums of the root while a portion is at hand
                some = slice(lo, lo + BOOST_ROWS)
                if last is not None:
                    here = at[some]
                    for level in range(deep, BOOST_DEPTH):
                        here = step_down(last.feature, last.bin, bins[some], level, here)
                    raw[some] += np.take(bottom_values(last.feature, last.value, BOOST_DEPTH), here)
                p = expit(raw[some])
                pair.real[some], pair.imag[some] = p - y[some], p * (1 - p)
                add_root(root, bins[some], pair[some])
            loss = np.array([(softplus(raw_out) - y_out * raw_out).sum(), len(y_out)])
            at[:], deep = 0, 0
            for level in range(BOOST_DEPTH):
                nodes = own.open(level).get(cm)
                if not nodes:
                    break
                if level == 0:
                    hist = {0: np.stack([root.real, root.imag, counts[0]])}
                else:
                    hist, deep = level_histograms(bins, pair, counts, own.trees[cm], nodes, level, hist, width, at), level
                sums = np.stack([hist[q] for q in nodes], 1)
                own.take(level, {0: _boost_finish({0: (len(nodes), bins.shape[1])}, width)(0, np.concatenate([loss, sums.ravel()]))})
            own.end_round()
            if own.still:
                last = b.trees[-1]
                raw_out = raw_scores(b.packed(len(b.trees) - 1), bins_out, raw_out)
        _, feature, cut, value = b.packed()
        return np.concatenate([[len(b.losses), len(feature)], b.losses, feature.ravel(), cut.ravel(), value.ravel()]).astype(np.float64)

    names = {i: cm for cm, i in growth.key.items()}
    for i, data in grown_by_units(fleet, growth.key, ["y", "bins", "fold", "out"], grow).items():
        n_losses, n = int(data[0]), int(data[1])
        model = models[names[i]]
        model.losses = data[2:2 + n_losses].tolist()
        feature, cut, value = data[2 + n_losses:].reshape(3, n, size)
        model.trees = [Tree(f.astype(np.int16), b.astype(np.uint8), v) for f, b, v in zip(feature, cut, value)]


def _node_numbers(tree: Tree, nodes: list[int], bins: np.ndarray, level: int) -> np.ndarray:
    """For each row the number of its node in ``nodes``, which are of one level; len(nodes) for none of them."""
    number = np.full(2 ** level, len(nodes), np.int64)
    number[np.array(nodes) - (2 ** level - 1)] = np.arange(len(nodes))
    return number[places(tree.feature, tree.bin, bins, level)]


def stop_round(losses: list[float], patience: int) -> int | None:
    """The round at which ``patience`` rounds have passed without a new lowest loss; None if that does not happen."""
    best, best_at = float("inf"), 0
    for at, loss in enumerate(losses, 1):
        if loss < best:
            best, best_at = loss, at
        elif at - best_at >= patience:
            return at
    return None


def _scores(state: tuple[Packed, int | None], c: dict) -> np.ndarray:
    """Raw scores of a cell's rows: those written, and the trees after them."""
    packed, slot = state
    return raw_scores(packed, c["bins"], None if slot is None else c["f"][:, slot])


def _boost_local(sent: dict, state: dict, key: dict, level: int, width: int) -> Callable:
    def local(sums, cell, c):
        for m, nodes, tree in sent.get(cell, []):
            cm = (cell, m)
            raw, inside = _scores(state[cm], c), c["fold"] != m
            out = c["out"] & inside
            p = expit(raw)
            node = np.where(inside & ~out, _node_numbers(tree, nodes, c["bins"], level), len(nodes))
            hist = node_histograms(c["bins"], node, len(nodes), [p - c["y"], p * (1 - p), None], width)
            loss = [float((np.logaddexp(0.0, raw[out]) - c["y"][out] * raw[out]).sum()), float(out.sum())] if level == 0 else [0.0, 0.0]
            add(sums, key[cm], np.concatenate([loss, hist.ravel()]))
    return local


def _boost_finish(shapes: dict, width: int) -> Callable:
    def finish(k, data):
        nodes, d = shapes[k]
        if not d:
            return np.concatenate([data[:2], np.tile([-1.0] + [0.0] * 8, nodes)])
        return np.concatenate([data[:2], best_splits(*data[2:].reshape(3, nodes, d, width)).ravel()])
    return finish


def _with_scores(rows: DataFrame, state: dict, has: bool) -> DataFrame:
    by_cell: dict = {}
    for cm in state:
        by_cell.setdefault(cm[0], []).append(cm)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, c in columns_of(b):
                n = len(c["y"])
                own = by_cell.get(cell, [])
                c["f"] = np.stack([_scores(state[cm], c) for cm in own]).T if own else np.zeros((n, 0))
                yield block(cell, n, c)

    names = ["cell", "n", "y", "bins", "fold", "tie", "out", *(["f"] if has else [])]
    return rows.select(*names).mapInArrow(run, BLOCK + ", f binary")


# ---------------------------------------------------------------- forest
#: Chances of at most 0, 1, 2 ... draws of a row: Poisson with mean 1.
DRAWS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def bag(tie: np.ndarray, model: int, trees: int, seed: int = SEED, first: int = 0) -> np.ndarray:
    """How often each row is drawn for each tree from ``first`` on (rows x trees), from the row key."""
    salt = mixed(np.arange(first, first + trees, dtype=np.uint64) + np.uint64((model + 1) << 20) + np.uint64(seed << 40))
    chance = unit(tie.astype(np.uint64)[:, None] ^ salt[None, :])
    out = np.zeros(chance.shape, np.uint8)
    for most in DRAWS:  # as a binary search would, without its branches
        out += chance >= most
    return out.astype(np.float64)


def chosen_features(model: int, tree: np.ndarray, node: np.ndarray, d: int, seed: int = SEED) -> np.ndarray:
    """The features tried at each node (nodes x sqrt(d), ascending), from a hash of model, tree and node."""
    own = mixed((tree.astype(np.uint64) << np.uint64(20)) + node.astype(np.uint64) + np.uint64((model + 1) << 40) + np.uint64(seed << 52))
    rank = mixed(own[:, None] + np.arange(d, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(rank, 1, kind="stable")[:, :max(1, int(np.sqrt(d)))], 1)


def best_cuts(n: np.ndarray, w: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """For each node (nodes x features x bins: rows, draws, draws of class 1) the feature's place, bin, and left rows, draws and draws of
    class 1 of the split with the largest fall of the Gini impurity; -1: none."""
    nl, wl, l1 = (np.cumsum(v, 2)[:, :, :-1] for v in (n, w, w1))
    nt, wt, t1 = (v[:, :1].sum(2)[:, :, None] for v in (n, w, w1))
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = (l1 * l1 + (wl - l1) ** 2) / wl + ((t1 - l1) ** 2 + (wt - wl - t1 + l1) ** 2) / (wt - wl) - (t1 * t1 + (wt - t1) ** 2) / wt
    fall = np.where((nl >= FOREST_LEAF) & (nt - nl >= FOREST_LEAF), np.round(fall, 9), -1.0)
    flat = fall.reshape(len(fall), -1)
    best = flat.argmax(1)
    f, b = np.divmod(best, fall.shape[2])
    i = np.arange(len(fall))
    out = np.stack([f, b, nl[i, f, b], wl[i, f, b], l1[i, f, b]], 1).astype(np.float64)
    out[flat[i, best] <= 0, 0] = -1
    return out


@dataclass
class Forest:
    """Trees by node array; P(1) is the mean share of class 1 in the leaves."""

    cell: Cell
    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def chance(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for f, c, v in zip(self.feature, self.bin, self.value):
            out += bottom_values(f, v, FOREST_DEPTH)[places(f, c, bins, FOREST_DEPTH)]
        return out / len(self.feature)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return raw_chances(self, x)

    def probability(self) -> Column:
        return arrow_probability(self)


def fit_forest(fleet: Fleet, trees: int = TREES, seed: int = SEED) -> dict[int, tuple[Forest, tuple[float, float]]]:
    """For every cell the forest on all rows, and mean and spread of the cross-validated accuracy.

    All trees of all models grow a level at a time. A node is split if it has FOREST_SPLIT rows and both classes, into
    sides of FOREST_LEAF rows. Bags and feature subsets are hashes, so a repeated task gives the same trees."""
    edges = bin_edges(fleet, FOREST_BINS)
    models = by_work(fleet)
    rows = binned_rows(fleet, edges).persist()
    fleet = replace(fleet, blocks=rows)
    width, size = FOREST_BINS + 1, 2 ** (FOREST_DEPTH + 1) - 1
    grown = {cm: Forest(fleet.cells[cm[0]], edges[cm[0]], np.full((trees, size), -1, np.int16), np.zeros((trees, size), np.uint8), np.zeros((trees, size))) for cm in models}
    key = {cm: i for i, cm in enumerate(models)}
    base = {cm: [fleet.cells[cm[0]].rows(y, lambda f, i, m=cm[1]: f != m) for y in (0.0, 1.0)] for cm in models}
    for cm, (n0, n1) in base.items():
        grown[cm].value[:] = n1 / max(n0 + n1, 1)
    some = {cm: f for cm, f in grown.items() if f.cell.features}
    if fleet.units and max((fleet.cells[cell].rows() for cell, _ in some), default=0) * trees <= TASK_PATHS:
        _forest_in_place(fleet, some, key, width, trees, seed)
    else:
        _forest_by_passes(fleet, some, key, width, trees, seed)
    held = {cell: [grown[cell, m] for m in range(fleet.folds)] for cell in fleet.cells if len(fleet.models(cell)) > 1}
    scores = fold_accuracy(fleet, ["bins"], lambda cell, c, m: held[cell][m].chance(c["bins"]) > 0.5) if held else {}
    rows.unpersist()
    return {cell: (grown[cell, fleet.folds], scores.get(cell, (0.0, 0.0))) for cell in fleet.cells}


def _split(g: Forest, level: int, t: np.ndarray, p: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the splits found of nodes ``p`` of trees ``t`` into the forest; (tree, node) of the children that may split again."""
    f, b, nl, wl, l1, n, w, w1 = found.reshape(-1, 8).T
    if level == 0:  # a root's numbers come with the first split; the others are known from their parents'
        g.value[t, p] = np.where(w > 0, w1 / np.maximum(w, 1), g.value[t, p])
    split = (f >= 0) & (n >= FOREST_SPLIT) & (w1 > 0) & (w1 < w)
    t, p, f, b, nl, wl, l1, n, w, w1 = (v[split] for v in (t, p, f, b, nl, wl, l1, n, w, w1))
    g.feature[t, p], g.bin[t, p] = f, b
    after = []
    for child, cn, cw, c1 in ((2 * p + 1, nl, wl, l1), (2 * p + 2, n - nl, w - wl, w1 - l1)):
        g.value[t, child] = c1 / cw
        more = (cn >= FOREST_SPLIT) & (c1 > 0) & (c1 < cw)
        after.append((t[more], child[more]))
    return tuple(np.concatenate(x) for x in zip(*after))


def _forest_by_passes(fleet: Fleet, grown: dict, key: dict, width: int, trees: int, seed: int) -> None:
    """A level of all trees of all models a pass, or several passes where its histograms are over PASS_NUMBERS."""
    opened = {cm: (np.arange(trees), np.zeros(trees, np.int64)) for cm in grown}
    for level in range(FOREST_DEPTH):
        after: dict = {}
        for some in _portions(opened, fleet, width):
            local, finish = _forest_pass(some, grown, key, level, width, trees, seed)
            got = summed(fleet, ["y", "bins", "fold", "tie"], local, finish)
            for cm, (t, p) in some.items():
                if key[cm] in got:
                    after.setdefault(cm, []).append(_split(grown[cm], level, t, p, got[key[cm]]))
        opened = {cm: tuple(np.concatenate(x) for x in zip(*v)) for cm, v in after.items()}
        opened = {cm: v for cm, v in opened.items() if len(v[0])}
        if not opened:
            break


def _forest_in_place(fleet: Fleet, grown: dict, key: dict, width: int, trees: int, seed: int) -> None:
    """The same where a task may hold a model's rows: it grows tree after tree. Models grow side by side."""
    def grow(cell: int, m: int, c: dict) -> np.ndarray:
        g, inside = grown[cell, m], c["fold"] != m
        y, tie, bins = c["y"][inside], c["tie"][inside], np.compress(inside, c["bins"].T, 1).T
        for tree in range(trees):
            t, p = np.array([tree]), np.zeros(1, np.int64)
            parts = [Drawn(w, y[lo + use], np.take(bins.T[:, lo:lo + FOREST_ROWS], use, 1)) for lo in range(0, len(y), FOREST_ROWS)
                     for draws in [bag(tie[lo:lo + FOREST_ROWS], m, 1, seed, tree)[:, 0]] for use in [np.flatnonzero(draws)] for w in [draws[use]]]
            for level in range(FOREST_DEPTH):
                parts = [x for x in parts if len(x.row)]
                if not len(p) or not parts:
                    break
                features = chosen_features(m, t, p, bins.shape[1], seed)
                sums = np.zeros((features.shape[1], 3, len(p) * width))
                for x in parts:
                    x.add(sums, features, width)
                parents, hist = p, sums.reshape(-1, 3, len(p), width).transpose(1, 2, 0, 3)
                t, p = _split(g, level, t, p, _forest_finish({0: (features, width)})(0, hist.ravel()))
                if len(p):
                    first = 2 ** (level + 1) - 1
                    number = np.full(2 ** (level + 1), -1, np.int64)
                    number[p - first] = np.arange(len(p))
                    below = number[(2 * parents + 1 - first)[:, None] + np.arange(2)]
                    for x in parts:
                        x.descend(g.feature[tree, parents], g.bin[tree, parents], below)
        return np.stack([v[:] for v in (g.feature, g.bin, g.value)]).astype(np.float64).ravel()

    names = {i: cm for cm, i in key.items()}
    for i, data in grown_by_units(fleet, {cm: key[cm] for cm in grown}, ["y", "bins", "fold", "tie"], grow).items():
        g = grown[names[i]]
        feature, cut, value = data.reshape(3, *g.value.shape)
        g.feature, g.bin, g.value = feature.astype(np.int16), cut.astype(np.uint8), value


class Drawn:
    """Drawn rows of a tree, with the places of their nodes among the open ones; those that have reached a leaf are dropped."""

    def __init__(self, w: np.ndarray, y: np.ndarray, bins: np.ndarray):
        self.n, self.flat, self.counts = len(w), bins.ravel(), Counts(w, w * y)
        self.row, self.node = np.arange(len(w)), np.zeros(len(w), np.int64)

    def bins_of(self, feature: np.ndarray) -> np.ndarray:
        """Each row's bin of the feature of its node."""
        return np.take(self.flat, np.take(feature.astype(np.int64) * self.n, self.node) + self.row)

    def add(self, sums: np.ndarray, features: np.ndarray, width: int) -> None:
        """Adds rows, draws and draws of class 1 by node and bin to ``sums`` of each feature tried."""
        start = self.node * width
        for k in range(features.shape[1]):
            sums[k] += self.counts.sums(start + self.bins_of(features[:, k]), sums.shape[2])

    def descend(self, feature: np.ndarray, cut: np.ndarray, below: np.ndarray) -> None:
        """``below`` has the places of a node's children; -1: a leaf."""
        right = self.bins_of(np.maximum(feature, 0)) > np.take(cut, self.node)
        self.node = np.take(below.ravel(), 2 * self.node + right)
        stay = np.flatnonzero(self.node >= 0)
        if len(stay) < len(self.node):
            self.row, self.node, self.counts = self.row[stay], self.node[stay], self.counts.of(stay)


class Counts:
    """Adds up rows, draws and draws of class 1. They are whole numbers, so they are added as one where all three fit into the digits of
    a double, else as two or three."""

    def __init__(self, w: np.ndarray, w1: np.ndarray):
        self.n, self.all = len(w).bit_length(), int(w.sum()).bit_length()
        self.w, self.w1 = w, w1
        self.one = self.n + self.all + int(w1.sum()).bit_length() <= 53
        self.two = self.n + self.all <= 53
        if self.one:
            self.w = 1 + 2.0 ** self.n * (w + 2.0 ** self.all * w1)
        elif self.two:
            self.w = 1 + 2.0 ** self.n * w

    def of(self, row: np.ndarray) -> Counts:
        """Those of some rows."""
        out = copy(self)
        out.w, out.w1 = self.w[row], self.w1[row]
        return out

    def sums(self, at: np.ndarray, size: int) -> np.ndarray:
        """The three sums of the rows by ``at``."""
        sums = np.bincount(at, self.w, size)
        if not self.two:
            return np.stack([np.bincount(at, None, size), sums, np.bincount(at, self.w1, size)])
        whole = sums.astype(np.int64)
        n, rest = whole & ((1 << self.n) - 1), whole >> self.n
        if not self.one:
            return np.stack([n, rest, np.bincount(at, self.w1, size)])
        return np.stack([n, rest & ((1 << self.all) - 1), rest >> self.all])

    def by(self, at: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
        """The three sums of the rows ``row`` by ``at``."""
        return self.of(row).sums(at, size)


def _tree_histograms(bins: np.ndarray, w: np.ndarray, w1: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, nodes: np.ndarray, tried: np.ndarray, width: int) -> np.ndarray:
    """Rows, draws and draws of class 1 by (node, feature tried, bin) of one tree's ``nodes``, which are of one level."""
    number = np.full(2 ** level, -1, np.int64)
    number[nodes - (2 ** level - 1)] = np.arange(len(nodes))
    node = number[places(feature, cut, bins, level)]
    if (number < 0).any():
        row = np.flatnonzero(node >= 0)
        node, w, w1 = node[row], w[row], w1[row]
    else:
        row = np.arange(len(node))
    flat, one = bins.T.ravel(), np.flatnonzero(w1)
    out = np.empty((3, len(nodes), tried.shape[1], width))
    for k in range(tried.shape[1]):
        at = node * width + flat[(tried[:, k] * len(bins))[node] + row]
        for i, (x, by) in enumerate(((at, None), (at, w), (at[one], w1[one]))):
            out[i, :, k] = np.bincount(x, by, len(nodes) * width).reshape(len(nodes), width)
    return out


def _portions(opened: dict, fleet: Fleet, width: int) -> Iterator[dict]:
    """Open nodes in portions of PASS_NUMBERS histogram numbers at most (one node of one model at least)."""
    some, room = {}, PASS_NUMBERS
    for cm, (t, p) in opened.items():
        each = 3 * width * max(1, int(np.sqrt(len(fleet.cells[cm[0]].features))))
        lo = 0
        while lo < len(t):
            take = min(len(t) - lo, max(1, room // each))
            some[cm] = (t[lo:lo + take], p[lo:lo + take])
            lo, room = lo + take, room - take * each
            if room < each:
                yield some
                some, room = {}, PASS_NUMBERS
    if some:
        yield some


def _forest_pass(some: dict, grown: dict, key: dict, level: int, width: int, trees: int, seed: int) -> tuple[Callable, Callable]:
    sent, shape = {}, {}
    for (cell, m), (t, p) in some.items():
        g = grown[cell, m]
        features = chosen_features(m, t, p, len(g.cell.features), seed)
        own = [(tree, np.flatnonzero(t == tree)) for tree in np.unique(t).tolist()]
        top = max(2 ** level - 1, 1)  # the nodes above this level
        sent.setdefault(cell, []).append((m, g.feature[:, :top], g.bin[:, :top], p, features, own))
        shape[key[cell, m]] = (features, width)

    def local(sums, cell, c):
        for m, feature, cut, p, features, own in sent.get(cell, []):
            total = sums.setdefault(key[cell, m], np.zeros(3 * features.size * width)).reshape(3, *features.shape, width)
            inside = c["fold"] != m
            y, tie, bins = c["y"][inside], c["tie"][inside], np.compress(inside, c["bins"].T, 1).T
            for tree, at in own:
                draws = bag(tie, m, 1, seed, tree)[:, 0]
                use = draws > 0
                w = draws[use]
                total[:, at] += _tree_histograms(np.compress(use, bins.T, 1).T, w, w * y[use], feature[tree], cut[tree], level, p[at], features[at], width)

    return local, _forest_finish(shape)


def _forest_finish(shape: dict) -> Callable:
    def finish(k, data):
        features, width = shape[k]
        n, w, w1 = data.reshape(3, len(features), -1, width)
        out = best_cuts(n, w, w1)
        found = out[:, 0] >= 0
        out[found, 0] = features[found, out[found, 0].astype(int)]
        return np.concatenate([out, np.stack([v[:, 0].sum(1) for v in (n, w, w1)], 1)], 1).ravel()

    return finish
