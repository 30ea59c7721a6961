"""SMOTE over (sensitive, target) subgroups with exact k-nearest neighbours (M5).

Every subgroup except the largest is raised to the largest size. Synthetic
row i of subgroup g takes a base point b (uniform over the subgroup), one of
its k nearest neighbours n (uniform over the k) and a step u in [0, 1):
``x = x_b + u * (x_n - x_b)``; all three draws are md5 functions of
(seed, g, i), so the output is reproducible under task retry.

Exact kNN without comparing all pairs: points are ranked inside their
subgroup along one axis (a projection never longer than the true distance).
A base only meets the points within W positions of it; its k-th distance D
is *certified* when the first points outside the window on both sides are
at least D away along the axis (so nothing outside can be closer). Bases
that are not certified retry with a doubled window. Only drawn bases are
searched, and each search touches O(W) rows. Windows up to a halo are searched
inside blocks of consecutive positions, which hold the points a halo around
them as well: a point is shuffled once or twice, its pairs never. Bases that
no halo certifies meet their window's points in joins.

``features`` are the space of the neighbour search; every other numeric column
is imputed and interpolated as well. Text columns of a synthetic row hold
``SYNTHETIC``; types that can hold neither (booleans, dates) are NULL. Subgroup
sizes stay a table: any number of subgroups is balanced.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.functions.hashing import hash_key, hash_unit
from paritylab.functions.keys import key_string
from paritylab.operators import prep as pp
from paritylab.operators.ranking import broadcast_if_small, range_rank
from paritylab.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: text written into non-numeric columns of synthetic rows.
SYNTHETIC_TEXT = "SYNTHETIC"
EVAL_COL = "_fairness_eval_sens_attr"
# First half-window (positions on each side) of the neighbour search.
START_WINDOW = 16
DRAW_CHUNK = 1_000_000
# Halos of the searches inside blocks, positions of a block (in halos), and pairs that a task holds at a time.
HALOS, BLOCK_HALOS, PAIRS = (1 << 12, 1 << 15), 8, 1 << 19


def smote_features(df: DataFrame, target: str, sens: str, key: str,
                   features: Sequence[str] | None = None) -> list[str]:
    cand = features if features is not None else df.columns
    return [c for c in pp.numeric_columns(df, cand) if c not in (target, sens, EVAL_COL, key)]


def projection_axis(df: DataFrame, feats: Sequence[str]) -> str:
    """The feature with the largest spread (population std) -- one aggregate."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in feats]).first()
    return max(feats, key=lambda c: (row[c] or 0.0, -feats.index(c)))


def smote(df: DataFrame, target: str, sens: str, features: Sequence[str] | None = None,
          seed: int = 42, key: str = "row_id", k: int = 5, axis: str | None = None) -> DataFrame:
    feats = smote_features(df, target, sens, key, features)
    if not feats:
        return df
    original = df
    # mean-impute the numeric columns (originals are returned imputed too)
    nums = feats + [c for c in smote_features(df, target, sens, key) if c not in feats]
    df = pp.Imputer("mean", nums).fit_transform(df)
    df = df.select(*[F.col(c).cast("double").alias(c) if c in nums else F.col(c) for c in df.columns])
    g = F.concat(key_string(sens), F.lit("_"), key_string(target))
    sizes = cut_lineage(df.groupBy(g.alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.first(sens).alias("_s"),
                                                      F.first(target).alias("_t")))
    ends = sizes.agg(F.min("_n").alias("least"), F.max("_n").alias("most")).first()
    if ends["least"] is None or ends["least"] < 2:
        return original  # a subgroup too small to interpolate: the input, unchanged
    if ends["least"] == ends["most"]:
        return df
    kk = min(k, max(1, ends["least"] - 1))
    qt = sizes.where(F.col("_n") < ends["most"]).select("_g", (F.lit(ends["most"]) - F.col("_n")).alias("_m"), "_n")
    axis = axis or projection_axis(df, feats)
    pts = df.withColumn("_g", g).withColumn("_p", F.col(axis))
    ranked = range_rank(pts, ["_g"], [F.col("_p"), F.col(key)], "_pos").persist()
    pos_tbl = ranked.select("_g", "_pos", "_p", key, *nums)

    # draws: (g, i) -> base position, neighbour index, step (chunked generation)
    chunks = qt.select("_g", "_m", "_n", F.explode(F.sequence(F.lit(0), ((F.col("_m") - 1) / DRAW_CHUNK)
                                                                .cast("long"))).alias("_c"))
    chunks = chunks.repartition("_g", "_c")
    draws = chunks.select("_g", "_n", F.explode(F.sequence(F.col("_c") * DRAW_CHUNK + 1,
                                                           F.least(F.col("_m"), (F.col("_c") + 1) * DRAW_CHUNK)))
                          .alias("_i"))
    draws = draws.select(
        "_g", "_i",
        (F.pmod(hash_key(f"{seed}|base", "_g", "_i"), F.col("_n")) + 1).alias("_b"),
        F.pmod(hash_key(f"{seed}|nn", "_g", "_i"), F.lit(kk)).cast("int").alias("_j"),
        hash_unit(f"{seed}|step", "_g", "_i").alias("_u")).persist()

    bases = cut_lineage(draws.select("_g", "_b").distinct())
    knn = _exact_knn(bases, pos_tbl.drop(*nums[len(feats):]), sizes.select("_g", "_n"), ends["most"],
                     feats, key, kk)  # (_g, _b, _j, nn key)
    picked = draws.join(knn, ["_g", "_b", "_j"], "inner")
    base_x = pos_tbl.select("_g", F.col("_pos").alias("_b"), *[F.col(c).alias(f"_bx_{c}") for c in nums])
    nn_x = pos_tbl.select("_g", F.col(key).alias("_nk"), *[F.col(c).alias(f"_nx_{c}") for c in nums])
    syn = picked.join(base_x, ["_g", "_b"]).join(nn_x, ["_g", "_nk"])

    syn = syn.join(broadcast_if_small(sizes.select("_g", "_s", "_t")), "_g")
    out_cols = []
    for c in df.columns:
        dt = df.schema[c].dataType
        if c in nums:
            e = F.col(f"_bx_{c}") + F.col("_u") * (F.col(f"_nx_{c}") - F.col(f"_bx_{c}"))
        elif c == sens:
            e = F.col("_s")
        elif c == target:
            e = F.col("_t")
        elif c == EVAL_COL:
            e = F.col("_s")
        elif c == key:
            # negative keys mark synthetic rows (60-bit hash; 31-bit for INT keys)
            kh = hash_key(f"{seed}|key", "_g", "_i")
            if isinstance(dt, T.LongType):
                e = -kh
            elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
                e = -(F.pmod(kh, F.lit(2147483647)) + 1)
            else:
                e = F.concat(F.lit("synthetic-"), kh.cast("string"))
        elif isinstance(dt, (*pp.TEXT_TYPES,)):
            e = F.lit(SYNTHETIC_TEXT)
        else:
            e = F.lit(None)
        out_cols.append(e.cast(dt).alias(c))
    synthetic = syn.select(*out_cols)
    return df.unionByName(synthetic)


def _exact_knn(bases: DataFrame, pts: DataFrame, sizes: DataFrame, max_n: int, feats: Sequence[str], key: str,
               k: int) -> DataFrame:
    """(_g, _b) bases -> k rows (_g, _b, _j, _nk): the j-th nearest point of the
    same subgroup (distance, then key), certified by the projection gap."""
    sizes = broadcast_if_small(sizes)  # one row per subgroup
    pending = bases
    done = None
    w = START_WINDOW
    for halo in HALOS:
        found = cut_lineage(_block_search(pending, pts, sizes, w, halo, feats, key, k))
        res = found.where("_j >= 0")
        done = res if done is None else done.unionByName(res)
        pending = found.where("_j < 0").select("_g", "_b")
        if pending.isEmpty():
            return done
        w = 2 * halo
    base_rows = pts.select("_g", F.col("_pos").alias("_b"), F.col("_p").alias("_bp"),
                           F.col(key).alias("_bk"), *[F.col(c).alias(f"_b_{c}") for c in feats])
    while True:
        full = w + 1 >= max_n  # window covers every subgroup: certification is automatic
        cand = (pending.select("_g", "_b", F.explode(F.sequence(F.lit(-w), F.lit(w))).alias("_o"))
                .where(F.col("_o") != 0)
                .select("_g", "_b", (F.col("_b") + F.col("_o")).alias("_pos")))
        cand = cand.join(pts, ["_g", "_pos"]).join(base_rows, ["_g", "_b"])
        d2 = sum(((F.col(c) - F.col(f"_b_{c}")) * (F.col(c) - F.col(f"_b_{c}")) for c in feats), F.lit(0.0))
        cand = cand.select("_g", "_b", "_bp", F.col(key).alias("_nk"), d2.alias("_d2"))
        wr = Window.partitionBy("_g", "_b").orderBy("_d2", "_nk")
        # one evaluation per round: the check and the result read the same cut table
        top = cut_lineage(cand.withColumn("_j", F.row_number().over(wr) - 1).where(F.col("_j") < k))
        # k-th distance per base, and the axis gap to the first points outside the window
        kth = top.groupBy("_g", "_b", "_bp").agg(F.max("_d2").alias("_dk"), F.count(F.lit(1)).alias("_c"))
        edge_hi = pts.select("_g", (F.col("_pos") - (w + 1)).alias("_b"), F.col("_p").alias("_hi"))
        edge_lo = pts.select("_g", (F.col("_pos") + (w + 1)).alias("_b"), F.col("_p").alias("_lo"))
        chk = (kth.join(sizes, "_g")
               .join(edge_hi, ["_g", "_b"], "left").join(edge_lo, ["_g", "_b"], "left"))
        gap_ok = lambda edge, sign: F.col(edge).isNull() | (
            (F.lit(sign) * (F.col(edge) - F.col("_bp"))) * (F.lit(sign) * (F.col(edge) - F.col("_bp"))) > F.col("_dk"))
        ok = (F.col("_c") >= F.least(F.lit(k), F.col("_n") - 1)) & gap_ok("_hi", 1.0) & gap_ok("_lo", -1.0)
        # reliable checkpoint per round: the loop's lineage does not grow
        status = cut_lineage(chk.select("_g", "_b", (F.lit(full) | ok).alias("_ok")))
        good = status.where("_ok").select("_g", "_b")
        res = top.join(good, ["_g", "_b"], "left_semi").select("_g", "_b", "_j", "_nk")
        done = done.unionByName(res)
        pending_next = status.where("NOT _ok").select("_g", "_b")
        if full or pending_next.isEmpty():
            return done
        pending = pending_next
        w *= 2


def _block_search(bases: DataFrame, pts: DataFrame, sizes: DataFrame, first: int, halo: int, feats: Sequence[str], key: str, k: int) -> DataFrame:
    """``_exact_knn`` with windows from ``first`` up to ``halo``: (_g, _b, _j, _nk), or one row with _j = -1 for a base that none certifies."""
    size = BLOCK_HALOS * halo
    block = lambda pos: F.floor(pos / F.lit(size)).cast("long")
    own = bases.select("_g", "_b", block(F.col("_b")).alias("_k"))
    near = pts.select("_g", "_pos", "_p", key, *feats, F.explode(F.sequence(block(F.col("_pos") - halo - 1), block(F.col("_pos") + halo + 1))).alias("_k"))
    near = near.join(broadcast_if_small(own.select("_g", "_k").distinct()), ["_g", "_k"], "left_semi").join(sizes, "_g")
    kind = pts.schema[key].dataType

    def search(points: pa.Table, drawn: pa.Table) -> pa.Table:
        base, j, at = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        group = None
        if len(drawn) and len(points):
            points = points.sort_by("_pos")
            pos = points.column("_pos").to_numpy()
            axis, *x = (_doubles(points.column(c)) for c in ("_p", *feats))
            rank = pc.rank(points.column(key).combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            base, j, at = _nearest_in_block(pos, axis, x, rank, np.sort(drawn.column("_b").to_numpy()), points.column("_n")[0].as_py(), first, halo, k)
            group = points.column("_g")[0].as_py()
        nearest = points.column(key).take(pa.array(at, mask=at < 0))
        return pa.table([pa.array([group] * len(base), pa.string()), pa.array(base, pa.int64()), pa.array(j, pa.int32()), nearest], names=["_g", "_b", "_j", "_nk"])

    out = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_b", T.LongType()), T.StructField("_j", T.IntegerType()), T.StructField("_nk", kind)])
    return near.groupBy("_g", "_k").cogroup(own.groupBy("_g", "_k")).applyInArrow(search, out)


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy().astype(np.float64)


def _nearest_in_block(pos: np.ndarray, axis: np.ndarray, x: list[np.ndarray], rank: np.ndarray, bases: np.ndarray, n: int, first: int,
                      halo: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the base, j, place of its j-th neighbour in the block) for points of ascending, consecutive positions among a subgroup's
    ``n``; j = -1 and place -1 for a base that no window up to ``halo`` certifies."""
    here = np.searchsorted(pos, bases)
    out, w = [], first
    while len(here) and w <= halo:
        offsets = np.concatenate([np.arange(-w, 0), np.arange(1, w + 1)])
        later = []
        for lo in range(0, len(here), step := max(1, PAIRS // len(offsets))):
            b = here[lo:lo + step]
            at = b[:, None] + offsets
            real = (pos[b][:, None] + offsets >= 1) & (pos[b][:, None] + offsets <= n)
            at = np.where(real, at, b[:, None])
            d2 = np.zeros(at.shape)
            for v in x:
                gap = v[at] - v[b][:, None]
                d2 += gap * gap
            d2 = np.where(real, np.where(np.isnan(d2), np.inf, d2), np.nan)
            most = min(k, d2.shape[1])
            kth = np.partition(d2, most - 1, 1)[:, most - 1]
            last = np.where(np.isnan(kth), np.inf, kth)  # fewer than k others: all of them
            row, column = np.nonzero(d2 <= last[:, None])
            order = np.lexsort((rank[at[row, column]], d2[row, column], row))
            row, column = row[order], column[order]
            j = np.arange(len(row)) - np.searchsorted(row, row)
            some = np.bincount(row[j < k], minlength=len(b)) >= min(k, n - 1)
            far = np.full(len(b), -np.inf)
            np.maximum.at(far, row[j < k], d2[row[j < k], column[j < k]])
            for sign in (-1, 1):
                edge = pos[b] + sign * (w + 1)
                outside = (edge < 1) | (edge > n)
                there = np.where(outside, b, b + sign * (w + 1))
                gap = axis[there] - axis[b]
                some &= outside | (gap * gap > far)
            keep = (j < k) & some[row]
            out.append((pos[b[row[keep]]], j[keep], at[row[keep], column[keep]]))
            later.append(b[~some])
        here, w = np.concatenate(later), 2 * w
    out.append((pos[here], np.full(len(here), -1), np.full(len(here), -1)))
    return tuple(np.concatenate(v).astype(t) for v, t in zip(zip(*out), (np.int64, np.int32, np.int64)))
