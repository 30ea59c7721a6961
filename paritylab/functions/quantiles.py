"""Exact, linearly interpolated quantiles of any number of values.

Quantiles of whole columns are found by radix selection: a scan counts the values of all columns by sign and binary
exponent, and only the buckets that hold a wanted rank are opened, in the next scan, into BUCKETS even parts of the range
between their smallest and largest value, until a bucket holds one value. A bucket of at most BUCKETS values is counted by
value. Each scan shuffles counts only, and one row a wanted rank reaches the driver; two or three scans are usual,
and a double's 52 bits below the exponent bound them by six.

Quantiles per key: values are counted per (keys, value) with partial aggregation; running sums over the distinct values
(``ranking.running_sums``: balanced ordered runs, no single-task sort or map) give every value the span of
ranks it fills, and only the values at the two ranks beside each quantile are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which a scan opens a bucket.
BUCKETS = 4096


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, value): the non-null values of ``cols`` as doubles, unpivoted."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*by, F.explode(F.array(*cells)).alias("_kv")).select(*by, "_kv.column", "_kv.value").where("value IS NOT NULL")


def exact_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str = "value") -> DataFrame:
    """keys..., q0, q1, ...: the quantiles of ``value`` at ``probs`` for every key; null keys are keys."""
    from paritylab.operators.ranking import broadcast_if_small, running_sums

    keys = list(keys)
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, "_v", ["_n"], by=keys, prefix="_c")
    size = counts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_size"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = cum.join(broadcast_if_small(size), same)  # one row per key

    def at(rank):
        return F.max(F.when((rank >= F.col("_c_n") - F.col("_n")) & (rank < F.col("_c_n")), F.col("_v")))

    def spot(p):
        return F.lit(float(p)) * (F.col("_size") - 1)

    picked = ranked.groupBy(*keys, "_size").agg(
        *[x for i, p in enumerate(probs) for x in (at(F.floor(spot(p))).alias(f"_lo{i}"), at(F.ceil(spot(p))).alias(f"_hi{i}"))])
    return picked.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot(p) - F.floor(spot(p)))).alias(f"q{i}")
                                  for i, p in enumerate(probs)])


def _scale(v: Column) -> Column:
    """Sign and binary exponent as one number that does not fall as ``v`` grows (NaN last, as Spark orders)."""
    size = F.abs(v)
    power = F.when(size == 0, F.lit(0.0)).when(size == F.lit(math.inf), F.lit(3000.0)).otherwise(F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-1074.0)) + 1100.0)
    return F.when(F.isnan(v), F.lit(5000.0)).otherwise(F.signum(v) * power)


def _opened(v: Column, low: float, high: float, rows: int) -> Column:
    """The part of [low, high] in which a value stands, or the value where there are few; null outside."""
    inside = (v >= F.lit(low)) & (v <= F.lit(high))
    part = v if rows <= BUCKETS else F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(BUCKETS))).cast("double")
    return F.when(inside, part)


def _buckets(cells: DataFrame) -> DataFrame:
    """(id, part, value) -> (id, before, n, least, most): the rows of an id before each part, and those in it."""
    counts = cells.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most some thousand parts an id
    return counts.select("id", "n", "least", "most", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], distinct: dict | None = None) -> dict[str, list[float]]:
    """Quantiles of each column by radix selection; columns without values are left out. ``distinct`` is filled with (least
    number of distinct values, whether that is their number), which the first scan shows."""
    if not cols:
        return {}
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    first = F.array(*[F.struct(F.lit(i).alias("id"), _scale(F.col(f"v{i}")).alias("part"), F.col(f"v{i}").alias("value")) for i in range(len(cols))])
    cells = values.select(F.explode(first).alias("x")).select("x.*").where("value IS NOT NULL")
    total = F.sum("n").over(Window.partitionBy("id"))

    def spot(p, size):
        return float(p) * (size - 1)

    def holds(rank):
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))

    single = F.col("least") == F.col("most")
    sized = _buckets(cells).withColumns({"size": total, "values": F.sum(F.when(single, 1).otherwise(2)).over(Window.partitionBy("id")),
                                         "all_single": F.min(single).over(Window.partitionBy("id"))})
    ranks = [f(spot(p, F.col("size"))) for p in probs for f in (F.floor, F.ceil)]
    found = sized.where(_any([holds(r) for r in ranks])).collect()
    sizes = {r["id"]: r["size"] for r in found}
    if distinct is not None:
        distinct.update({cols[r["id"]]: (r["values"], r["all_single"]) for r in found})
    wanted = {(i, f(spot(p, n))) for i, n in sizes.items() for p in probs for f in (math.floor, math.ceil)}
    known: dict = {}
    spans = {(i, rank): r for i, rank in wanted for r in found if r["id"] == i and r["before"] <= rank < r["before"] + r["n"]}
    start = {key: r["before"] for key, r in spans.items()}  # rows of the column before the span
    while True:
        for key, r in spans.items():
            if r["least"] == r["most"] or math.isnan(r["most"]) or key[1] in (start[key], start[key] + r["n"] - 1):
                known[key] = r["most"] if key[1] == start[key] + r["n"] - 1 else r["least"]
        open_ = sorted(key for key in spans if key not in known)
        if not open_:
            break
        boxes = sorted({(i, spans[i, k]["least"], spans[i, k]["most"], spans[i, k]["n"], start[i, k]) for i, k in open_})
        parts = F.array(*[F.struct(F.lit(b).alias("id"), _opened(F.col(f"v{i}"), low, high, n).alias("part"), F.col(f"v{i}").alias("value"))
                          for b, (i, low, high, n, _) in enumerate(boxes)])
        cells = values.select(F.explode(F.filter(parts, lambda x: x.part.isNotNull())).alias("x")).select("x.*")
        box = {key: next(b for b, v in enumerate(boxes) if v[0] == key[0] and v[4] == start[key]) for key in open_}
        inner = [(b, k - start[i, k]) for (i, k), b in box.items()]
        rows = _buckets(cells).where(_any([(F.col("id") == b) & holds(F.lit(r)) for b, r in inner])).collect()
        for key in open_:
            b, rank = box[key], key[1] - start[key]
            spans[key] = next(r for r in rows if r["id"] == b and r["before"] <= rank < r["before"] + r["n"])
            start[key] += spans[key]["before"]
    out = {}
    for i, n in sizes.items():
        q = []
        for p in probs:
            at = spot(p, n)
            low, high = known[i, math.floor(at)], known[i, math.ceil(at)]
            q.append(low + (high - low) * (at - math.floor(at)))
        out[cols[i]] = q
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
