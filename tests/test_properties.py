"""Property tests (hypothesis) for the pure helpers and the distributed rank."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paritylab.operators.ranking import bucketed_rank
from paritylab.operators.split import largest_remainder


@given(st.dictionaries(st.text(min_size=1, max_size=3), st.integers(min_value=0, max_value=50), min_size=1,
                       max_size=8), st.integers(min_value=0, max_value=200))
def test_largest_remainder_allocates_exactly(counts, n_draws):
    total = sum(counts.values())
    if total == 0:
        return
    n_draws = min(n_draws, total)
    q = largest_remainder(counts, n_draws)
    assert sum(q.values()) == n_draws
    for k, v in counts.items():
        exact = v * n_draws / total
        assert abs(q[k] - exact) < 1.0 + 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(min_value=-5, max_value=5)), min_size=1, max_size=60))
def test_bucketed_rank_matches_sort(spark, rows):
    data = [(i, g, float(v)) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, v double")
    # coarse, order-preserving bucket: floor(v / 3)
    out = bucketed_rank(df, ["g"], F.floor(F.col("v") / 3), [F.col("v"), F.col("id")], "r").collect()
    got = {r["id"]: r["r"] for r in out}
    for g in "abc":
        members = sorted((v, i) for i, gg, v in data if gg == g)
        for rank, (_, i) in enumerate(members, start=1):
            assert got[i] == rank
