"""Registered split (J*) and mitigation (M*) queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritylab.operators import mitigate as mt
from paritylab.operators import profile as pf
from paritylab.operators import split as sp
from paritylab.plans.registry import register, view, with_views


def _sql(views: tuple[str, ...], body: str) -> str:
    return with_views("", *views).rstrip() + ",\n" + body


def _q(name, views, body):
    return register(name, _sql(views, body))


def h(seed: str, *exprs: str) -> str:
    """DuckDB twin of functions.hashing.hash_key."""
    parts = [f"'{seed}'"]
    for e in exprs:
        parts += ["'|'", f"COALESCE(CAST({e} AS VARCHAR), 'nan')"]
    return f"CAST(('0x' || substr(md5({' || '.join(parts)}), 1, 15)) AS BIGINT)"


def _split_sql(src: str, strata: list[str], test_size: float, seed: str, select: str) -> str:
    sk = " || '_' || ".join(f"COALESCE(CAST({c} AS VARCHAR), 'nan')" for c in strata) or "'all'"
    return f"""k AS (SELECT *, {sk} AS _sk FROM {src}),
c AS (SELECT _sk, COUNT(*) AS n FROM k GROUP BY _sk),
t AS (SELECT SUM(n) AS tot, SUM(n) - CAST(ceil({test_size} * SUM(n)) AS BIGINT) AS n_train FROM c),
b AS (SELECT _sk, n, (n * n_train) // tot AS base, (n * n_train) % tot AS rem, n_train FROM c, t),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, _sk) AS ord,
             n_train - SUM(base) OVER () AS leftover FROM b),
q AS (SELECT _sk, base + CASE WHEN ord <= leftover THEN 1 ELSE 0 END AS quota FROM o),
r AS (SELECT k.*, ROW_NUMBER() OVER (PARTITION BY k._sk ORDER BY {h(seed, 'row_id')}, row_id) AS _r FROM k),
s AS (SELECT r.*, CASE WHEN _r <= quota THEN 'train' ELSE 'test' END AS split FROM r JOIN q USING (_sk))
SELECT {select} FROM s"""


# 80/20 split stratified by label and sensitive attribute
@_q("stratified_split_orders", ("audit_orders",),
    _split_sql("audit_orders", ["y", "segment"], 0.2, "42", "row_id, segment, y, split"))
def _split(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "segment", "y")
    return sp.stratified_split(d, ["y", "segment"], 0.2, 42, fallback=[["y"]])


# 80/20 split stratified by the label, seed 42 + run (run 1)
@_q("stratified_split_customers_run1", ("audit_customers",),
    _split_sql("audit_customers", ["y"], 0.2, "43", "row_id, y, split"))
def _split2(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "y")
    return sp.stratified_split(d, ["y"], 0.2, 43, fallback=[])


# Stratified 5-fold assignment
@_q("stratified_folds_orders", ("audit_orders",), """
k AS (SELECT *, COALESCE(CAST(y AS VARCHAR), 'nan') AS _sk FROM audit_orders)
SELECT row_id, y, CAST((ROW_NUMBER() OVER (PARTITION BY _sk ORDER BY """ + h("42", "row_id") +
    """, row_id) - 1) % 5 AS INTEGER) AS fold FROM k""")
def _folds(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "y")
    return sp.stratified_folds(d, ["y"], 5, 42)


# Train / validation / test (20 % test, then 25 % of the rest) in one rank pass
def _tvt_sql() -> str:
    return f"""k AS (SELECT *, COALESCE(CAST(y AS VARCHAR), 'nan') AS _sk FROM audit_customers),
c AS (SELECT _sk, COUNT(*) AS n FROM k GROUP BY _sk),
t AS (SELECT SUM(n) AS tot, SUM(n) - CAST(ceil(0.2 * SUM(n)) AS BIGINT) AS n_train FROM c),
b AS (SELECT _sk, n, (n * n_train) // tot AS base, (n * n_train) % tot AS rem, n_train FROM c, t),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, _sk) AS ord, n_train - SUM(base) OVER () AS leftover FROM b),
q AS (SELECT _sk, base + CASE WHEN ord <= leftover THEN 1 ELSE 0 END AS q1 FROM o),
t2 AS (SELECT SUM(q1) AS tot, SUM(q1) - CAST(ceil(0.25 * SUM(q1)) AS BIGINT) AS n_train FROM q),
b2 AS (SELECT _sk, q1, (q1 * n_train) // tot AS base, (q1 * n_train) % tot AS rem, n_train FROM q, t2),
o2 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, _sk) AS ord, n_train - SUM(base) OVER () AS leftover FROM b2),
q2 AS (SELECT _sk, q1, base + CASE WHEN ord <= leftover THEN 1 ELSE 0 END AS q2 FROM o2),
r AS (SELECT k.*, ROW_NUMBER() OVER (PARTITION BY _sk ORDER BY {h('42', 'row_id')}, row_id) AS _r FROM k)
SELECT row_id, y, CASE WHEN _r <= q2 THEN 'train' WHEN _r <= q1 THEN 'val' ELSE 'test' END AS split
FROM r JOIN q2 USING (_sk)"""


register("train_val_test_customers", with_views("", "audit_customers").rstrip() + ",\n" + _tvt_sql())(
    lambda spark, sf: sp.train_val_test(view(spark, sf, "audit_customers").select("row_id", "y"), "y"))


# ---------------------------------------------------------------- M2 undersample / M1 oversample
def _quota_sql(strategy: str) -> str:
    size = "n" if strategy == "undersample" else "(SELECT MAX(n) FROM g)"
    return f"""base AS (SELECT row_id, segment, y FROM audit_customers),
rate AS (SELECT AVG(CAST(y AS DOUBLE)) AS r FROM base),
g AS (SELECT CAST(segment AS VARCHAR) AS _g, COUNT(*) AS n, COUNT_IF(y = 1) AS pos, COUNT_IF(y = 0) AS neg
      FROM base WHERE segment IS NOT NULL GROUP BY 1),
q0 AS (SELECT _g, pos, neg, CAST(floor({size} * r) AS BIGINT) AS qp, {size} AS sz FROM g, rate),
q AS (SELECT _g, 1 AS _y, qp AS _q, pos AS _avail FROM q0 UNION ALL SELECT _g, 0, sz - qp, neg FROM q0),
rk AS (SELECT row_id, segment, y, CAST(segment AS VARCHAR) AS _g, y AS _y,
       ROW_NUMBER() OVER (PARTITION BY CAST(segment AS VARCHAR), y ORDER BY {h('42', 'row_id')}, row_id) AS _r
       FROM base WHERE segment IS NOT NULL AND y IN (0, 1))"""


@_q("undersample_customers", ("audit_customers",), _quota_sql("undersample") + """
SELECT row_id, segment, y FROM rk JOIN q USING (_g, _y) WHERE _r <= _q""")
def _under(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "y")
    return mt.resample(d, "y", "segment", "undersample", 42)


@_q("oversample_customers", ("audit_customers",), _quota_sql("oversample") + """,
dr AS (SELECT _g, _y, i, (""" + h("42|draw", "_g", "_y", "i") + """ % _avail) + 1 AS _r
       FROM q, range(1, (SELECT MAX(_q) FROM q) + 1) t(i) WHERE i <= _q AND _avail > 0)
SELECT row_id, segment, y FROM dr JOIN rk USING (_g, _y, _r)""")
def _over(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "y")
    return mt.resample(d, "y", "segment", "oversample", 42)


# ---------------------------------------------------------------- M3 relabel (score given)
def _relabel_sql(src: str, sens: str, priv: str, score: str, cols: str) -> str:
    return f"""base AS (SELECT * FROM {src}),
ro AS (SELECT *, CASE WHEN {sens} = '{priv}' THEN 'privileged' WHEN {sens} IS NOT NULL THEN 'unprivileged' END AS _role FROM base),
st AS (SELECT _role, COUNT(*) AS n, COUNT_IF(y = 1) AS p FROM ro WHERE _role IS NOT NULL GROUP BY _role),
pl AS (SELECT _role, CAST(floor(n * (SELECT AVG(CAST(y AS DOUBLE)) FROM base)) AS BIGINT) - p AS flips FROM st),
cand AS (SELECT ro.*, flips FROM ro JOIN pl USING (_role)
         WHERE (flips > 0 AND y = 0) OR (flips < 0 AND y = 1)),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY _role ORDER BY CASE WHEN flips > 0 THEN -CAST({score} AS DOUBLE) ELSE CAST({score} AS DOUBLE) END, row_id) AS _r FROM cand),
fl AS (SELECT row_id FROM rk WHERE _r <= abs(flips))
SELECT {cols}, CASE WHEN row_id IN (SELECT row_id FROM fl) THEN 1 - y ELSE y END AS y FROM base"""


@_q("relabel_orders", ("audit_orders",), _relabel_sql("audit_orders", "segment", "BUILDING", "score",
                                                      "row_id, segment"))
def _relabel(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "segment", "y", "score")
    return mt.relabel(d, "y", "segment", "BUILDING", score="score").select("row_id", "segment", "y")


@_q("relabel_docs", ("audit_docs",), _relabel_sql("audit_docs", "lang", "en", "score", "row_id, lang"))
def _relabel_docs(spark, sf):
    d = view(spark, sf, "audit_docs").select("row_id", "lang", "y", "score")
    return mt.relabel(d, "y", "lang", "en", score="score").select("row_id", "lang", "y")


# ---------------------------------------------------------------- M6 CDA
_CDA_SQL = """
base AS (SELECT row_id, segment, region, y FROM audit_customers)
SELECT row_id, segment, region, y FROM base
UNION ALL
SELECT row_id, CASE WHEN segment = 'BUILDING' THEN 'AUTOMOBILE' WHEN segment IN ('AUTOMOBILE', 'FURNITURE')
                    THEN 'BUILDING' ELSE segment END, region, y FROM base"""


@_q("counterfactual_customers", ("audit_customers",), _CDA_SQL)
def _cda(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "region", "y")
    return mt.counterfactual_augment(d, "y", "segment", "BUILDING", ["AUTOMOBILE", "FURNITURE"])


# before/after tables around a mitigation (CDA)
@_q("compare_distribution_cda", ("audit_customers",), _CDA_SQL.replace(
    "base AS (SELECT row_id, segment, region, y FROM audit_customers)\n",
    "base AS (SELECT row_id, segment, region, y FROM audit_customers),\naft AS (") + """),
u AS (SELECT 'Baseline' AS stage, segment FROM base UNION ALL SELECT 'Mitigated', segment FROM aft)
SELECT stage, segment, COUNT(*) AS n FROM u GROUP BY 1, 2""")
def _cmp_dist(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "region", "y")
    after = mt.counterfactual_augment(d, "y", "segment", "BUILDING", ["AUTOMOBILE", "FURNITURE"])
    return pf.compare_distribution(d, after, "segment")


@_q("compare_sensitive_target_cda", ("audit_customers",), _CDA_SQL.replace(
    "base AS (SELECT row_id, segment, region, y FROM audit_customers)\n",
    "base AS (SELECT row_id, segment, region, y FROM audit_customers),\naft AS (") + """),
u AS (SELECT 'Baseline' AS stage, segment, y FROM base UNION ALL SELECT 'Mitigated', segment, y FROM aft)
SELECT stage, segment, y, COUNT(*) AS n FROM u GROUP BY 1, 2, 3""")
def _cmp_st(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "region", "y")
    after = mt.counterfactual_augment(d, "y", "segment", "BUILDING", ["AUTOMOBILE", "FURNITURE"])
    return pf.compare_sensitive_target(d, after, "segment", "y")


@_q("selection_rates_undersample", ("audit_customers",), _quota_sql("undersample") + """,
aft AS (SELECT row_id, segment, y FROM rk JOIN q USING (_g, _y) WHERE _r <= _q),
u AS (SELECT 'Baseline' AS stage, segment AS "group", CAST(y AS DOUBLE) AS _y FROM base
      UNION ALL SELECT 'Mitigated', segment, CAST(y AS DOUBLE) FROM aft)
SELECT stage, "group", AVG(_y) AS selection_rate FROM u GROUP BY 1, 2
UNION ALL SELECT 'Global', NULL, AVG(CAST(y AS DOUBLE)) FROM base""")
def _selrates(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "y")
    after = mt.resample(d, "y", "segment", "undersample", 42)
    return pf.selection_rates(d, after, "segment", "y")


# ---------------------------------------------------------------- M5 SMOTE (oracle: brute-force kNN)
def _smote_sql(feats: tuple, others: tuple, axis: str) -> str:
    """SMOTE whose neighbours are nearest over ``feats``, ranked along ``axis``; ``others`` are interpolated too."""
    nums = (*feats, *others)
    listed = ", ".join(nums)
    d2 = " + ".join(["0.0", *[f"(o.{c} - b.{c}) * (o.{c} - b.{c})" for c in feats]])
    imputed = ", ".join(f"CAST(COALESCE({c}, (SELECT AVG({c}) FROM base)) AS DOUBLE) AS {c}" for c in nums)
    steps = ", ".join(f"b.{c} + dr._u * (o.{c} - b.{c}) AS {c}" for c in nums)
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in nums)
    return f"""base AS (SELECT row_id, segment, region, y, {listed} FROM audit_customers),
imp AS (SELECT row_id, segment, region, y, {imputed} FROM base),
pts AS (SELECT *, COALESCE(CAST(segment AS VARCHAR), 'nan') || '_' || COALESCE(CAST(y AS VARCHAR), 'nan') AS _g FROM imp),
cnt AS (SELECT _g, COUNT(*) AS n FROM pts GROUP BY _g),
mx AS (SELECT MAX(n) AS nmax, least(5, greatest(1, MIN(n) - 1)) AS k FROM cnt),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY _g ORDER BY {axis}, row_id) AS _pos FROM pts),
dr AS (SELECT cnt._g, i, ({h('42|base', 'cnt._g', 'i')} % n) + 1 AS _b, {h('42|nn', 'cnt._g', 'i')} % k AS _j,
              CAST({h('42|step', 'cnt._g', 'i')} AS DOUBLE) / 1152921504606846976.0 AS _u
       FROM cnt, mx, range(1, (SELECT nmax FROM mx) + 1) t(i) WHERE i <= nmax - n),
bs AS (SELECT DISTINCT _g, _b FROM dr),
pairs AS (SELECT b._g, b._pos AS _b, o.row_id AS _nk, {d2} AS d2
          FROM rk b JOIN bs ON b._g = bs._g AND b._pos = bs._b JOIN rk o ON o._g = b._g AND o.row_id <> b.row_id),
nn AS (SELECT _g, _b, _nk, ROW_NUMBER() OVER (PARTITION BY _g, _b ORDER BY d2, _nk) - 1 AS _j FROM pairs),
rep AS (SELECT _g, ANY_VALUE(segment) AS segment, ANY_VALUE(y) AS y FROM pts GROUP BY _g),
syn AS (SELECT -({h('42|key', 'dr._g', 'dr.i')}) AS row_id, rep.segment, 'SYNTHETIC' AS region, rep.y, {steps}
        FROM dr JOIN nn ON nn._g = dr._g AND nn._b = dr._b AND nn._j = dr._j
        JOIN rk b ON b._g = dr._g AND b._pos = dr._b JOIN rk o ON o._g = dr._g AND o.row_id = nn._nk
        JOIN rep ON rep._g = dr._g)
SELECT row_id, segment, region, y, {shown} FROM imp
UNION ALL
SELECT row_id, segment, region, y, {shown} FROM syn"""


def _smote_of(feats: tuple, others: tuple):
    def run(spark, sf):
        from paritylab.operators.smote import smote
        nums = [*feats, *others]
        d = view(spark, sf, "audit_customers").select("row_id", "segment", "region", "y", *nums)
        out = smote(d, "y", "segment", list(feats), seed=42)
        return out.select("row_id", "segment", "region", "y", *[F.round(c, 6).alias(c) for c in nums])
    return run


for _name, _feats, _others in (("smote_customers", ("c_acctbal", "max_price"), ()),
                               ("smote_unlisted_customers", ("c_acctbal", "max_price"), ("n_orders",))):
    _q(_name, ("audit_customers",), _smote_sql(_feats, _others, "max_price"))(_smote_of(_feats, _others))
