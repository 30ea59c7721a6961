"""Registered queries: each name maps to a Spark builder (spark, sf_dir) -> DataFrame
and, when the result is expressible in SQL, the equivalent DuckDB query.

Every query reads the provided tables through the fixture views of
``paritylab.sources.fixtures`` and runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paritylab.sources.fixtures import duckdb_views, load_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_views(body: str, *views: str) -> str:
    """DuckDB text: the needed fixture views as CTEs, then ``body``."""
    dv = duckdb_views()
    needed = []
    for v in views:
        if v == "grid_results" and "audit_orders" not in needed:
            needed.append("audit_orders")
        if v not in needed:
            needed.append(v)
    ctes = ",\n".join(f"{v} AS ({dv[v]})" for v in needed)
    return f"WITH {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_view(spark, sf_dir, name)


# --- SQL fragments shared by the oracle texts -------------------------------

def counts_sql(src: str, group: str, label: str, pred: str, by: list[str] | None = None,
               where: str | None = None) -> str:
    by = by or []
    keys = ", ".join([*by, f'{group} AS "group"'])
    gb = ", ".join([*by, group])
    cond = f"{group} IS NOT NULL" + (f" AND ({where})" if where else "")
    return (f"SELECT {keys}, COUNT(*) AS n, COUNT_IF({pred} = 1) AS n_pred_pos, "
            f"COUNT_IF({label} = 1) AS n_pos, COUNT_IF({label} = 0) AS n_neg, "
            f"COUNT_IF({label} = 1 AND {pred} = 1) AS n_tp, "
            f"COUNT_IF({label} = 0 AND {pred} = 1) AS n_fp "
            f"FROM {src} WHERE {cond} GROUP BY {gb}")


RATES_SQL = ("CAST(n_pred_pos AS DOUBLE) / NULLIF(n, 0) AS rate, "
             "CAST(n_tp AS DOUBLE) / NULLIF(n_pos, 0) AS tpr, "
             "CAST(n_fp AS DOUBLE) / NULLIF(n_neg, 0) AS fpr")

METRICS_SQL = ("rate - p_rate AS spd, CASE WHEN p_rate <> 0 THEN rate / p_rate END AS di, "
               "tpr - p_tpr AS eod, 0.5 * ((fpr - p_fpr) + (tpr - p_tpr)) AS aod")
PARITY_SQL = "rate - p_rate AS spd, CASE WHEN p_rate <> 0 THEN rate / p_rate END AS di"


def individual_sql(src: str, group: str, priv: str, label: str, pred: str,
                   by: list[str] | None = None, parity_only: bool = False) -> str:
    by = by or []
    on = " AND ".join(f"r.{b} = p.{b}" for b in by) or "TRUE"
    bsel = "".join(f"r.{b}, " for b in by)
    pb = "".join(f"{b}, " for b in by)
    metrics = PARITY_SQL if parity_only else METRICS_SQL
    return (f"c AS ({counts_sql(src, group, label, pred, by)}),\n"
            f"r AS (SELECT *, {RATES_SQL} FROM c),\n"
            f"p AS (SELECT {pb}rate AS p_rate, tpr AS p_tpr, fpr AS p_fpr FROM r WHERE \"group\" = {priv})\n"
            f"SELECT {bsel}r.\"group\", {metrics} FROM r JOIN p ON {on} WHERE r.\"group\" <> {priv}")


def combined_sql(src: str, group: str, priv: str, label: str, pred: str,
                 by: list[str] | None = None, parity_only: bool = False) -> str:
    by = by or []
    role = f"CASE WHEN {group} = {priv} THEN 'privileged' WHEN {group} <> {priv} THEN 'unprivileged' END"
    bsel = "".join(f"{b}, " for b in by)
    gb = ("GROUP BY " + ", ".join(by)) if by else ""
    sums = ", ".join(
        f"COALESCE(CAST(SUM(CASE WHEN \"group\" = '{side}' THEN {c} END) AS BIGINT), 0) AS {pre}{c}"
        for side, pre in (("unprivileged", ""), ("privileged", "p_"))
        for c in ("n", "n_pred_pos", "n_pos", "n_neg", "n_tp", "n_fp"))
    metrics = PARITY_SQL if parity_only else METRICS_SQL
    return (f"c AS ({counts_sql(src, role, label, pred, by)}),\n"
            f"w AS (SELECT {bsel}{sums} FROM c {gb}),\n"
            f"r AS (SELECT *, {RATES_SQL}, "
            f"CAST(p_n_pred_pos AS DOUBLE) / NULLIF(p_n, 0) AS p_rate, "
            f"CAST(p_n_tp AS DOUBLE) / NULLIF(p_n_pos, 0) AS p_tpr, "
            f"CAST(p_n_fp AS DOUBLE) / NULLIF(p_n_neg, 0) AS p_fpr FROM w)\n"
            f"SELECT {bsel}{metrics} FROM r")
