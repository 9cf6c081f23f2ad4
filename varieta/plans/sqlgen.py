"""SQL text helpers for the DuckDB oracle strings (mirror the DataFrame code)."""

from __future__ import annotations


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def class_counts_sql(src: str, group: list[str], label: str = "label",
                     pred: str = "prediction") -> str:
    g = ", ".join(group)
    gp = g + ", " if g else ""
    return f"""SELECT {gp}cls, SUM(t) AS support, SUM(p) AS predicted, SUM(tp) AS tp FROM (
    SELECT {gp}{label} AS cls, 1 AS t, 0 AS p, CASE WHEN {label} = {pred} THEN 1 ELSE 0 END AS tp
    FROM {src} WHERE {label} IS NOT NULL AND {pred} IS NOT NULL
    UNION ALL
    SELECT {gp}{pred} AS cls, 0 AS t, 1 AS p, 0 AS tp
    FROM {src} WHERE {label} IS NOT NULL AND {pred} IS NOT NULL) x
  GROUP BY {gp}cls"""


def per_class_sql(counts: str) -> str:
    return f"""SELECT *,
    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
    CASE WHEN support + predicted = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END AS f1
  FROM ({counts}) c"""
