"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame over the whole
driver tables; the SQL string is the same computation for DuckDB over the
pre-registered views.  Computed columns carry the same alias on both sides;
doubles are rounded to 6 places and integers cast to BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # Import for side effects: each module registers its queries.
    from . import q_metrics, q_text, q_dataset, q_codemix, q_retrieval, q_model, q_stream  # noqa: F401
    return REGISTRY
