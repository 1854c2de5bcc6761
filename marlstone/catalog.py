"""Registry of the engine's named queries.

A query module declares ``QUERIES``: a list of ``Query``. Each carries the Spark side (SQL text or a
function of ``(spark, sf_dir)``) and, where SQL can express it, the DuckDB text that returns the same rows.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

MODULES = [
    "operators.predicates",
    "operators.joins",
    "operators.aggregates",
    "operators.windows",
    "operators.ordering",
    "operators.recursion",
    "functions.dates",
    "functions.strings",
    "functions.conditional",
    "functions.semistructured",
    "functions.geometry",
    "functions.hashing",
    "sources.queries",
    "plans.loads",
    "plans.dimensions",
    "plans.views",
    "plans.control",
    "plans.security",
    "plans.procedures",
    "plans.retail",
    "plans.retail_model",
    "plans.operations",
    "streaming.queries",
]


#: Sums of integers that DuckDB returns wider than Spark does, by query.
WIDE = {
    "e18_merchant_pivot": ("views", "buys"),
    "p13_is_null": ("no_tier", "has_spend"),
    "p16_guarded_division": ("small",),
    "j22b_grain_aligned": ("lines_",),
    "j25_aggregate_before_join": ("n",),
    "a10_conditional_pivot": ("a", "n", "r"),
    "a17_null_sums": ("plain", "zeroed"),
    "a24_two_phase": ("n",),
    "w30_dense_activity": ("active7",),
    "w36_total_over": ("total",),
    "w39_sessions": ("last_session",),
    "u03_union_as_one_pass": ("f", "o"),
    "r03_downward_subtree": ("payroll",),
    "r04_closure_per_manager": ("team_pay",),
    "r05_bill_of_materials": ("qty",),
    "t05_funnel": ("views", "buys"),
}


@dataclass(frozen=True)
class Query:
    """One named query; ``run`` is SQL text over the tables' views or a function of (spark, sf_dir)."""

    name: str
    run: str | Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def same(name: str, text: str) -> Query:
    """A query whose text holds in both dialects; tables stand in braces."""
    return Query(name, text, bare(text))


def bare(text: str) -> str:
    """The text with its tables' braces removed."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The Parquet tables of a folder, by name."""
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables it names, bound as DataFrame parameters: no session-wide views are left behind."""
    used = {name: df for name, df in tables(spark, sf_dir).items() if f"{{{name}}}" in text}
    return spark.sql(text, **used)


def _all() -> list[Query]:
    found: list[Query] = []
    for name in MODULES:
        found += importlib.import_module(f"marlstone.{name}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for q in _all():
        out[q.name] = q.run if callable(q.run) else lambda spark, sf_dir, text=q.run: run_sql(spark, sf_dir, text)
    return out


def oracle_sql() -> dict[str, str]:
    return {q.name: _narrow(q) for q in _all() if q.oracle}


def _narrow(q: Query) -> str:
    """The oracle's text, its wide sums cast to what Spark returns."""
    if q.name not in WIDE:
        return q.oracle
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in WIDE[q.name])}) FROM ({q.oracle}) AS wide"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["w29_customer_metrics"](spark, sf_dir)
