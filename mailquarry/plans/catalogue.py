"""Queries of the core operators and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import ORACLE, SPARK, Spark

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "joint_scores"

#: Modules that register queries.
MODULES = [
    "operators.multivalue",
    "operators.urls",
    "operators.texts",
    "operators.relational",
    "operators.metrics",
    "operators.scoring",
    "operators.requests",
    "ml.models",
    "streaming.scoring",
    "sources.queries",
]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings emails email_splits domain_aliases "
    "joint_threshold_calibration_set joint_eval_cases url_corpus domain_ranks subject_areas document_subjects"
).split()


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its statement."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a statement over the tables ``{name}`` of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def statement(name: str):
    """Register a plan that is stated once, as SQL over a dialect."""

    def add(text: Callable[[Spark], str]):
        QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text(SPARK))
        said = text(ORACLE)
        for t in TABLES:
            said = said.replace("{" + t + "}", t)
        SQL[name] = said
        return text

    return add


def _load() -> None:
    for name in MODULES:
        import_module(f"mailquarry.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
