"""Every query runs at the smallest size, and equals its SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

import mailquarry.plans.catalogue as catalogue

CORE = sorted(catalogue.queries())
SLOW = {n for n in CORE if n.startswith("ml_")}


def value(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in CORE if n not in SLOW])
def test_query(spark, duck, tables, name):
    df = catalogue.queries()[name](spark, tables)
    columns = sorted(df.columns)
    got = Counter(tuple(value(v) for v in row) for row in df.select(*columns).collect())
    if name in catalogue.oracle_sql():
        said = duck.execute(catalogue.oracle_sql()[name])
        names = [c[0] for c in said.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(value(row[k]) for k in at) for row in said.fetchall())


#: Accuracy that a model has at least at sf0.01 (the smallest tables hold too few URLs to fit trees to).
FLOORS = {"ml_url_ngrams": 0.9, "ml_url_trees": 0.9, "ml_url_calibrated": 0.9, "ml_joint_meta": 0.9, "ml_embedding_head": 0.4}


@pytest.mark.parametrize("name", sorted(FLOORS))
def test_models_reach_their_floor(spark, tables, name):
    larger = tables.replace("sf0.001", "sf0.01")
    assert all(r["accuracy"] >= FLOORS[name] and r["n"] > 0 for r in catalogue.queries()[name](spark, larger).collect())


def test_leakage_of_all_features(spark, tables):
    from mailquarry.ml.models import NUMERIC

    rows = catalogue.queries()["ml_source_leakage"](spark, tables).collect()
    assert [r["feature"] for r in rows] == NUMERIC and all(0 < r["accuracy"] <= 1 for r in rows)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
