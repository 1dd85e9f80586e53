import pytest

from mailquarry.operators.relational import numeric_feature_columns, salted_counts


def test_numeric_columns(spark):
    df = spark.createDataFrame([("1", "x", "3", "9"), ("2.5", "y", None, "9")], "a string, b string, c string, row_id string")
    assert numeric_feature_columns(df) == ["a"]
    with pytest.raises(ValueError):
        numeric_feature_columns(df.select("b"))


def test_salted_counts(spark):
    df = spark.createDataFrame([("h", k) for k in range(300)] + [("r", 1), (None, 2)], "d string, k int")
    assert {(r["d"], r["n"]) for r in salted_counts(df, "d", 8).collect()} == {("h", 300), ("r", 1), (None, 1)}
