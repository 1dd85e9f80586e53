"""python -m mailquarry QUERY FOLDER [OUT]: run a query, show or write its result."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalogue
from .runtime import scratch, ship
from .sources.sinks import write_parquet


def main() -> None:
    known = catalogue.queries()
    p = argparse.ArgumentParser(prog="mailquarry")
    p.add_argument("query", choices=sorted(known))
    p.add_argument("folder", help="folder of <table>.parquet")
    p.add_argument("out", nargs="?", help="parquet to write; without it twenty rows are shown")
    a = p.parse_args()
    spark = SparkSession.builder.appName(f"mailquarry {a.query}").getOrCreate()
    ship(spark)
    with scratch(spark):
        df = known[a.query](spark, a.folder)
        write_parquet(df, a.out) if a.out else df.show(20, truncate=80)


if __name__ == "__main__":
    main()
