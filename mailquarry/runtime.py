"""Session helpers: durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees.

    The cluster names it in ``spark.checkpoint.dir``.  Only where the setting
    is absent (local tests) a temporary folder is created, once a session.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="mailquarry-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


_SCOPES: list[list[str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the open scopes drop what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[None]:
    """Scope at whose end the intermediate tables made in it are dropped, also on failure.

    With ``keep`` they stay unless it fails: a result that is yet to run reads them.
    """
    made: list[str] = []
    _SCOPES.append(made)
    drop = True
    try:
        yield
        drop = not keep
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]  # equal lists are not the same scope
        for path in made if drop else ():
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage; the copy survives the loss of executors, and lasts to the
    end of the ``scratch`` scope around it.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Broadcast hint on a *durable* narrow table of at most ``max_rows`` rows.

    Beyond the bound the table is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_mailquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="mailquarry-zip-")) / "mailquarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("mailquarry") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._mailquarry_shipped = True
