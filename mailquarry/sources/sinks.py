"""Sinks: datasets, metric tables with nested cells, batch exports, model bundles."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, quotes doubled."""
    flat(df).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def export_batch(df: DataFrame, path: str, score: str = "score") -> None:
    """A batch export: scores with four digits, every cell quoted."""
    flat(df.withColumn(score, F.expr(f"printf('%.4f', {score})"))).write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
