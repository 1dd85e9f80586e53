"""Entry points for callers: DataFrames in, scored DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicons as lx
from .functions.dialect import SPARK
from .functions.url import parts
from .operators import scoring, urls
from .plans import catalogue


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that a plan reads and the frame lacks, as nulls."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def resolve_threshold(mode: str | None = "balanced", threshold: float | None = None) -> float:
    """The threshold given, within [0, 1], else that of the operating mode, else 0.5."""
    if threshold is not None:
        return max(0.0, min(1.0, float(threshold)))
    return lx.MODE_THRESHOLDS.get((mode or "balanced").strip().lower(), 0.5)


def _ranks(df: DataFrame, ranks: DataFrame | None) -> DataFrame:
    return ranks if ranks is not None else df.sparkSession.createDataFrame([], "rank_pos int, domain_name string")


def _explained(out: DataFrame, explain: bool) -> DataFrame:
    return out if explain else out.drop("reasons")


def score_urls(df: DataFrame) -> DataFrame:
    """Heuristic scores of a frame with ``url``; the same for a stream."""
    return df.sparkSession.sql(urls.url_basic_scores(SPARK), url_corpus=_with(df, {"label": "int", "source": "string", "phish_id": "int"}))


def fuse_urls(df: DataFrame, explain: bool = True) -> DataFrame:
    """Fusion of the scores ``v1`` and ``v2`` of two models for the ``url`` of each row.

    Where one of them is null the other counts alone; rows where both are null get
    no row.  International names are decoded before lookalikes are sought.
    Columns: url, v1, v2, score, verdict, trust_kind, has_hard_cue, reasons.
    """
    spark = df.sparkSession
    given = df.select("url", F.col("v1").cast("double").alias("v1"), F.col("v2").cast("double").alias("v2")).where("v1 is not null or v2 is not null")
    hosts = spark.sql(f"with {parts(SPARK, '{given}', decode=False)} select url, v1, v2, raw_host from parts", given=given)
    shown = urls.with_skeleton(hosts, "raw_host").select("url", "v1", "v2", F.substring_index("skeleton", ".", -2).alias("shown"))
    shown = shown.select("url", "shown", F.col("v1").alias("a"), F.col("v2").alias("b"), F.when(F.col("v2").isNull(), "v1").when(F.col("v1").isNull(), "v2").otherwise("both").alias("given"))
    plan = scoring.fused(SPARK, "{shown}", "a", "b", models=("both", "v1", "v2"), shown="shown")
    columns = "url, a as v1, b as v2, round(score, 6) as score, verdict, kind as trust_kind, hard as has_hard_cue, reasons"
    return _explained(spark.sql(f"with {plan} select {columns} from fused where models = given", shown=shown), explain)


def score_emails(df: DataFrame, ranks: DataFrame | None = None, mode: str = "balanced", threshold: float | None = None, explain: bool = True) -> DataFrame:
    """E-mail scores of messages (record_id, subject, body) after their guards, with reasons and the action to take."""
    plan = scoring.email_guards(SPARK, f"{resolve_threshold(mode, threshold)}e0")
    return _explained(df.sparkSession.sql(plan, emails=_with(df, {"label": "int", "urls": "string", "sender": "string"}), domain_ranks=_ranks(df, ranks)), explain)


def score_messages(df: DataFrame, ranks: DataFrame | None = None, strategy: str = "optimized", mode: str = "balanced", threshold: float | None = None, explain: bool = False) -> DataFrame:
    """Joint scores of messages (record_id, subject, body, sender, urls).

    ``ranks`` (rank_pos, domain_name) may be left out: then no domain is ranked.
    ``strategy`` is optimized or baseline.  ``mode`` (soc, balanced, high_confidence)
    or ``threshold`` decide the verdict.  With ``explain`` each message has its weights,
    flags and reasons, and ``url_results``, the URLs analysed with their scores.
    """
    if strategy not in ("optimized", "baseline"):
        raise ValueError(f"unknown strategy: {strategy}")
    spark = df.sparkSession
    at = f"{resolve_threshold(mode, threshold)}e0"
    tables = {"emails": _with(df, {"label": "int", "urls": "string"}), "domain_ranks": _ranks(df, ranks)}
    if not explain:
        plan = {"optimized": scoring.joint_scores, "baseline": scoring.joint_baseline}[strategy]
        return spark.sql(plan(SPARK, at), **tables)
    whole = spark.sql(scoring.joint_assembly(SPARK, at), **tables).where(F.col("strategy") == strategy)
    found = spark.sql(scoring.joint_url_results(SPARK), **tables)
    each = found.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("pos", "url", "score", "label", "hard_cue"))).alias("url_results"))  # at most 20 of a message
    return whole.join(each, "record_id", "left")


def normalize_batch(df: DataFrame, mode: str = "joint") -> DataFrame:
    """Rows of a batch (case_id, subject, body, sender, urls, url) as requests of a mode: url, email or joint."""
    from .operators.requests import batch_requests

    cases = _with(df, {"subject": "string", "body": "string", "sender": "string", "urls": "string", "url": "string"})
    return df.sparkSession.sql(batch_requests(SPARK, "{cases}", mode), cases=cases)


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A registered query over the tables of a folder."""
    return catalogue.queries()[name](spark, sf_dir)


def health(spark: SparkSession) -> dict:
    """What is there: version of Spark, number of queries."""
    return {"status": "ok", "spark": spark.version, "queries": len(catalogue.queries())}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers the URL functions for SQL; returns their names."""
    made = []
    for name, (argument, expression) in scoring.sql_functions(SPARK).items():
        spark.sql(f"create or replace temporary function mq_{name}({argument}) returns {'string' if name != 'entropy' else 'double'} return {expression}")
        made.append(f"mq_{name}")
    return made
