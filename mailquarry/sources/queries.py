"""Queries that take the tables through the file formats and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import ORACLE, SPARK
from ..operators.requests import export_rows
from ..plans.catalogue import query, run_sql
from ..runtime import place
from . import readers, sinks


def _place(spark) -> str:
    return place(spark, "files")


@query("source_csv_round_trip", "select case_id, subject, body, scenario from joint_eval_cases")
def source_csv_round_trip(spark, d):
    """Cases written as CSV and read again; empty texts must not become null."""
    rows = spark.read.parquet(f"{d}/joint_eval_cases.parquet").select("case_id", "subject", "body", "scenario")
    path = _place(spark)
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path, rows.schema, ("case_id", "body"))


@query("source_export_round_trip", export_rows(ORACLE).replace("{joint_eval_cases}", "joint_eval_cases"))
def source_export_round_trip(spark, d):
    """A batch export of eight columns, every cell quoted, read again."""
    rows = run_sql(spark, d, export_rows(SPARK))
    path = _place(spark)
    sinks.export_batch(rows.withColumn("score", F.col("score").cast("double")), path)
    return readers.read_csv(spark, path, rows.schema, ("case_id", "score"))


@query("source_json_reports", "select url, phish_id from url_corpus where url is not null and phish_id is not null")
def source_json_reports(spark, d):
    """Reports written as files of one JSON array each, and read again."""
    path = _place(spark)
    rows = spark.read.parquet(f"{d}/url_corpus.parquet").select("url", "phish_id", F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("file"))
    # a report is one array, so that a file of it is one row here
    rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct("url", "phish_id"))).alias("value")).write.partitionBy("file").text(path)
    return readers.read_reports(spark, f"{path}/*/*")


@query("source_rank_list", "select lower(case when lower(trim(domain_name)) like 'www.%' then substr(trim(domain_name), 5) else trim(domain_name) end) as domain, min(rank_pos) as rank from domain_ranks where domain_name is not null group by 1")
def source_rank_list(spark, d):
    """The rank list written without header and read again."""
    path = _place(spark)
    spark.read.parquet(f"{d}/domain_ranks.parquet").select("rank_pos", "domain_name").write.csv(path)
    return readers.read_rank_list(spark, path)


_ONE_LINE = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}\\x{{85}}\\x0b\\x1c-\\x1f\\x00]+', ' ', 'g'))"


@query("source_mail_messages", f"select record_id, {_ONE_LINE.format('subject')} as subject, {_ONE_LINE.format('body')} as body, {_ONE_LINE.format('sender')} as sender from emails where body is not null")
def source_mail_messages(spark, d):
    """Records written as RFC-822 messages and parsed again."""
    rows = spark.read.parquet(f"{d}/emails.parquet").where("body is not null")
    line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    raw = F.concat(F.lit("From: "), line("sender"), F.lit("\nSubject: "), line("subject"), F.lit("\nContent-Type: text/plain; charset=utf-8\n\n"), F.col("body"))
    return readers.parse_messages(rows.select("record_id", raw.alias("message"))).select("record_id", "subject", "body", "sender")
