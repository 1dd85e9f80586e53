"""Queries of the problems on training data and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import authored, mojibake, neardup, overlap, packing, pii, splits, sql, subjects, tokens


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark, d):
    return neardup.near_duplicate_pairs(_t(spark, d, "emails"), "record_id", ["subject", "body"])


def p1_classes(spark, d):
    return neardup.near_duplicate_classes(_t(spark, d, "emails"), "record_id", ["subject", "body"])


def p2_found(spark, d):
    return pii.mentions(_t(spark, d, "emails"))


def p2_redacted(spark, d):
    return pii.redacted(_t(spark, d, "emails"))


def p3_found(spark, d):
    return overlap.cross_split_pairs(_t(spark, d, "emails"), _t(spark, d, "email_splits")).select("record_a", "record_b")


def p3_report(spark, d):
    return overlap.overlap_report(_t(spark, d, "emails"), _t(spark, d, "email_splits"))


def p4_found(spark, d):
    return authored.line_segments(_t(spark, d, "emails"))


def p4_authored(spark, d):
    return authored.authored_text(_t(spark, d, "emails"))


def p5_found(spark, d):
    return mojibake.garbled_fields(_t(spark, d, "emails"), _t(spark, d, "documents")).select("record_id", "field_name")


def p5_restored(spark, d):
    return mojibake.garbled_fields(_t(spark, d, "emails"), _t(spark, d, "documents"))


def p6_found(spark, d):
    return splits.entity_pairs(_t(spark, d, "emails"), _t(spark, d, "domain_aliases"))


def p6_assign(spark, d):
    return splits.grouped_split(_t(spark, d, "emails"), _t(spark, d, "domain_aliases"))


def p6_shares(spark, d):
    return splits.split_shares(_t(spark, d, "emails"), _t(spark, d, "domain_aliases"))


def p8_ids(spark, d):
    return tokens.encode_texts(_t(spark, d, "documents"))


def p8_decoded(spark, d):
    return tokens.decode_ids(tokens.encode_texts(_t(spark, d, "documents")))


def p8_multi_ids(spark, d):
    return tokens.encode_texts(_t(spark, d, "documents"), "byte_bpe_multi_50k")


def p8_word_ids(spark, d):
    return tokens.encode_texts(_t(spark, d, "documents"), "word_bpe_49k")


def p8_piece_ids(spark, d):
    return tokens.encode_texts(_t(spark, d, "documents"), "piece_bpe_32k")


def p9_found(spark, d):
    return packing.splittable(packing.pack(_t(spark, d, "documents")))


def p9_containers(spark, d):
    return packing.pack(_t(spark, d, "documents"))


def p9_fill(spark, d):
    return packing.fill_report(packing.pack(_t(spark, d, "documents")))


def _subject_tables(spark, d):
    return [_t(spark, d, t) for t in ("documents", "subject_areas", "document_subjects")]


def p10_found(spark, d):
    return subjects.document_areas(*_subject_tables(spark, d))


def p10_shares(spark, d):
    return subjects.area_shares(*_subject_tables(spark, d))


def queries() -> dict:
    return {k: v for k, v in globals().items() if re.match(r"p\d+_", k)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
