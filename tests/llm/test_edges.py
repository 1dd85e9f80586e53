"""Nulls in any column, repeated rows, clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from mailquarry.llm import authored, mojibake, neardup, overlap, packing, pii, splits, subjects, tokens

TEXT = "Nobody opened the lamp since June, so nine of them were left behind the old cabinet near the river today. CafÃ©\n> quoted\n> more"
EMAILS = "record_id bigint, subject string, body string, sender string, sender_domain string, source string, urls string, key string, text string, n int, rep bigint, split string, entity string, c int, id bigint, flags int, h string"
DOCS = "doc_id bigint, text string, lang string, source string, sender_domain string, size int, container int, labels string, a int, votes int, w string, posterior double, ids string"


@pytest.fixture(scope="module")
def emails(spark):
    full = [(1, "s", TEXT, "Ann Nilsen <ann.nilsen@a.test>", "a.test", "x", None), (2, "s", TEXT, None, "A.test ", "x", ""), (None, "s", TEXT, "b@c.test", None, None, None), (4, None, None, None, None, None, None), (1, "s", TEXT, "Ann Nilsen <ann.nilsen@a.test>", "a.test", "x", None)]
    return spark.createDataFrame([(*r, "k", "t", 1, 2, "s", "e", 3, 4, 5, "h") for r in full], EMAILS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, lang, None, None, 1, 1, "l", 1, 1, "w", 0.1, "i") for k, t, lang in [(1, "The tribunal met. The tribunal ended.", "en"), (1, "The tribunal met. The tribunal ended.", "en"), (None, "text", None), (3, None, None), (4, "", "xx"), (5, "  ", "de")]], DOCS)


def test_emails(spark, emails):
    aliases = spark.createDataFrame([("a.test", "b.test", 1), (None, None, None)], "domain_name string, same_as string, entity int")
    held = spark.createDataFrame([(1, "train", None, None), (2, "test", 1, None), (None, "test", 1, None), (4, None, None, None)], "record_id bigint, split_name string, run_no int, assigned_at timestamp")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert neardup.near_duplicate_classes(emails, "record_id", ["subject", "body"], 0.7, 5).count() > 0
    assert neardup.near_duplicate_pairs(emails, "record_id", ["subject", "body"], 0.7, 5).where("record_a = 1 and record_b = 2").count() > 0
    assert overlap.cross_split_pairs(emails, held, 0.8, 5).count() > 0
    assert overlap.overlap_report(emails, held, 0.8, 5).count() > 0
    assert authored.line_segments(emails).where("record_id is null").count() == 0
    assert authored.authored_text(emails).count() == 4
    assert {r["field_name"] for r in mojibake.garbled_fields(emails, docs).collect()} == {"body"}
    assert splits.entity_pairs(emails, aliases).count() == 0
    assert splits.grouped_split(emails, aliases).count() == emails.count()
    assert splits.split_shares(emails, aliases).agg(F.sum("records")).first()[0] == emails.count()
    lex = pii.learn(emails)
    assert pii.mentions(emails, lexicons=lex).where("record_id = 1 and pii_kind = 'email'").count() == 2
    assert pii.redacted(emails, lexicons=lex).count() > 0


def test_documents(spark, docs):
    areas = spark.createDataFrame([("law", None), ("sport", "x")], "subject_area string, about string")
    labels = spark.createDataFrame([(1, "law", None, None), (None, None, None, None)], "doc_id bigint, subject_area string, labelled_by string, labelled_at timestamp")
    assert tokens.encode_texts(docs).count() == tokens.token_counts(docs).count() == 5
    packed = packing.pack(docs)
    assert packed.count() == 5 and packing.fill_report(packed).first()["containers"] == 1
    assert {(r["doc_id"], r["subject_area"]) for r in subjects.document_areas(docs, areas, labels).collect()} == {(1, "law")}
    assert subjects.area_shares(docs, areas, labels).count() == 2
