import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mailquarry.llm import subjects


def test_a_confirming_label_raises_the_posterior():
    rows = [(lex, 0, 1, 1, human, n) for lex, n in ((0, 9000), (1, 400), (2, 300), (3, 700)) for human, n in ((0, n), (1, n // (10 if lex > 1 else 80)), (2, n // (60 if lex > 1 else 12)))]
    table = pd.DataFrame(rows, columns=["lex", "head", "address", "origin", "human", "n"])
    post = table.assign(p=subjects.fit_votes(table)).pivot(index="lex", columns="human", values="p")
    assert (post[1] > post[0]).all() and (post[0] > post[2]).all()


def test_accuracies_are_learned_and_not_given():
    """The address decides where it proves reliable and weighs little where it does not."""

    def table(rows):
        return pd.DataFrame([(lex, 0, a, 1, 0, n) for lex, a, n in rows], columns=["lex", "head", "address", "origin", "human", "n"])

    of = lambda t, lex, a: t.assign(p=subjects.fit_votes(t)).query(f"lex == {lex} and address == {a}")["p"].iloc[0]
    good = table([(0, 0, 9000), (0, 3, 200), (2, 3, 490), (2, 0, 10), (1, 0, 300), (1, 3, 294)])
    bad = table([(0, 0, 6300), (0, 3, 2700), (2, 3, 150), (2, 0, 350), (1, 0, 210), (1, 3, 90)])  # no more often where the area holds
    assert of(good, 1, 3) > 0.9 and of(good, 1, 3) - of(good, 1, 0) > 0.5 > of(bad, 1, 3) - of(bad, 1, 0)
    assert of(good, 0, 0) < 0.01


def _corpus(spark, n):
    law, sport = "The tribunal met and the plaintiff spoke", "The goalkeeper and the midfielder left the stadium"
    rows = [(k, f"{law if k % 2 else sport} today. Word{'abcdefghij'[k % 10]} w{'abcdefghij'[k // 10 % 10]}x many more plain words stand here.", None, None) for k in range(n)]
    rows += [(n + k, f"{law}, estoppel again.", None, None) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sender_domain string, source string")
    return docs, spark.createDataFrame([("law",), ("sport",)], "subject_area string"), spark.createDataFrame([], "doc_id bigint, subject_area string")


def _tokens(docs):
    rows = docs.select(F.lit(None).cast("array<int>").alias("labels"), F.col("doc_id").alias("row_no"), "text")
    return rows.mapInArrow(subjects._tokenise, f"labels array<int>, row_no bigint, {subjects._TOKENS}")


def test_a_rare_word_enters_the_lexicon_at_any_size(spark):
    docs, _, _ = _corpus(spark, 300)
    # the words fit the bound; 1/200 of the sightings would be 20 documents
    lexicon = subjects.learn_lexicon(_tokens(docs), {"law": "", "sport": ""}, 2, 200)
    assert lexicon.find(subjects.word_hash(["estoppel", "nosuchword"]))[0].tolist() == [0, -1]


def test_a_lexicon_beyond_the_bound_gives_the_same(spark):
    tables = _corpus(spark, 60)
    want, got = (sorted(map(tuple, subjects.subject_posteriors(*tables, rounds=2, vocabulary=v).collect())) for v in (200_000, 3))
    assert want and [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_many_domains_are_joined_with_the_same_result(spark, monkeypatch):
    docs, areas, labels = _corpus(spark, 60)
    docs = docs.withColumn("sender_domain", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")))).withColumn("source", F.lit("one"))
    monkeypatch.setattr(subjects, "HOT_KEYS", 4)
    want, got = (sorted(map(tuple, subjects.subject_posteriors(docs, areas, labels, rounds=1, small=n).collect())) for n in (subjects.SMALL, 0))
    assert want and [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "One two. Two THREE: four!\n\nx two Ünïcode_5"), (2, "  .\n"), (3, None)], "doc_id bigint, text string")
    rows = {r["row_no"]: r for r in _tokens(docs).collect()}
    names = dict(zip(subjects.word_hash(w := ["one", "two", "three", "four", "ünïcode"]).tolist(), w))
    r = rows[1]
    said, at = [], 0
    words, lens, places = (np.frombuffer(r[c], kind).tolist() for c, kind in (("words", np.int64), ("lens", np.int32), ("places", np.int32)))
    for n in lens:
        said.append({names[h] for h in words[at : at + n]})
        at += n
    assert said == [{"one", "two"}, {"two", "three"}, {"four"}, {"two", "ünïcode"}]
    assert [p for h, p in zip(words, places) if names[h] == "two"] == [3, 3, 3] and r["head"]
    assert rows[2]["lens"] == b"" and rows[3]["words"] == b"" and not rows[3]["head"]


def test_no_areas_and_no_texts(spark):
    docs, areas, labels = _corpus(spark, 4)
    assert subjects.subject_posteriors(docs, areas.limit(0), labels).count() == 0
    assert subjects.subject_posteriors(docs.limit(0), areas, labels).count() == 0


def test_an_area_outside_the_list_is_seeded_by_its_description(spark):
    texts = ["The tribunal met the plaintiff. Counsel read the affidavit.", "The beekeeper opened the hive. A swarm left the hive. Honey was plenty.", "Nobody came. The lamp fell."]
    docs = spark.createDataFrame([(k, texts[k % 3], None, None) for k in range(30)], "doc_id bigint, text string, sender_domain string, source string")
    areas = spark.createDataFrame([("apiculture", "hive, honey and swarm"), ("law", None)], "subject_area string, about string")
    got = {tuple(r) for r in subjects.document_areas(docs, areas, spark.createDataFrame([], "doc_id bigint, subject_area string")).collect()}
    assert got == {(k, ("law", "apiculture")[k % 3]) for k in range(30) if k % 3 < 2}
