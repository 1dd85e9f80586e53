import pytest

from mailquarry import api
from mailquarry.operators.scoring import Step, ladder

COLUMNS = "record_id bigint, subject string, body string, sender string, urls string"


def test_ladder_keeps_order(spark):
    steps = [Step("floor", 0.7, "x > 1"), Step("add", 0.1, "x > 1"), Step("cap", 0.75, "x > 2")]
    rows = spark.sql(f"select x, {ladder('0.2e0', steps)} as s from values (0), (2), (3) as t(x)").collect()
    assert {r["x"]: round(r["s"], 6) for r in rows} == {0: 0.2, 2: 0.8, 3: 0.75}


def test_messages(spark):
    rows = [(1, "Notice", "please review, thanks", "Ann <ann@google.com>", None), (2, "Hi", "see http://192.168.1.10/login", "x@bank.example", None), (3, "Hi", "see https://paypa1.com/verify", "PayPal <a@paypal.com>", None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["record_id"]: r for r in api.score_messages(df).collect()}
    assert got[2]["joint_score"] >= 0.84 and got[3]["joint_score"] >= 0.86
    assert got[1]["joint_score"] <= 0.25 and got[1]["url_count"] == 0
    assert all(0 <= r["joint_score"] <= 1 for r in got.values()) and len(got) == 4


@pytest.mark.parametrize("strategy", ["optimized", "baseline"])
def test_empty_table(spark, strategy):
    assert api.score_messages(spark.createDataFrame([], COLUMNS), strategy=strategy).count() == 0


def test_batch_equals_stream(spark, tables):
    from mailquarry.streaming.scoring import read_stream, run_available, score_url_stream

    path = f"{tables}/url_corpus.parquet"
    batch = sorted(map(str, score_url_stream(spark.read.parquet(path)).collect()))
    assert sorted(map(str, run_available(score_url_stream(read_stream(spark, path))).collect())) == batch


FULL = [(1, "Notice", "please review, thanks", "Ann <ann@google.com>", None), (2, "Hi", "see http://192.168.1.10/login and https://github.com/a", "x@bank.example", "https://github.com/a"), (3, None, None, None, None)]


def test_explained_messages(spark):
    df = spark.createDataFrame(FULL, COLUMNS)
    got = {r["record_id"]: r for r in api.score_messages(df, explain=True).collect()}
    assert got[2]["reasons"].split("|")[0] == "base_blend" and "optimized_blend" in got[2]["reasons"] and got[2]["reasons"].endswith("address_host")
    assert [r["url"] for r in got[2]["url_results"]] == ["https://github.com/a", "http://192.168.1.10/login"]
    assert [r["hard_cue"] for r in got[2]["url_results"]] == [False, True] and got[2]["any_url_hard_cue"]
    assert got[1]["url_results"] is None and got[1]["no_url_benign_support"] and got[3]["extracted_url_count"] == 0
    plain = {r["record_id"]: r for r in api.score_messages(df).collect()}
    assert all(plain[k]["joint_score"] == r["final_score"] for k, r in got.items())
    base = {r["record_id"]: r for r in api.score_messages(df, strategy="baseline", explain=True).collect()}
    assert "optimized_blend" not in base[2]["reasons"]
    with pytest.raises(ValueError):
        api.score_messages(df, strategy="other")


def test_modes_and_thresholds(spark):
    assert [api.resolve_threshold(m) for m in (" SOC ", "balanced", "high_confidence", "other", None)] == [0.4, 0.5, 0.6, 0.5, 0.5]
    assert [api.resolve_threshold("soc", t) for t in (0.33, 7, -1)] == [0.33, 1.0, 0.0]
    df = spark.createDataFrame(FULL, COLUMNS)
    assert {r["verdict"] for r in api.score_messages(df, threshold=0.0).collect()} == {"phishing"}
    assert {r["verdict"] for r in api.score_messages(df, threshold=1.0).collect()} == {"legitimate"}


def test_more_than_twenty_urls(spark):
    many = " ".join(f"http://h{k}.test/{k}" for k in range(30))
    df = spark.createDataFrame([(1, "s", many, None, None)], COLUMNS)
    row = api.score_messages(df, explain=True).first()
    assert (row["extracted_url_count"], row["analyzed_url_count"], len(row["url_results"])) == (30, 20, 20)


def test_batch_requests(spark):
    df = spark.createDataFrame([("a", "s", "see http://b.test/1, http://x.test/9", "me", "http://x.test/9 | http://y.test/2", " http://z.test/3 "), ("b", None, None, None, None, None)], "case_id string, subject string, body string, sender string, urls string, url string")
    url = {r["case_id"]: r for r in api.normalize_batch(df, "url").collect()}
    assert url["a"]["urls"].split() == ["http://z.test/3", "http://x.test/9", "http://y.test/2", "http://b.test/1"] and url["a"]["url_single"] == "http://z.test/3"
    assert url["a"]["body"] == "" and url["b"]["n_urls"] == 0 and url["b"]["url_single"] == ""
    assert api.normalize_batch(df).where("case_id = 'a'").first()["subject"] == "s"


def test_registered_functions(spark):
    names = api.register_functions(spark)
    row = spark.sql("select mq_entropy('aabb') as e, mq_risk_level(0.95D) as r, mq_url_risk_level(0.7D) as u, mq_sender_domain('A <a@B.Test>') as d").first()
    assert tuple(row) == (1.0, "critical", "high", "b.test") and len(names) == 4


def test_scratch_drops_its_tables(spark, tmp_path):
    from pathlib import Path

    from mailquarry.runtime import durable, scratch, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with scratch(spark):
        assert durable(spark.range(3)).count() == 3 and set(folder.iterdir()) > before
    with pytest.raises(RuntimeError), scratch(spark, keep=True):
        durable(spark.range(3))
        raise RuntimeError
    assert set(folder.iterdir()) == before
    with scratch(spark, keep=True):
        kept = durable(spark.range(3))
    assert kept.count() == 3
    after = set(folder.iterdir())
    with scratch(spark):
        with scratch(spark, keep=True):
            pass
        durable(spark.range(3))
        assert set(folder.iterdir()) > after
    assert set(folder.iterdir()) == after
