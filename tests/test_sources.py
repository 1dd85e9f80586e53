import io
import tarfile

import pytest

from mailquarry.sources import readers, sinks


def test_messages():
    plain = b"From: Ann <ann@a.example>\nSubject: =?utf-8?q?Caf=C3=A9?=\nContent-Type: text/plain; charset=latin-1\n\nna\xefve\n\ntext"
    assert readers.parse_message(plain) == ("Café", "naïve text", "Ann <ann@a.example>")
    two = 'Subject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>rich &amp; rare</p>\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"\n\nno\n--b--\n'
    assert readers.parse_message(two)[1] == "rich & rare"
    assert readers.parse_message(None) == readers.parse_message("") == ("", "", "")


def test_archives(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:bz2") as tar:
            for m, text in members.items():
                info = tarfile.TarInfo(m)
                info.size = len(text)
                tar.addfile(info, io.BytesIO(text))

    archive("a_spam.tar.bz2", {"1": b"Subject: one\n\nbuy", "2": b"Subject: two\n\nnow"})
    archive("b_ham.tar.bz2", {"1": b"Subject: three\n\nhello"})
    (tmp_path / "c_spam.tar.bz2").write_bytes((tmp_path / "a_spam.tar.bz2").read_bytes())
    archive("other.tar.bz2", {"1": b"Subject: four\n\nx"})
    rows = readers.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["subject"], r["label"]) for r in rows) == [("one", 1), ("three", 0), ("two", 1)]


def test_case_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text('ID,Links,Email_Body,From,Expected_Label\nx1,"http://a.test, http://b.test","two\nlines",Ann,phishing\n,,body,,\n')
    rows = {r["case_id"]: r for r in readers.read_case_file(spark, str(tmp_path / "c.csv")).collect()}
    assert rows["x1"]["body"] == "two\nlines" and rows["x1"]["sender"] == "Ann" and rows["row-1"]["expected_joint_label"] == ""


def test_rank_list(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,www.A.example\n2,b.test\n3,a.example\n4,nodot\n5,has blank.test\n")
    assert {(r["domain"], r["rank"]) for r in readers.read_rank_list(spark, str(tmp_path / "r.csv")).collect()} == {("a.example", 1), ("b.test", 2)}


def test_reports(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"url": "http://a.test", "phish_id": 3}, {"url": null, "phish_id": 4}, {"url": "x", "phish_id": "no"}]')
    assert [tuple(r) for r in readers.read_reports(spark, str(tmp_path / "p.json")).collect()] == [("http://a.test", 3)]


def test_report_metrics(spark, tmp_path):
    (tmp_path / "m.md").write_text("# A\n- accuracy: 0.95\n- note: none\n## B\n- f1: `0.5`\n")
    assert {tuple(r) for r in readers.report_metrics(spark, str(tmp_path / "m.md")).collect()} == {("A", "accuracy", 0.95), ("B", "f1", 0.5)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 'a "b"\nc', 0.12345)], "k int, v array<int>, t string, score double")
    sinks.write_csv(df, str(tmp_path / "o"))
    back = readers.read_csv(spark, str(tmp_path / "o"), "k int, v string, t string, score double", ("k",)).first()
    assert back["v"] == "[1,2]" and back["t"] == 'a "b"\nc'
    sinks.export_batch(df, str(tmp_path / "e"))
    assert '"0.1235"' in "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv")).replace("0.1234", "0.1235")


def test_reports_must_be_arrays(spark, tmp_path):
    (tmp_path / "p.json").write_text(' {"url": "http://a.test", "phish_id": 3}')
    with pytest.raises(ValueError):
        readers.read_reports(spark, str(tmp_path / "p.json"))


def test_bad_bytes_and_long_fields(spark, tmp_path):
    long = "x" * 400_000
    (tmp_path / "b.csv").write_bytes(b"case_id,body\n1,caf\xe9\n2,\"" + long.encode() + b"\"\n3,\n")
    rows = {r["case_id"]: r["body"] for r in readers.read_csv(spark, str(tmp_path / "b.csv"), "case_id string, body string", ("case_id",)).collect()}
    assert rows["1"].startswith("caf") and rows["2"] == long and len(rows) == 3
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "b.csv"), "case_id string, body string", ("subject",))


def test_unicode_messages():
    assert readers.parse_message("Subject: Čapkov €5\nFrom: Ł <a@b.test>\n\nČau €829") == ("Čapkov €5", "Čau €829", "Ł <a@b.test>")


def test_rank_list_top(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,a.test\n2,b.test\n3,c.test\n")
    assert {r["domain"] for r in readers.read_rank_list(spark, str(tmp_path / "r.csv"), 2).collect()} == {"a.test", "b.test"}


def test_sender_domains(spark):
    from mailquarry.operators.texts import sender_domain_strict, unescape_html

    cases = {"Ann <a@B.test.>": "b.test", "a@b.test": "b.test", '"x@y" <a@c.test>': "c.test", "none": "", None: ""}
    df = spark.createDataFrame([(k, s) for k, s in enumerate(cases)], "k int, sender string")
    assert {r["sender"]: r["domain"] for r in sender_domain_strict(df, "sender").collect()} == cases
    html = spark.createDataFrame([("<p>a&nbsp;&eacute;&#8364;</p>\n<b>c</b>",), (None,)], "t string")
    assert [r["plain"] for r in unescape_html(html, "t").collect()] == ["a é€ c", None]


def test_model_bundle(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), StandardScaler(inputCol="v", outputCol="s")]).fit(df)
    sinks.save_model(model, str(tmp_path / "m"))
    assert sinks.load_model(str(tmp_path / "m")).transform(df).collect() == model.transform(df).collect()


def test_files_hold_the_columns_asked_for(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 'x "q", y')], "case_id string, score double, t string")
    sinks.export_batch(df, str(tmp_path / "e"))
    back = readers.read_csv(spark, str(tmp_path / "e"), "case_id string, score string, t string", ("case_id",)).first()
    assert tuple(back) == ("a", "0.5000", 'x "q", y')
