import re

from hypothesis import given, settings
from hypothesis import strategies as st

from mailquarry.operators.multivalue import explode_packed, packed_values


def split(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, urls string")
    rows = df.select("k", packed_values(df.urls).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["k"])]


A, B = "https://a.example/x?items=1,2;3|4", "www.b.test/?q=5"


def test_notations(spark):
    both = [A, B]
    cases = [f"{A}, {B}", f"{A}|{B}", f"{A} ; {B}", f"{A}\n\n{B}", f"{A}||{B}", f'["{A}", "{B}"]', f"['{A}', '{B}']", f'"{A}";"{B}"', f'"{A}",{B}', f"{A},'{B}',", f";;{A} {B} ", f"{A},nan,{B}", f"<{A}><{B}>", f"{A}, , {B}\r\n"]
    assert split(spark, cases) == [both] * len(cases)


def test_nothing(spark):
    assert split(spark, [None, "", " ", "[]", "None", "nan", "|", ",;", "n/a"]) == [[]] * 9


def test_escapes_repeats_and_placeholders(spark):
    got = split(spark, [r'["http:\/\/a.test\/b"]', f"{A}|{A}", "https://x.test/0, \"https://y.test/0\""])
    assert got[0] == ["http://a.test/b"] and got[1] == [A, A]
    assert got[2] == ["https://x.test/0", "https://y.test/0"]


def test_positions_and_clashing_columns(spark):
    df = spark.createDataFrame([("c1", f"{A} {B}", 7, "z")], "case_id string, urls string, pos int, url string")
    rows = explode_packed(df, "t", "case_id", "urls").collect()
    assert [tuple(r) for r in rows] == [("t", "c1", 1, A), ("t", "c1", 2, B)]
    assert explode_packed(df.limit(0), "t", "case_id", "urls").count() == 0


url = st.builds(lambda h, p, q: f"http://{h}.example/{p}" + (f"?f={q}" if q else ""), st.from_regex(r"[a-z]{1,8}", fullmatch=True), st.from_regex(r"[a-z/]{0,9}", fullmatch=True), st.from_regex(r"([0-9]{1,2}([,;|][0-9]{1,2}){0,3})?", fullmatch=True))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.lists(url, min_size=1, max_size=5), st.sampled_from([", ", "|", " ; ", "\n", "||", ","]), st.sampled_from(["", '"', "'"])), min_size=30, max_size=60))
def test_round_trip(spark, lists):
    texts = [mark.join(f"{q}{u}{q}" for u in urls) for urls, mark, q in lists]
    assert split(spark, texts) == [urls for urls, _, _ in lists]


def test_long_text(spark):
    assert len(split(spark, [" ".join(f"https://h{k}.test/" for k in range(5000))])[0]) == 5000
    assert re.match("https", split(spark, ["https://a.test/" + "x" * 500_000])[0][0])
