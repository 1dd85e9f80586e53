import pytest

from mailquarry import api
from mailquarry.functions import url as u
from mailquarry.functions.dialect import SPARK
from mailquarry.operators import urls


def parsed(spark, values, columns, decode=True):
    df = spark.createDataFrame([(v,) for v in values], "url string")
    rows = spark.sql(f"with {u.parts(SPARK, '{t}', decode=decode)} select url, {columns} from parts", t=df).collect()
    return {r["url"]: r for r in rows}


NORMAL = {
    "https://paypal.com/security": ("https://paypal.com/security", "paypal.com", False),
    "paypal.com/login": ("https://paypal.com/login", "paypal.com", False),
    "http://192.168.1.10/login": ("https://192.168.1.10/login", "192.168.1.10", True),
    "https://example.com/path?a=1&b=2&redirect=http://evil.com": ("https://example.com/path?a=1&b=2&redirect=http://evil.com", "example.com", False),
    "https://a.com/x;y=1?z=2#f": ("https://a.com/x?z=2", "a.com", False),
    "HTTP://www.A.com:80": ("https://a.com/", "a.com", False),
    "https://999.1.1.1/": ("https://999.1.1.1/", "999.1.1.1", False),
    "a.com/a+b%20c%zz": ("https://a.com/a+b c%zz", "a.com", False),
    "": ("https:///", "", False),
    "http://": ("https:///", "", False),
    "https:///foo?x=1": ("https:///foo", "", False),
}


def test_normal_forms(spark):
    got = parsed(spark, NORMAL, "norm, host, is_ip")
    assert {k: (r["norm"], r["host"], r["is_ip"]) for k, r in got.items()} == NORMAL


def test_malformed_urls_never_fail(spark):
    got = parsed(spark, ["   ", "://bad", "not a url", "http://[::1", None, "x" * 100_000], "norm, host, registrable, subdomain, is_ip")
    assert all(r["norm"] is not None and r["host"] is not None for r in got.values())


@pytest.mark.parametrize(("url", "registrable", "subdomain"), [("https://www.paypal.com/", "paypal.com", "www"), ("https://docs.python.org/3/", "python.org", "docs"), ("http://192.168.1.10/login", "1.10", "192.168"), ("https://yahoo.com/login", "yahoo.com", "")])
def test_two_label_domains(spark, url, registrable, subdomain):
    df = spark.createDataFrame([(url,)], "url string")
    row = spark.sql(f"with {u.parts(SPARK, '{t}', decode=False)}, h as (select raw_host from parts) select {u.host_columns(SPARK, 'raw_host')} from h", t=df).first()
    assert (row["registrable"], row["subdomain"]) == (registrable, subdomain)


def test_trust_and_distance(spark):
    hosts = {"paypal.com": "exact_trusted_brand_domain", "www.paypal.com": "trusted_subdomain_ecosystem", "paypa1.com": "untrusted", "docs.python.org": "trusted_subdomain_ecosystem"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    least, name = u.closest_trusted(SPARK, "registrable")
    rows = spark.sql(f"with h as (select host, {u.host_columns(SPARK, 'host')} from {{t}}) select host, {u.trust_kind(SPARK, 'host', 'registrable')} as kind, {least} as distance, {name} as closest from h", t=df).collect()
    assert {r["host"]: r["kind"] for r in rows} == hosts
    assert next((r["distance"], r["closest"]) for r in rows if r["host"] == "paypa1.com") == (1, "paypal.com")


def test_confusable_skeleton(spark):
    df = spark.createDataFrame([("xn--80ak6aa92e.com",), ("plain.example",), (None,), ("xn--ü.com",)], "host string")
    got = {r["host"]: r["skeleton"] for r in urls.with_skeleton(df, "host").collect()}
    assert got["xn--80ak6aa92e.com"] == "apple.com" and got["plain.example"] == "plain.example" and got[None] is None


def test_basic_score_adds_up(spark):
    df = spark.createDataFrame([("http://192.168.1.10/login/verify",), ("https://example.com/",)], "url string")
    got = {r["url"]: r for r in api.score_urls(df).collect()}
    assert got["http://192.168.1.10/login/verify"]["score"] == pytest.approx(0.05 + 0.35 + 0.18 + 0.10 + 0.08 - 0.03, abs=1e-6)  # address, keywords, entropy 4.2, digits
    assert got["https://example.com/"]["score"] == pytest.approx(0.02, abs=1e-6)


def test_empty_table(spark):
    assert api.score_urls(spark.createDataFrame([], "url string")).count() == 0
