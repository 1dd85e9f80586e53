import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailquarry.llm import splits

ALIAS = "domain_name string, same_as string"
MAIL = "record_id bigint, sender_domain string, source string"


def components(edges):
    f = splits.Forest()
    for a, b in edges:
        f.link(a, b)
    return {x: f.find(x) for e in edges for x in e}


@pytest.mark.parametrize("bound", [10**6, 40, 3])
def test_components(spark, bound):
    rnd = random.Random(bound)
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)]
    star = [("hub", f"s{k}") for k in range(80)]
    loose = [(f"x{rnd.randint(0, 60)}", f"x{rnd.randint(0, 60)}") for _ in range(40)]
    edges = [e for e in chain + star + loose if e[0] != e[1]]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges + [("q", "q"), (None, "z"), ("z", None)], "a string, b string").repartition(7)
    assert {r["a"]: r["root"] for r in splits.connected_components(df, bound).collect()} | {v: v for v in components(edges).values()} == components(edges)


def test_domain_key(spark):
    cases = {" Mail.A.Example. ": "a.example", "a.example": "a.example", "unknown": None, "": None, " ": None, None: None, "no host": None, "smtp.eu.b.test": "b.test"}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r["d"]: r["k"] for r in df.select("d", splits.domain_key(F.col("d")).alias("k")).collect()} == cases


def test_pairs_over_domains_that_never_send(spark):
    aliases = spark.createDataFrame([("A.test", "mid.test"), ("news.mid.test", "b.test."), ("c.test", "c.test"), (None, "d.test"), ("unknown", "d.test")], ALIAS)
    mail = spark.createDataFrame([(1, "x.A.test", "s"), (2, "B.test", "s"), (3, "c.test", None), (4, None, "s"), (5, "d.test", "s")], MAIL)
    assert [tuple(r) for r in splits.entity_pairs(mail, aliases).collect()] == [("a.test", "b.test")]
    assert splits.entity_pairs(mail.limit(0), aliases).count() == splits.entity_pairs(mail, aliases.limit(0)).count() == 0


@pytest.mark.parametrize("large", [20_000, 10])
def test_groups_stay_together(spark, large):
    rnd = random.Random(1)
    names = [f"d{int(rnd.paretovariate(0.6)) % 300}.test" for _ in range(1500)] + ["hot.test"] * 700
    rows = [(k, n if rnd.random() > 0.1 else None, rnd.choice(["enron", "nazario", None])) for k, n in enumerate(names)]
    mail = spark.createDataFrame(rows, MAIL)
    aliases = spark.createDataFrame([(f"d{k}.test", f"d{k + 1}.test") for k in range(0, 100, 3)], ALIAS)
    got = {r["record_id"]: r["split_name"] for r in splits.grouped_split(mail, aliases, large=large).collect()}
    assert len(got) == len(rows)
    root = components([(f"d{k}.test", f"d{k + 1}.test") for k in range(0, 100, 3)])
    sides = defaultdict(set)
    for k, n, s in rows:
        sides[root.get(n, n) if n else ("source", s)].add(got[k])
    assert all(len(v) == 1 for v in sides.values())
    share = sum(v == "train" for v in got.values()) / len(got)
    assert abs(share - 0.8) < 0.02
    assert splits.grouped_split(mail.limit(0), aliases).count() == 0


def test_fill_is_greedy():
    room = {"train": 8.0, "validation": 1.0, "test": 1.0}
    for size, count in ((3, 2), (2, 1), (1, 4)):
        step = dict(room)
        want = dict.fromkeys(room, 0)
        for _ in range(count):
            k = max(step, key=lambda s: (step[s], s))
            step[k] -= size
            want[k] += 1
        assert splits._fill(room, size, count) == want
