import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailquarry.llm import neardup, overlap, setjoin

SCHEMA = "record_id bigint, subject string, body string"


def words(*texts):
    return frozenset(re.findall(r"[^\W_]+", " ".join(t or "" for t in texts).lower()))


def brute(rows, threshold, least):
    sets = {k: words(*t) for k, *t in rows}
    good = {k: w for k, w in sets.items() if len(w) >= least}
    return {(a, b) for a, b in combinations(sorted(good), 2) if len(good[a] & good[b]) >= threshold * len(good[a] | good[b]) - 1e-9}


def corpus(n=160, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(90)] + ["Café", "ЁЛКА", "ß", "İstanbul", "x_y"]
    rows = []
    for k in range(n):
        if rows and rnd.random() < 0.6:
            _, s, b = rnd.choice(rows)
            w = (b or "").split()
            for _ in range(rnd.randint(0, 6)):
                if w and rnd.random() < 0.5:
                    w.pop(rnd.randrange(len(w)))
                else:
                    w.insert(rnd.randint(0, len(w)), rnd.choice(vocabulary))
            rows.append((k, s, " ".join(w)))
        else:
            rows.append((k, rnd.choice([None, "", "Hello"]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))))
    rows += [(1000 + k, None, rows[3][2]) for k in range(40)]  # a hot group of copies
    rows += [(2000, None, None), (2001, "", ""), (2002, "  ", "\n")]
    return rows


@pytest.mark.parametrize("knobs", [{}, {"max_region": 3, "block": 2}, {"max_ranked": 4}, {"max_region": 10, "block": 1000, "max_ranked": 50}])
@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_pairs_equal_brute_force(spark, knobs, threshold):
    rows = corpus()
    members, pairs = setjoin.similar_sets(spark.createDataFrame(rows, SCHEMA), "record_id", ["subject", "body"], threshold, 5, **knobs)
    got = {(r["x"], r["y"]) for r in neardup.expand_pairs(members, pairs).collect()}
    assert got == brute(rows, threshold, 5)


@pytest.mark.parametrize("knobs", [{"max_ranked": 1, "max_region": 2, "block": 3}, {"max_region": 1, "block": 1}, {"max_ranked": 1}])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_small_sets_and_low_thresholds(spark, knobs, threshold):
    """Sets that share a single word are found in regions of any size."""
    rnd = random.Random(11)
    rows = [(k, None, " ".join(rnd.choices(list("abcdefghij"), k=rnd.randint(0, 7)))) for k in range(120)] + [(500, "x", None), (501, "x y", None), (502, "x", "z")]
    members, pairs = setjoin.similar_sets(spark.createDataFrame(rows, SCHEMA), "record_id", ["subject", "body"], threshold, 1, **knobs)
    got = {(r["x"], r["y"]) for r in neardup.expand_pairs(members, pairs).collect()}
    assert got == brute(rows, threshold, 1)


def test_skewed_pivots_enter_the_recursion(spark):
    """A third of the records share their common words; regions are counted, not estimated."""
    rnd = random.Random(3)
    common = [f"c{k}" for k in range(12)]
    rows = [(k, None, " ".join(rnd.sample(common, 10) + [f"r{rnd.randint(0, 40)}" for _ in range(2)])) for k in range(150)]
    rows += [(1000 + k, None, " ".join(f"u{rnd.randint(0, 900)}" for _ in range(12))) for k in range(300)]
    members, pairs = setjoin.similar_sets(spark.createDataFrame(rows, SCHEMA), "record_id", ["body"], 0.6, 5, max_region=20, block=10)
    assert {(r["x"], r["y"]) for r in neardup.expand_pairs(members, pairs).collect()} == brute([(k, None, b) for k, _, b in rows], 0.6, 5)


def test_classes(spark):
    rows = corpus()
    got = {r["record_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), "record_id", ["subject", "body"], 0.7, 5).collect()}
    sets = {k: words(s, b) for k, s, b in rows if len(words(s, b)) >= 5}
    assert set(got) == set(sets)
    for k, (rep, links) in got.items():
        assert rep == min(j for j in sets if sets[j] == sets[k])
        near = {sets[j] for j in sets if sets[j] != sets[k] and len(sets[j] & sets[k]) >= 0.7 * len(sets[j] | sets[k]) - 1e-9}
        assert links == len(near)


def test_empty_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a", "b", 1, "f"), (1, None, None, 2, "g")], "record_id bigint, subject string, body string, id int, flags string")
    assert neardup.near_duplicate_pairs(df, "record_id", ["subject", "body"]).count() == 0
    assert neardup.near_duplicate_pairs(df.limit(0), "record_id", ["subject", "body"]).count() == 0
    assert neardup.near_duplicate_classes(df.limit(0), "record_id", ["subject", "body"]).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    df = spark.createDataFrame([(1, None, long), (2, None, long + " more"), (3, None, "x")], SCHEMA)
    assert [tuple(r) for r in neardup.near_duplicate_pairs(df, "record_id", ["subject", "body"]).collect()] == [(1, 2)]


def test_word_set_expression(spark):
    df = spark.createDataFrame(corpus(40), SCHEMA)
    for r in df.select("subject", "body", setjoin.word_set(F.col("subject"), F.col("body")).alias("w")).collect():
        assert set(r["w"]) == words(r["subject"], r["body"])


def test_overlap_between_splits(spark):
    rows = corpus()
    rnd = random.Random(2)
    names = ["train", " Training", "TRAIN", "val", "Dev ", "valid", "test", "TEST ", "other", None]
    splits = [(k, rnd.choice(names), rnd.randint(1, 2), f"2024-01-{rnd.randint(1, 28):02d}") for k, *_ in rows for _ in range(rnd.randint(0, 2))]
    emails = spark.createDataFrame([(*r, "enron") for r in rows], SCHEMA + ", source string")
    table = spark.createDataFrame(splits, "record_id bigint, split_name string, run_no int, d string").withColumn("assigned_at", F.to_timestamp("d")).drop("d")
    held = {}
    for k, name, run, day in splits:
        side = overlap.SPLIT_NAMES.get((name or "").strip().lower())
        if side:
            held[k] = max(held.get(k, ("", 0, "")), (day, run, side))
    got = {(r["record_a"], r["record_b"]) for r in overlap.cross_split_pairs(emails, table, 0.8, 5).collect()}
    want = {(a, b) for a, b in brute([(k, b) for k, _, b in rows if k in held], 0.8, 5) if (held[a][2] == "train") != (held[b][2] == "train")}
    assert got == want and want
    assert overlap.overlap_report(emails, table, 0.8, 5).agg(F.sum("pairs")).first()[0] == len(want)
    assert overlap.cross_split_pairs(emails.limit(0), table, 0.8, 5).count() == 0
    assert overlap.cross_split_pairs(emails, table.limit(0), 0.8, 5).count() == 0


def _candidates(rows):
    """Pairs of ``_region_pairs`` over rows (key, id, packed, signatures)."""
    rows = rows[:, np.lexsort((rows[2], rows[0]))]
    table = pa.table(dict(zip(["key", "id", "packed", *setjoin._SIGS], rows)))
    got = setjoin._region_pairs(0.7, False)(iter(table.to_batches(max_chunksize=10_000)))
    return {(a, b) for x in got for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}


@pytest.mark.parametrize("dense, tile", [(2, (3, 5)), (8, (64, 1024)), (10**9, (64, 1024))])
def test_tiles_and_steps_lose_no_pair(monkeypatch, dense, tile):
    monkeypatch.setattr(setjoin, "DENSE", dense)
    monkeypatch.setattr(setjoin, "TILE", tile)
    docs = {k: words(s, b) for k, s, b in corpus(300)}
    docs |= {9000: frozenset(f"l{k}" for k in range(16_000)), 9001: frozenset(f"l{k}" for k in range(20_000)), 9002: frozenset(f"l{k}" for k in range(9_000))}
    freq = {}
    for x in docs.values():
        for w in x:
            freq[w] = freq.get(w, 0) + 1
    hashes = setjoin.words.word_hash(sorted(freq)).view(np.int64)
    order = np.argsort(hashes)
    batch = pa.record_batch({"id": pa.array(list(docs), pa.int64()), "flags": pa.array([3] * len(docs), pa.int32()), "t0": [" ".join(sorted(x)) for x in docs.values()]})
    made = setjoin._replicas(["t0"], 0.7, 5, hashes[order], np.array([freq[w] for w in sorted(freq)])[order], np.empty(0, np.int64))(iter([batch]))
    rows = np.concatenate([np.stack([c.to_numpy() for c in x.columns]) for x in made], axis=1)
    want = brute([(k, " ".join(x)) for k, x in docs.items()], 0.7, 5)
    assert (9000, 9001) in want and want <= _candidates(rows)


def test_a_large_region_takes_little_time():
    """40,000 records whose first common word is their 11th to 13th: 800 million pairs in one region."""
    rnd = np.random.default_rng(1)
    m = 40_000
    n, pos, inside = rnd.integers(70, 80, m), rnd.integers(10, 13, m), 1
    sigs = rnd.integers(0, 2**63, (4, m)) & rnd.integers(0, 2**63, (4, m))
    sigs[:, 1], n[:2], pos[:2] = sigs[:, 0] ^ 1, 79, 10
    rows = np.stack([np.full(m, 7), np.arange(m), (n << 32) | (pos << 8) | (3 << 4) | (2 << 1) | inside, *sigs])
    began = time.process_time()
    assert _candidates(rows) == {(0, 1)}
    assert time.process_time() - began < 10


def test_regions_are_large_by_their_members(spark, monkeypatch):
    """A word in many records but in few windows doesn't make a large region."""
    rows = [(k, None, "c " + " ".join(f"r{k}x{j}" for j in range(20))) for k in range(60)] + [(100, None, "c d e f g"), (101, None, "c d e f g h")]
    rows += [(200 + k, None, "d e f g h") for k in range(40)]

    def never(*_):
        raise AssertionError("no region is large")

    monkeypatch.setattr(setjoin, "_recursive_replicas", never)
    members, pairs = setjoin.similar_sets(spark.createDataFrame(rows, SCHEMA), "record_id", ["body"], 0.7, 5, max_region=20)
    assert {(r["x"], r["y"]) for r in neardup.expand_pairs(members, pairs).collect()} == brute([(k, b) for k, _, b in rows], 0.7, 5)
