import random
from pathlib import Path

import pytest

from mailquarry.llm import packing, subjects, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no vocabularies")


@pytest.fixture(scope="module", params=sorted(tokens.BYTE_LEVEL))
def pair(request):
    import tiktoken

    t = tokens.transducer(request.param)
    return t, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=t.ranks, special_tokens={})


def test_equals_the_public_encoder(pair):
    t, public = pair
    rnd = random.Random(4)
    atoms = ["a", "b", "the", "ing", " ", "  ", "\n", "1", "2024", "é", "ж", "😀", "'s", "=-", "zq", "\t", "ß", "漢字", "\x00"]
    for _ in range(1500):
        text = "".join(rnd.choices(atoms, k=rnd.randint(0, 50)))
        assert t.encode(text) == public.encode_ordinary(text)
        assert t.decode(t.encode(text)) == text


@pytest.mark.parametrize("word", ["a" * 20_001, "ab" * 9_000, "=" * 7_000, " " * 5_000, "e" * 3001 + "r" * 2001, "".join(random.Random(1).choices("abcdefghij", k=30_000)), "ß" * 4000])
def test_long_words_stream(pair, word):
    t, public = pair
    assert t.encode(word) == public.encode_ordinary(word)


@pytest.mark.parametrize("word", [b"abcde", b"a", b"=-", b" ", b"aab", bytes(random.Random(2).choices(b"aeirnt", k=997)), "\u00df\u20ac".encode()])
def test_memory_is_bounded(pair, word):
    t, public = pair
    held, real = [], t._path
    try:
        t._path = lambda last, end: (held.append(end), real(last, end))[1]
        got = list(t.stream(word * 20 for _ in range(120_000 // len(word) // 20)))
    finally:
        del t._path
    assert max(held) <= t.limit == t.lookahead + t.longest + tokens.CHUNK and t.lookahead < 400
    assert b"".join(t.bytes_of[i] for i in got) == word * (120_000 // len(word) // 20 * 20)


def test_the_lookahead_suffices():
    """No longer text changes a token that ends further before the end than the lookahead."""
    lists = 0
    for seed in range(300):
        rnd = random.Random(seed)
        letters = b"abc"[: rnd.randint(1, 3)]
        made = [letters[k : k + 1] for k in range(len(letters))]
        ranks = {x: k for k, x in enumerate(made)}
        for _ in range(rnd.randint(1, 25)):
            x = rnd.choice(made) + rnd.choice(made)
            if x not in ranks and len(x) <= 12:
                ranks[x] = len(ranks)
                made.append(x)
        try:
            least = tokens.sufficient_lookahead(ranks)
        except ValueError:
            continue
        lists += 1
        for _ in range(30):
            text, more = (bytes(rnd.choices(letters, k=rnd.randint(1, n))) for n in (60, 30))
            stable, used = [], 0
            for token in tokens.merged(text, ranks):
                used += len(token)
                if used <= len(text) - least:
                    stable.append(token)
            assert tokens.merged(text + more, ranks)[: len(stable)] == stable
    assert lists > 100


def test_defined_ids(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world")], "doc_id bigint, text string")
    for name in [*tokens.BYTE_LEVEL, *tokens.OTHERS]:
        got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df, name).collect()}
        assert got[1] == got[2] == [] and got[3]
    assert tokens.encode_texts(df.limit(0)).count() == 0
    back = tokens.decode_ids(tokens.encode_texts(df)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "", 2: "", 3: "hello world"}


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 2048])
    histogram = {}
    for _ in range(rnd.randint(0, 600)):
        s = min(capacity, max(1, int(rnd.lognormvariate(3, 1.2)))) if seed % 2 else rnd.randint(1, capacity)
        histogram[s] = histogram.get(s, 0) + rnd.randint(1, 5)
    places, bins = packing.plan(histogram, capacity)
    used, seen = [0] * bins, {}
    for size, low, number, first in places:
        assert low == seen.get(size, 0)
        seen[size] = low + number
        for k in range(number):
            used[first + k] += size
    assert seen == histogram and all(0 < u <= capacity for u in used)
    # first fit decreasing as a yardstick
    bound = sum(s * n for s, n in histogram.items()) / capacity
    naive: list[int] = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((k for k, room in enumerate(naive) if room >= s), None)
        if at is None:
            naive.append(capacity - s)
        else:
            naive[at] -= s
    assert bound - 1e-9 <= bins <= len(naive) * 1.02 + 1


def test_pack(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join(["word"] * rnd.choice([1, 3, 9, 20, 45]))) for k in range(300)] + [(1000, None), (1001, ""), (1002, " ".join(["word"] * 1000))]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=50).cache()
    got = packed.collect()
    whole = {}
    for r in got:
        whole[r["container"]] = whole.get(r["container"], 0) + r["size"]
    assert max(whole.values()) <= 50
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}
    assert sum(r["size"] for r in got if r["doc_id"] == 1002) == 1000 and [r[0] for r in packing.splittable(packed).collect()] == [1002]
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert packing.fill_report(packing.pack(spark.createDataFrame([(1, None)], "doc_id bigint, text string"))).first()["containers"] == 0


def test_subjects(spark):
    rnd = random.Random(7)
    nouns = {"law": ["tribunal", "statute", "barrister"], "sport": ["goalkeeper", "stadium", "striker"], "travel": ["ferry", "campsite", "cruise"], "health": ["nurse", "dosage", "syringe"], "finance": ["ledger", "overdraft", "bond"]}
    rows, truth = [], {}
    for k in range(400):
        mine = rnd.sample(sorted(nouns), rnd.choice([0, 1, 1, 2]))
        text = [f"The {rnd.choice(nouns[a])} met the {rnd.choice(nouns[a])} on day {rnd.randint(1, 9)}." for a in mine for _ in range(3)]
        if len(mine) == 1 and rnd.random() < 0.3:
            other = rnd.choice(sorted(set(nouns) - set(mine)))
            text.append(f"Somebody mentioned a {rnd.choice(nouns[other])} once.")
        text += ["Nobody opened the lamp since June." for _ in range(rnd.randint(1, 4))]
        rnd.shuffle(text)
        rows.append((k, " ".join(text), rnd.choice(["a.test", "b.test", None]), rnd.choice(["x", None])))
        truth[k] = set(mine)
    rows += [(900, None, None, None), (901, "", "a.test", "x"), (902, " ", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sender_domain string, source string")
    areas = spark.createDataFrame([*[(a, None) for a in nouns], (None, None)], "subject_area string, about string")
    labels = spark.createDataFrame([(k, a, None) for k in range(0, 400, 5) for a in truth[k]] + [(None, "law", None), (3, "unknown", None)], "doc_id bigint, subject_area string, labelled_by string")
    got = {}
    for r in subjects.document_areas(docs, areas, labels).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_area"])
    right = sum(got.get(k, set()) == v for k, v in truth.items())
    assert right / len(truth) >= 0.95
    assert subjects.document_areas(docs.limit(0), areas, labels).count() == 0
    assert subjects.document_areas(docs, areas, labels.limit(0)).count() > 0
    assert subjects.area_shares(docs, areas, labels).count() == 5
