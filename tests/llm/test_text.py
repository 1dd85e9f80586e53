import random

import duckdb
import pytest

from mailquarry.llm import authored, mojibake, pii

EMPTY_BODIES = [(1, None, None, None), (2, "", "", ""), (3, " ", "\n \n", " ")]
MAIL = "record_id bigint, subject string, body string, sender string"
SEEDED = {k: (" " + v + " ").encode() for k, v in mojibake.SEEDS.items()}
TEXTS = {
    "fr": "Nous avons déjà reçu un numéro très régulièrement à côté",
    "de": "Für müssen wir später Größe und natürlich Grüße geprüft",
    "es": "También mañana está allí después el año español",
    "pt": "Não é possível amanhã, número e ação também já",
    "pl": "Będzie już także później właśnie według ktoś dziś",
    "ru": "Сегодня почти снова отправит сведения коллеги обсудили",
    "en": "The café — “naïve” façade’s price is €5 and £3",
}


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "cp850", "cp437", "mac_roman"])
@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_restores_what_was_read_wrongly(codec, lang):
    text = TEXTS[lang]
    try:
        garbled = text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        pytest.skip("bytes that the encoding leaves undefined")
    restored, chains = mojibake.Restorer(SEEDED).restore(f"Plain words. {garbled} More.")
    assert chains and restored == f"Plain words. {text} More."


def test_twice_and_single_bytes():
    r = mojibake.Restorer(SEEDED)
    for text, codecs in ((TEXTS["fr"], ("latin-1", "latin-1")),):
        garbled = text
        for c in codecs:
            garbled = garbled.encode("utf-8").decode(c)
        assert r.restore(garbled)[0] == text
    assert r.restore(TEXTS["ru"].encode("cp1251").decode("cp1252"))[0] == TEXTS["ru"]
    assert r.restore(TEXTS["pl"].encode("cp1250").decode("cp1252"))[1]


@pytest.mark.parametrize("lang", sorted(TEXTS))
def test_leaves_good_text(lang):
    r = mojibake.Restorer(SEEDED)
    for text in (TEXTS[lang], TEXTS[lang].upper(), "Søndergård, Dvořák & Müller’s ½ – «да»"):
        assert r.restore(text) == (text, [])


def test_garbled_fields(spark):
    rows = [*EMPTY_BODIES, (4, "CafÃ©", "fine", None), (5, "ok", "lost � text", None), (6, "ok", "é" * 200_000, None)]
    docs = spark.createDataFrame([(1, "Der Text für alle", "DE"), (2, None, None)], "doc_id bigint, text string, lang string")
    got = {(r["record_id"], r["field_name"]): r["restored"] for r in mojibake.garbled_fields(spark.createDataFrame(rows, MAIL), docs).collect()}
    assert got == {(4, "subject"): "Café", (5, "body"): None}
    assert mojibake.garbled_fields(spark.createDataFrame([], MAIL), docs.limit(0)).count() == 0


def test_dictionaries_count_all_documents(spark):
    often, rare = ([f"{x}{''.join('abcdefghij'[int(c)] for c in f'{k:03}')}größe" for k in range(200)] for x in "xy")
    # of 1,600 documents, 11 or 12 hold each of the first words, 2 each of the others
    rows = [(k, f"Hier {often[k % 144]}, und 7 {rare[k % 200] if k < 400 else 'Wört'}.", "DE ") for k in range(1600)]
    rows += [(k, "für Привет", "ru") for k in (1900, 1901)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    made = mojibake.language_dictionaries(docs)
    de = made["de"].decode().split()
    assert set(de) & {*often, *rare} == set(often[:144])
    assert de.index("Wört") > max(de.index(w) for w in often[:144])  # frequent ones last
    assert "Привет" in made["ru"].decode().split() and "für" not in made["ru"].decode().split()
    small = mojibake.language_dictionaries(docs, size=600)["de"]
    assert len(small) <= 602 and "Hier" in small.decode().split()


BODY = """Hi Ann,

Please send the report.
> 40 percent is what it needs, by my reading.
-- see item 3 above.

Best regards,
--
Bo Nilsen
Head of Sales, Acme
+44 7700 900123

On 3 May 2024, Cy Dune <cy@d.example> wrote:
> old text
> more

The contents of this email are confidential and remain the property of Acme."""


def test_new_lines():
    assert authored.unauthored_lines(BODY) == [7, 8, 9, 10, 11, 13, 14, 15, 17]


def test_forwarded_and_interleaved():
    forwarded = "FYI\n\n-----Original Message-----\nFrom: A B <a@b.test>\nSent: Monday, 1 Jan 2024\nSubject: x\n\nOld words here without marks.\nCheers,\nA"
    assert authored.unauthored_lines(forwarded) == [3, 4, 5, 6, 8, 9, 10]
    assert authored.unauthored_lines("Am 1. Mai 2024 schrieb B <b@c.test>:\n> alt\n\nNeue Antwort hier.\n> noch alt\nUnd mehr Text dazu.") == [1, 2, 5]
    assert authored.unauthored_lines("just one line") == authored.unauthored_lines("") == []


def test_authored_text(spark):
    df = spark.createDataFrame([*EMPTY_BODIES, (4, None, BODY, None), (5, None, "a\n" * 20_000, None)], MAIL)
    got = {r["record_id"]: r["authored"] for r in authored.authored_text(df).collect()}
    assert got[1] is None and got[2] == "" and got[3] == "" and got[4].startswith("Hi Ann") and got[4].endswith("item 3 above.")
    assert authored.line_segments(df.where("record_id < 4")).count() == 0
    assert authored.line_segments(df.limit(0)).count() == 0


LEX = pii.Lexicons(frozenset({"ann", "bo"}), frozenset({"nilsen", "dune"}), frozenset({"street"}), frozenset({"99999 999999", "+99 9999 999999", "999-999-9999"}), frozenset({"999-99-9999", "AA999999A"}))


def found(text):
    return [(m.kind, text[m.start : m.end]) for m in pii.Finder(LEX).find(text)]


def test_mentions():
    text = "Ann B. Nilsen <ann@a.example>, Dune, Bo or B. Dune; bo [at] b [dot] test. Call 01632 960460 ext. 5 or +44 7700 900123. SSN 901-22-3456, NINO QQ123456C. Flat 2, 14 Mill Pond Lane, Ashby. Part 1234-56, Ann left."
    assert found(text) == [
        ("name", "Ann B. Nilsen"), ("email", "ann@a.example"), ("name", "Dune, Bo"), ("name", "B. Dune"), ("email", "bo [at] b [dot] test"),
        ("phone", "01632 960460 ext. 5"), ("phone", "+44 7700 900123"), ("id_number", "901-22-3456"), ("id_number", "QQ123456C"), ("address", "Flat 2, 14 Mill Pond Lane, Ashby"),
    ]
    assert pii.Finder(LEX).redact("Hi Ann Nilsen, write to a@b.test!") == "Hi <NAME>, write to <EMAIL>!"


def test_learning_and_edges(spark):
    rnd = random.Random(3)
    given, family = ["Ann", "Bo", "Cy", "Dee", "Eva", "Finn"], ["Nilsen", "Dunelm", "Oakley", "Petrov", "Quine"]
    rows = []
    for k in range(300):
        g, f = rnd.choice(given), rnd.choice(family)
        body = f"My colleague {rnd.choice(given)} {rnd.choice(family)} packed it. Call 07700 900{rnd.randint(100, 999)} today. For the file: passport ZZ{rnd.randint(1000000, 9999999)}. Tracking code 1234-5678-{rnd.randint(1000, 9999)}."
        rows.append((k, None, body, f"{g} {f} <{g.lower()}.{f.lower()}@x.example>"))
    rows += [(900 + r[0], *r[1:]) for r in EMPTY_BODIES] + [(990, None, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, MAIL)
    lex = pii.learn(df)
    assert {g.lower() for g in given} <= lex.given and "99999 999999" in lex.phone and "AA9999999" in lex.id_number
    got = pii.mentions(df, lexicons=lex).where("record_id = 0").collect()
    assert {r["pii_kind"] for r in got} == {"name", "email", "phone", "id_number"} and all("1234-5678" not in r["pii_text"] for r in got)
    empty = df.limit(0)
    assert pii.mentions(empty).count() == 0 and pii.redacted(empty).count() == 0


def test_queries_have_the_stated_columns(spark, tables):
    from mailquarry.llm import catalogue

    want = {
        "p1_found": "record_a bigint, record_b bigint", "p2_found": "record_id bigint, field_name string, pii_kind string, pii_text string", "p3_found": "record_a bigint, record_b bigint",
        "p4_found": "record_id bigint, line_no int", "p5_found": "record_id bigint, field_name string", "p6_found": "domain_a string, domain_b string",
        "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint", "p10_found": "doc_id bigint, subject_area string",
    }
    for name, query in catalogue.queries().items():
        df = query(spark, tables)
        if name in want:
            assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == want[name]
        assert df.count() >= 0
    said = catalogue.oracle_sql()
    con = duckdb.connect()
    for t in ("emails", "documents", "domain_aliases", "email_splits"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    for name, sql in said.items():
        assert len(con.execute(sql).fetchall()) == catalogue.queries()[name](spark, tables).count()


def test_a_message_stored_often_strikes_no_name(spark):
    given, family = ["Ann", "Bo", "Cy", "Dee", "Eva", "Finn"], ["Nilsen", "Dunelm", "Oakley", "Petrov", "Quine"]
    rows = [(k, None, f"My colleague {given[k % 6]} {family[k % 5]} packed box {k}.", f"{given[k % 6]} {family[k % 5]} <{given[k % 6]}.{family[k % 5]}@x.example>".lower().title()) for k in range(120)]
    rows += [(1000 + k, None, "My colleague Ann Nilsen and my colleague Gil Petrov sent it.", None) for k in range(60)]
    # one writer with one name, who signs every message
    rows += [(2000 + k, None, f"Box {k} is here. My colleague Zorah Quill knows.", "Zorah Quill <zorah.quill@x.example>") for k in range(40)]
    # seen in one message only, but often: no phrase either
    rows += [(3000 + k, None, f"My colleague Gil {f} packed it.", None) for k, f in enumerate(family)]
    lex = pii.learn(spark.createDataFrame(rows, MAIL))
    assert {"ann", "zorah", "gil"} <= lex.given and {"nilsen", "quill", "petrov"} <= lex.family and not {"nilsen", "quill"} & lex.not_family


def test_lexicons_keep_what_is_rare(spark):
    given = ["Ann", "Bo", "Cy", "Dee", "Eva", "Finn"]
    rows = [(k, None, f"My colleague {given[k % 6]} Nilsen{'abcdefghij'[k % 10]} packed box {k}. Call 07700 900{100 + k} today.", f"{given[k % 6]} Nilsen <{given[k % 6].lower()}.nilsen@x.example>") for k in range(240)]
    rows += [(900, None, "My colleague Zorah Quillon packed it. Call 0911-22-33-4455 today.", "Zorah Quillon <zorah.quillon@x.example>"), (901, None, "bo quillon left, Zorah Marsh-Hill stays.", None)]
    df = spark.createDataFrame(rows, MAIL)
    lex = pii.learn(df, lexicon=60)  # far fewer than the sightings, more than the entries
    assert "zorah" in lex.given and "quillon" in lex.family and "9999-99-99-9999" in lex.phone
    # beyond the bound the same comes from the joined table
    table = pii.learn(df, lexicon=5)
    want, got = (sorted(map(tuple, pii.mentions(df, lexicons=x).collect())) for x in (lex, table))
    assert got == want and (901, "body", "name", "bo quillon") in got and (900, "body", "phone", "0911-22-33-4455") in got
    want, got = (sorted(map(tuple, pii.redacted(df, lexicons=x).collect())) for x in (lex, table))
    assert got == want


def test_hot_nodes_of_the_graph_are_split_with_the_same_scores(spark):
    rnd = random.Random(4)
    rows = {("name", rnd.choice("^$abcdef"), f"w{rnd.randint(0, 30)}"): rnd.randint(1, 5) for _ in range(200)}
    edges = spark.createDataFrame([(*k, n) for k, n in rows.items()], "graph string, pattern string, instance string, n bigint")
    fixed = "a double, b double"
    of_i = spark.createDataFrame([("name", "w1", 1.0, None), ("name", "w2", 0.0, 1.0)], f"graph string, instance string, {fixed}")
    of_p = spark.createDataFrame([("name", "b", None, 1.0)], f"graph string, pattern string, {fixed}")
    plain, split = ({(r["instance"]): (round(r["a"], 9), round(r["b"], 9)) for r in pii.propagate(edges, of_i, of_p, 3, hot).collect()} for hot in (10**6, 2))
    assert plain == split and plain["w1"][0] == 1.0 and len(plain) == len({k[2] for k in rows})


def test_borders_of_identifiers():
    lex = pii.Lexicons(frozenset(["ann", "i̇lkay"]), frozenset(["nilsen", "x" * 90]), frozenset(), frozenset(), frozenset())
    finder = pii.Finder(lex)
    found = lambda t: [(m.kind, t[m.start : m.end]) for m in finder.find(t)]
    for mark in '?:"!\t/':
        assert found(f"at 12 Oak St{mark}") == [("address", "12 Oak St")]
    assert found("İ said ANN NILSEN") == [("name", "ANN NILSEN")]
    long = "x" * 90
    assert found(f"{long.capitalize()}, Ann") == [("name", f"{long.capitalize()}, Ann")]
    local = "a" * 400
    assert found(f"to {local}@host.test now") == [("email", f"{local}@host.test")]


@pytest.mark.parametrize("clauses", [3, 12, 30, 200])
def test_a_notice_of_any_length_is_one(clauses):
    lines = ["Dear Ann,", "", "the plan is fine with me.", "We meet on Monday.", "", "Best regards", "Bo Dune", "", "CONFIDENTIALITY NOTICE"]
    lines += [f"clause number {k} of this text binds the reader to the terms that follow below" for k in range(clauses)]
    got = authored.unauthored_lines("\n".join(lines))
    assert got == [6, 7, *range(9, 10 + clauses)]


FOLDED = {
    "Danke für alles. Das Angebot gilt noch. Mit freundlichen Grüßen Jonas Zebaro Programme Lead | Fenulum Holdings Mobile: 237-555-0172 Flat 4, 13 Mill Pond Terrace, Fenhaven": "Danke für alles. Das Angebot gilt noch.",
    "We met today and all is fine. Best regards, Greta Undberg Programme Lead, Marvalis Insurance": "We met today and all is fine.",
    "Ok for me. On Mon, 3 Jan 2024, Ann Nilsen <a@b.test> wrote: > can we meet? > Ann": "Ok for me.",
    "Thanks a lot. See you. -----Original Message----- From: Ann Sent: Monday To: Bo Subject: x Can we meet? Ann": "Thanks a lot. See you.",
    "In version 4.6 all is well. On Thursday the group wrote: no badge before June. Regards to everyone in Fenham, and please read on.": None,
}


@pytest.mark.parametrize("body", FOLDED)
def test_collapsed_bodies_are_decoded_too(body):
    assert authored.new_text(body) == (FOLDED[body] or body) and "".join(authored.unfold(body)) == body


OTHERS = ["I like 😀 it", "ελληνικά γράμματα εδώ", "a → b ⇒ c ✓", "Çalışma başka gün için şu değil", "日本語 の テキスト", "שלום עולם", "Её Лёд ёж Пёс"]


@pytest.mark.parametrize("text", OTHERS)
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251"])
def test_signs_and_scripts_outside_the_dictionaries(text, codec):
    def read(b):
        try:
            return bytes([b]).decode(codec)
        except UnicodeDecodeError:
            return chr(b)

    restorer = mojibake.Restorer(SEEDED)
    assert restorer.restore("".join(map(read, text.encode())))[0] == text
    assert restorer.restore(text) == (text, [])
