"""Problem 10: subject areas of documents.

Labelling functions vote on every (document, area): the lexicon (sentences whose
words belong to the area), the section (the heading names the area), the address
and the source (how often other documents of theirs are of the area), and the
sample of human labels.  A latent-variable model learns how accurate each of them
is by expectation maximisation over all pairs, those included that no sentence
names, and areas are assigned from the posterior.  The lexicon itself grows from
seed words and labels over all documents in a few rounds: a word belongs to an
area when most of the documents that hold it are of the area.

Texts are tokenised once, into a table of word hashes by sentence; the rounds
read that table and work on arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable
from . import words as words_

ROUNDS = 5
#: Labels of at most this many documents are used, those with the smallest hashes.
MAX_LABELLED = 100_000
#: Words in at least LEAST documents may enter the lexicon.
LEAST = 3
#: A lexicon of at most VOCABULARY words goes to every task as a whole; of a larger one each text gets its own words.
VOCABULARY = 200_000
#: Parts into which the texts that hold one word are split where the lexicon is joined.
SALTS = 16
#: Domains and sources up to SMALL go to every task; of more only those with 1/HOT_KEYS of the documents.
SMALL, HOT_KEYS = 500_000, 10_000
SHRINK = 3.0
SEED_WEIGHT = 12.0
#: Weight that a sentence needs to be of an area.
SENTENCE = 1.0
#: Words that a heading has at most.
HEADING = 10

#: What parts words, in the syntax of Arrow.
_BETWEEN = r"[^\p{L}\p{Nl}\p{No}]+"
WORDS = re.compile(r"[^\W\d_]{2,}")

# Seed words of the lexicon, by area and language.
SEEDS = {
    "education": "school teacher students pupils exam curriculum homework kindergarten diploma seminar lecture thesis campus enrolment tuition | hausaufgabe einschulung doktorarbeit prüfung vorlesung lehrplan abitur | leçon thèse rentrée bibliothèque épreuve devoirs | asignatura matrícula enseñanza graduación lección | educação redação lição matrícula vestibular | lekcję uczelnię magisterską świadectwo ćwiczenia | лекция школа диссертация контрольная сессия",
    "finance": "lenders investors treasurer dividend ledger overdraft liquidity audit treasury earnings brokers loan equity tax | liquidität dividende anleihe bilanz kreditlinie | créance trésorerie obligation rentabilité comptabilité | inversión tesorería auditoría deuda | dívida tesouraria tributação aplicação | obligację należność płynność księgowość pożyczka | ссуда облигация ликвидность прибыль отчётность",
    "health": "doctors physician nurse dosage prescription vaccine inhaler antibiotic migraine surgery | impfung pflegestation krankengymnastik untersuchung blutprobe | ordonnance vaccination rééducation opération sang | cirugía vacunación fisioterapia clínica receta médica | vacinação medicação reabilitação clínica | szczepionkę receptę kroplówkę przychodnię lekarską | аптека прививка терапия больница операция",
    "law": "judge counsel tribunal attorneys solicitor clause plaintiff statute injunction subpoena affidavit deposition court litigation | klage zeugenaussage satzung berufung anwältin | plainte jurisprudence avocate procédure médiation | demanda cláusula apelación jurisdicción abogacía | acusação petição audiência advocacia cláusula | ugodę apelację skargę ustawę świadków | апелляция присяга экспертиза жалоба статья закона",
    "property": "tenants landlord freehold viewings tenancy mortgage terraced housing buyer letting | kaution dachsanierung miete baugenehmigung wohnung | véranda copropriété toiture propriété location | azotea vivienda fianza | construção escritura locação varanda habitação | kaucję działkę łazienkę klatkę schodową księgę wieczystą | аренда квартира застройка терраса ипотека",
    "science": "researchers laboratory enzyme genome spectrometer neutron hypothesis catalyst telescope microscopy kelvin | hypothese laborprobe messreihe isotopenanalyse teleskopaufnahme | molécule expérience spectroscopie hypothèse mesure | molécula hipótesis medición investigación galaxia | medição hipótese espécie radiação equação | galaktykę hipotezę cząsteczkę próbkę pomiary | молекула гипотеза выборка лаборатория галактика",
    "shopping": "shoppers checkout catalogue discount warranty storefront refund jewellery headphones delivery | geschenkkarte winterjacke lieferung rabattaktion rückgabe | livraison remise étiquette boutique garantie | compra garantía etiqueta devolución tienda | compra devolução promoção coleção garantia | przesyłkę sukienkę reklamację zniżkę półkę sklepową | скидка покупка гарантия доставка витрина",
    "software": "developers compiler branch refactoring deployed cluster cache endpoint repository debugged heap | datenbank schnittstelle speicherlücke testabdeckung quellcodeprüfung | compilation régression interface version | compilación depuración versión programación | compilação depuração programação versão atualização | kompilację pamięć podręczną wersję gałąź kodu bazę danych | сборка отладка база данных ветка кода утечка памяти",
    "sport": "fans club coach supporters stadium goalkeeper midfielder league tournament penalty marathon scoreboard | staffel tabellenführung meisterschaft nachspielzeit torhüterin | finale pénalité gardienne classement | liga portería jugada clasificación carrera | goleira seleção competição prorrogação classificação | ligę drużynę bramkarkę sztafetę dogrywkę | лига команда победа тренировка эстафета",
    "travel": "travellers guests airport ferry cruise itinerary campsite hostel passport luggage layover | rundreise bordkarte hotelbuchung fähre zugfahrt | croisière traversée auberge réservation étape | travesía excursión maleta estación habitación | excursão viagem travessia recepção estação | podróż wycieczkę łódź przeprawę kwaterę | экскурсия поездка гостиница виза переправа",
}


def word_hash(words: pa.Array | list[str]) -> np.ndarray:
    return words_.word_hash(words).view(np.int64)


def seed_words(areas: dict[str, str]) -> dict[str, list[int]]:
    """Areas (by index) of each seed word; a word of several areas names none surely.

    Areas (name: what it is about) outside the list are seeded by their own description.
    """
    out: dict[str, list[int]] = {}
    for k, (area, about) in enumerate(areas.items()):
        for w in WORDS.findall(SEEDS.get(area, f"{area} {about or ''}").lower()):
            if k not in out.setdefault(w, []):
                out[w].append(k)
    return out


class Lexicon(NamedTuple):
    """Word hashes, ascending, with the area and weight of each."""

    words: np.ndarray
    areas: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(words, areas, weights) -> Lexicon:
        words, at = np.unique(np.asarray(words, np.int64), return_index=True)
        return Lexicon(words, np.asarray(areas, np.int64)[at], np.asarray(weights, float)[at])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Area (-1: none) and weight of each word."""
        if not len(self.words):
            return np.full(len(words), -1), np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        return np.where(hit, self.areas[at], -1), np.where(hit, self.weights[at], 0.0)


def _pack(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers of each row as bytes, which pass from Spark to Python as they are."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, ends, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0]) if data is not None and ends[-1] > ends[0] else np.empty(0, kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each document, packed, ``lens`` (distinct words of each sentence),
    ``words`` (their hashes, int64) and ``places`` (sentences of the document that
    hold the word), and ``head`` (whether the first sentence is short)."""
    for b in batches:
        n = b.num_rows
        lines = pc.split_pattern(pc.fill_null(b.column("text"), ""), "\n")
        doc_of_line = np.repeat(np.arange(n), lines.value_lengths().to_numpy(zero_copy_only=False))
        line, piece, distinct = words_.pieces(lines.flatten())
        # a sentence ends with its line, or with a mark before a blank
        ends = pc.match_substring_regex(distinct, "[.!?:]$").to_numpy(zero_copy_only=False)[piece] if len(distinct) else np.empty(0, bool)
        begins = np.ones(len(line), bool)
        begins[1:] = (line[1:] != line[:-1]) | ends[:-1]
        of = np.cumsum(begins) - 1
        doc_of = doc_of_line[line[begins]]
        *where, words = words_.words_of(distinct, _BETWEEN, 2)
        at, code = words_.spread(piece, *where)
        sent = of[at]
        size = max(1, len(words))
        said = np.bincount(sent, minlength=len(doc_of))
        key = words_.distinct(sent * size + code)
        sent, code = key // size, key % size
        doc = doc_of[sent]
        _, at, times = np.unique(doc * size + code, return_inverse=True, return_counts=True)
        full, lens = np.unique(sent, return_counts=True)
        per_doc = np.bincount(doc_of[full], minlength=n)
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]]) if n else np.empty(0, int)
        head = np.zeros(n, bool)
        some = per_doc > 0
        head[some] = said[full[first[some]]] <= HEADING
        in_doc = np.bincount(doc, minlength=n)
        new = [_pack(lens.astype(np.int32), per_doc), _pack(word_hash(words)[code], in_doc), _pack(times[at].astype(np.int32), in_doc), pa.array(head)]
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *new], names=[*names, "lens", "words", "places", "head"])


_TOKENS = "lens binary, words binary, places binary, head boolean"
_OWN = "array<struct<w: bigint, a: int, weight: double>>"


def _with_own(docs: DataFrame, lexicon: Lexicon | DataFrame) -> DataFrame:
    """``docs`` with the entries for each text if the lexicon is a table; else null."""
    if isinstance(lexicon, Lexicon):
        return docs.withColumn("own", F.lit(None).cast(_OWN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = _unpack(b.column("words"), np.int64)
            pairs = np.unique(np.stack([np.repeat(b.column("row_no").to_numpy(zero_copy_only=False), n), words], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 0] % SALTS, pa.int32()), pa.array(pairs[:, 1])], names=["row_no", "salt", "w"])

    wanted = docs.select("row_no", "words").mapInArrow(run, "row_no bigint, salt int, w bigint")
    spread = lexicon.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = wanted.join(spread, ["w", "salt"]).groupBy("row_no").agg(F.collect_list(F.struct("w", "a", "weight")).alias("own"))
    return docs.join(own, "row_no", "left")


class _Batch:
    """Sentences of a batch with the areas that their words give them."""

    def __init__(self, b: pa.RecordBatch, lexicon: Lexicon | None, k: int) -> None:
        if lexicon is None:
            own = b.column("own").flatten()
            lexicon = Lexicon.of(*[own.field(c).to_numpy(zero_copy_only=False) for c in ("w", "a", "weight")])
        size, per_doc = _unpack(b.column("lens"), np.int32)
        self.doc_of = np.repeat(np.arange(b.num_rows), per_doc)
        self.sent = np.repeat(np.arange(len(size)), size)
        coded = pa.array(_unpack(b.column("words"), np.int64)[0]).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.to_numpy(zero_copy_only=False)
        area, weight = lexicon.find(self.words)
        self.area, self.weight = area[self.code], weight[self.code]
        on = self.area >= 0
        score = np.bincount(self.sent[on] * k + self.area[on], self.weight[on], len(size) * k).reshape(-1, k)
        self.best = score.max(1) if len(size) else np.empty(0)
        self.of = np.where(self.best >= SENTENCE, score.argmax(1), -1) if len(size) else np.empty(0, int)
        on = self.of >= 0
        self.votes = np.bincount(self.doc_of[on] * k + self.of[on], minlength=b.num_rows * k).reshape(-1, k)
        self.heading = np.full(b.num_rows, -1)
        some = (per_doc > 0) & b.column("head").to_numpy(zero_copy_only=False).astype(bool)
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]]) if b.num_rows else np.empty(0, int)
        self.heading[some] = self.of[first[some]]


def _word_shares(lexicon: Lexicon | None, k: int):
    """mapInArrow function: words of a batch, documents that hold them, and the
    shares of the areas where they stand: those of the sentence if its other
    words give it an area, else those of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b, lexicon, k)
            labels = b.column("labels")
            marked = np.repeat(np.arange(b.num_rows), pc.fill_null(labels.value_lengths(), 0).to_numpy(zero_copy_only=False))
            share = np.where(x.votes >= 2, x.votes, 0).astype(float)
            given = labels.flatten().to_numpy(zero_copy_only=False)
            share[marked, given] += 1
            total = share.sum(1, keepdims=True)
            share = np.divide(share, total, out=np.zeros_like(share), where=total > 0)
            doc, of, n = x.doc_of[x.sent], x.of[x.sent], len(x.words)
            once = 1 / _unpack(b.column("places"), np.int32)[0]
            # a word must not vouch for itself
            rest = x.best[x.sent] - np.where(x.area == of, x.weight, 0.0)
            own = (of >= 0) & (rest >= SENTENCE)
            mass = np.bincount(x.code[own] * k + of[own], once[own], n * k).reshape(-1, k)
            other = ~own & (total[doc, 0] > 0)
            code, doc, part = x.code[other], doc[other], once[other]
            for j in range(k):
                mass[:, j] += np.bincount(code, share[doc, j] * part, n)
            columns = [pa.array(x.words), pa.array(np.bincount(x.code, once, n)), *[pa.array(mass[:, j]) for j in range(k)]]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "docs", *[f"c{j}" for j in range(k)]])

    return run


def _weights(sums: DataFrame, base: list[float], seeds: DataFrame) -> DataFrame:
    """Area and weight of the words that mostly stand in documents of one area."""
    k = len(base)
    known = sum((F.col(f"c{j}") for j in range(k)), F.lit(0.0))
    seeded = sums.join(F.broadcast(seeds), "w", "left").withColumn("rest", F.greatest(F.lit(0.0), F.col("docs") - known))
    # documents of no known area count as a mixture of all
    mass = [F.col(f"c{j}") + F.col("rest") * base[j] + F.coalesce(F.col("seed")[j], F.lit(0.0)) + SHRINK * base[j] for j in range(k)]
    shares = seeded.select("w", F.array(*mass).alias("mass")).withColumn("all", F.aggregate("mass", F.lit(0.0), lambda a, b: a + b))
    best = shares.select("w", (F.array_max("mass") / F.col("all")).alias("best"), (F.array_position("mass", F.array_max("mass")) - 1).cast("int").alias("a"))
    # no word is surer than the greatest weight, nor can the odds be infinite
    weight = F.least(F.log(F.col("best") / F.greatest(1 - F.col("best"), F.lit(1e-12))) + 0.2, F.lit(3.0))
    return best.where("best >= 0.5").select("w", "a", weight.alias("weight"))


def learn_lexicon(docs: DataFrame, areas: dict[str, str], rounds: int = ROUNDS, vocabulary: int = VOCABULARY) -> Lexicon | DataFrame:
    """Area and weight of the words that mostly stand in documents of one area.

    ``docs`` (lens, words, places, head, labels array<int>, row_no; from ``_tokenise``, durable).  Every round
    reads all documents, until the lexicon no longer changes.  With more than
    ``vocabulary`` words the lexicon stays a table (w, a, weight).
    """
    k = len(areas)
    spark = docs.sparkSession
    seeds = seed_words(areas)
    hashes = dict(zip(seeds, word_hash(list(seeds)).tolist()))
    given = spark.createDataFrame([(hashes[w], [SEED_WEIGHT / len(a) if j in a else 0.0 for j in range(k)]) for w, a in seeds.items()], "w bigint, seed array<double>")
    sure = {hashes[w]: a[0] for w, a in seeds.items() if len(a) == 1}
    lexicon: Lexicon | DataFrame = Lexicon.of(list(sure), list(sure.values()), [2.0] * len(sure))
    columns = [f"c{j}" for j in range(k)]
    schema = "w bigint, docs double, " + ", ".join(f"{c} double" for c in columns)
    for _ in range(rounds):
        whole = lexicon if isinstance(lexicon, Lexicon) else None
        found = _with_own(docs.select("row_no", "lens", "words", "places", "head", "labels"), lexicon).mapInArrow(_word_shares(whole, k), schema)
        sums = durable(found.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("docs", *columns)]), "word_shares").where(F.col("docs") > LEAST - 0.5)
        total = sums.agg(F.count(F.lit(1)), *[F.sum(c) for c in columns]).first()
        if not total[0]:
            break
        all_mass = sum(total[1:]) + k
        counted = {r["w"] for r in sums.where(F.col("w").isin(list(sure))).select("w").collect()}  # at most the seeds
        rest = spark.createDataFrame([(w, a, 2.0) for w, a in sure.items() if w not in counted], "w bigint, a int, weight double")
        words = _weights(sums, [(x + 1) / all_mass for x in total[1:]], given).unionByName(rest)
        head = words.limit(vocabulary + 1).toArrow()
        if head.num_rows > vocabulary:
            lexicon = durable(words, "lexicon")
            continue
        new = Lexicon.of(*[head[c].to_numpy() for c in ("w", "a", "weight")])
        same = whole is not None and np.array_equal(new.words, whole.words) and np.array_equal(new.areas, whole.areas) and np.allclose(new.weights, whole.weights, atol=1e-3)
        lexicon = new
        if same:
            break
    return lexicon


#: Labelling functions and the number of their votes.
LEX, HEAD, ADDRESS, ORIGIN, HUMAN = "lex", "head", "address", "origin", "human"
VOTES = {LEX: 4, HEAD: 3, ADDRESS: 4, ORIGIN: 4, HUMAN: 3}


def fit_votes(table: pd.DataFrame, rounds: int = 100) -> pd.Series:
    """Posterior of each row of a table of vote combinations (columns of VOTES, n).

    The functions are taken as independent given the truth; their accuracies and
    the prior are learned without knowing it.  All start from one guess, that
    areas named by two sentences hold; no accuracy is given.
    """
    n = table["n"].to_numpy(float)
    post = (table[LEX].to_numpy(int) >= 2).astype(float)
    for _ in range(rounds):
        held, rest = post * n, (1 - post) * n
        yes = np.full(len(table), np.log(held.sum() + 1))
        no = np.full(len(table), np.log(rest.sum() + 1))
        for f, votes in VOTES.items():
            v = table[f].to_numpy(int)
            for side, mass in ((yes, held), (no, rest)):
                share = np.bincount(v, mass, votes) + 1
                side += np.log(share / share.sum())[v]
        new = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        moved = np.abs(new - post).max(initial=0.0)
        post = new
        if moved < 1e-9:
            break
    return pd.Series(post, index=table.index)


def _levels(strong: np.ndarray, docs: np.ndarray, sums: np.ndarray, base: np.ndarray) -> np.ndarray:
    """How often other documents of a domain or source are of each area: hardly (0),
    as most (1), more often (2), mostly (3).  A document does not speak for itself."""
    rate = (sums - strong + 2 * base) / (docs - 1 + 2)[:, None]
    out = np.where(rate >= 0.5, 3, np.where(rate > 2 * base, 2, np.where(rate < 0.5 * base, 0, 1)))
    return np.where((docs > 1)[:, None], out, 1)


def _combinations(b: pa.RecordBatch, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document and area: the number of its combination of votes, and the sentences."""
    k, n = len(base), b.num_rows
    votes = _unpack(b.column("votes"), np.int32)[0].reshape(n, k)
    strong = (votes >= 2).astype(int)
    head = (b.column(HEAD).to_numpy(zero_copy_only=False)[:, None] == np.arange(k)).astype(int)
    labels = b.column("labels")
    human = np.where(labels.is_valid().to_numpy(zero_copy_only=False), 2, 0)[:, None].repeat(k, 1)
    human[np.repeat(np.arange(n), pc.fill_null(labels.value_lengths(), 0).to_numpy(zero_copy_only=False)), labels.flatten().to_numpy(zero_copy_only=False)] = 1
    of = {LEX: np.minimum(votes, 3), HEAD: np.where((head == 1) & (votes == 1), 2, head), HUMAN: human}  # a heading that no other sentence bears out is a vote of its own kind
    for f in (ADDRESS, ORIGIN):
        docs = pc.fill_null(b.column(f"n_{f}"), 0).to_numpy(zero_copy_only=False)
        sums = np.zeros((n, k), np.int64)
        sums[docs > 0] = b.column(f"s_{f}").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        of[f] = _levels(strong, docs, sums, base)
    code = np.zeros((n, k), np.int64)
    for f, size in VOTES.items():
        code = code * size + of[f]
    return code, votes


def _with_sizes(rows: DataFrame, sizes: DataFrame, f: str, total: int, small: int) -> DataFrame:
    """``rows`` with the counts ``n_f`` and ``s_f`` of their domain or source.

    More than ``small`` keys are joined by a shuffle, but keys of 1/``HOT_KEYS`` of the
    documents or more (at most HOT_KEYS) go to every task, and rows without a key are spread.
    """
    if sizes.count() <= small:
        return rows.join(F.broadcast(sizes), f, "left")
    n, s = f"n_{f}", f"s_{f}"
    hot = sizes.where(F.col(n) * HOT_KEYS >= total).select(f, F.col(n).alias("_n"), F.col(s).alias("_s"))
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("string"))
    keyed = rows.join(F.broadcast(hot), f, "left").withColumn("_key", F.when(F.col(f).isNull() | F.col("_n").isNotNull(), spread).otherwise(F.col(f)))
    found = keyed.join(sizes.withColumnRenamed(f, "_key"), "_key", "left")
    return found.withColumns({n: F.coalesce(n, "_n"), s: F.coalesce(s, "_s")}).drop("_key", "_n", "_s")


def subject_posteriors(docs: DataFrame, areas: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY, small: int = SMALL) -> DataFrame:
    """(doc_id, subject_area, votes, posterior) of every area that some labelling function names.

    Null, empty and blank texts and rows without a doc_id give no row; labels of
    unknown areas are left out.
    """
    rows = areas.where("subject_area is not null").groupBy("subject_area").agg(F.max("about") if "about" in areas.columns else F.lit("")).collect()  # the areas in use: a fixed, short list
    known_areas = {r[0]: r[1] for r in sorted(rows)}
    names, k = list(known_areas), len(known_areas)
    spark = docs.sparkSession
    if not k:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, subject_area string, votes int, posterior double")
    index = F.create_map(*[F.lit(x) for pair in zip(names, range(k)) for x in pair])
    marked = labels.where("doc_id is not null").select("doc_id", index[F.col("subject_area")].alias("a")).where("a is not null").distinct()
    human = marked.groupBy("doc_id").agg(F.sort_array(F.collect_set("a")).alias("labels")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    host = lambda c: F.lower(F.trim(c))
    texts = docs.select("doc_id", "text", host("sender_domain").alias(ADDRESS), host("source").alias(ORIGIN)).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\w"))
    known = texts.join(broadcast_if_small(durable(human, "labels")), "doc_id", "left").withColumn("row_no", F.monotonically_increasing_id())
    key = docs.schema["doc_id"].dataType.simpleString()
    kept = f"doc_id {key}, {ADDRESS} string, {ORIGIN} string, labels array<int>, row_no bigint"
    known = durable(known.select("doc_id", ADDRESS, ORIGIN, "labels", "row_no", "text").mapInArrow(_tokenise, f"{kept}, {_TOKENS}"), "tokens")
    lexicon = learn_lexicon(known, known_areas, rounds, vocabulary)
    whole = lexicon if isinstance(lexicon, Lexicon) else None

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b, whole, k)
            strong = (x.votes >= 2).astype(np.int32)
            flags = [pa.array(strong[:, j]) for j in range(k)]
            packed = _pack(x.votes.astype(np.int32).ravel(), np.full(b.num_rows, k))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", ADDRESS, ORIGIN, "labels")], packed, pa.array(x.heading, pa.int32()), *flags], names=["doc_id", ADDRESS, ORIGIN, "labels", "votes", HEAD, *areas_of])

    areas_of = [f"strong{j}" for j in range(k)]
    schema = f"doc_id {key}, {ADDRESS} string, {ORIGIN} string, labels array<int>, votes binary, {HEAD} int, " + ", ".join(f"{c} int" for c in areas_of)
    cast = durable(_with_own(known, lexicon).mapInArrow(vote, schema), "votes")
    strong = [F.sum(c) for c in areas_of]
    total, *sums = cast.agg(F.count(F.lit(1)), *strong).first()
    base = (np.array([x or 0 for x in sums]) + 1) / (total + 2)
    rows = cast.drop(*areas_of)
    for f in (ADDRESS, ORIGIN):
        sizes = durable(cast.where(F.col(f).isNotNull()).groupBy(f).agg(F.count(F.lit(1)).alias(f"n_{f}"), F.array(*strong).alias(f"s_{f}")), f)
        rows = _with_sizes(rows, sizes, f, total, small)
    rows = rows.select("doc_id", "labels", "votes", HEAD, *[f"{x}_{f}" for f in (ADDRESS, ORIGIN) for x in "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(math.prod(VOTES.values()), np.int64)
        for b in batches:
            got += np.bincount(_combinations(b, base)[0].ravel(), minlength=len(got))
        seen = np.nonzero(got)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(got[seen])], names=["code", "n"])

    table = rows.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most 4*3*4*4*3 combinations
    rest = table["code"].to_numpy(np.int64)
    for f, size in reversed(VOTES.items()):
        table[f], rest = rest % size, rest // size
    posterior = np.zeros(math.prod(VOTES.values()))
    posterior[table["code"].to_numpy(np.int64)] = fit_votes(table).to_numpy()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, votes = _combinations(b, base)
            doc, a = np.nonzero((votes > 0) | (posterior[code] >= 0.5))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(a, pa.int32()), pa.array(votes[doc, a]), pa.array(posterior[code[doc, a]])], names=["doc_id", "a", "votes", "posterior"])

    area = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("a") + 1)
    return rows.mapInArrow(assign, f"doc_id {key}, a int, votes int, posterior double").select("doc_id", area.alias("subject_area"), "votes", "posterior")


def document_areas(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject_area) of each area that a document is about."""
    return subject_posteriors(docs, areas, labels).where("posterior >= 0.5").select("doc_id", "subject_area")


def area_shares(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each area and their share of all documents with text."""
    found = document_areas(docs, areas, labels).groupBy("subject_area").agg(F.count(F.lit(1)).alias("documents"))
    total = max(1, docs.where(F.col("text").rlike(r"(?U)\w")).count())
    every = areas.select("subject_area").where("subject_area is not null").distinct()
    return every.join(F.broadcast(found), "subject_area", "left").select("subject_area", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.round(F.coalesce("documents", F.lit(0)) / total, 6).alias("share"))
