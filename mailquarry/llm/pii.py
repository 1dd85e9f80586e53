"""Problem 2: personal information inside free text.

Bootstrapped contextual extraction.  Two kinds of instances are learned from
the corpus itself: given names, and the shapes of numbers (digits and letters
masked).  Seeds are sender headers whose address agrees with the display name,
and numbers beside unmistakable words.  Seeds induce lexical patterns (the words
before and after); Spark scores patterns by their instances and instances by
their patterns for a few rounds; what ends above the threshold finds identifiers
that no seed names.  Addresses of mailboxes and of streets have a form of their
own and are found by it.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable

ROUNDS = 3
ACCEPT = 0.5
#: Lexicons of at most LEXICON entries go to every task as a whole; of larger ones each text gets its own entries.
LEXICON = 200_000
#: Nodes of the graph with more than HOT edges are split over SALTS parts where they are joined.
HOT, SALTS = 100_000, 16
KINDS = ("email", "phone", "id_number", "address", "name")

_U = "[A-ZÀ-ÖØ-ÞĀĄĆČĎĐĒĘĚĞĢĪİĶŁĽŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽА-ЯЁ]"
_W = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
WORD = re.compile(_W)
PAIR = re.compile(rf"(?<![\w’'\-])({_U}[^\W\d_]*(?:[’'\-][^\W\d_]+)*) (?:{_U}\. )?({_U}[^\W\d_]+(?:[’'\-][^\W\d_]+)*)")
TURNED = re.compile(rf"(?<![\w’'\-])({_U}[^\W\d_]+(?:[’'\-][^\W\d_]+)*), ({_U}[^\W\d_]+)(?![\w’'\-])")
_AT = r"(?:@| ?[\[({] ?at ?[\])}] ?)"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?)"
EMAIL = re.compile(rf"(?<![\w.+%\-])[\w+%\-][\w.+%\-]*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
NUMBER = re.compile(r"(?<![\w#/.@€£$\-])(?:\+?\(?\d[\d ()./\-]{4,24}\d(?:-?[A-Z])?|[A-Z]{1,3}-?\d[\d\-]{3,14}\d[A-Z]?|[A-Z]{2} \d{2}(?: \d{2,4}){1,4}(?: ?[A-Z])?)(?![\w@])")
EXTENSION = re.compile(r" ?(?:ext\.?|extension|x|durchwahl|poste|доб\.?) ?\d{1,5}", re.I)

# Words that name a street, by which street addresses are known.
STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Drive|Dr|Boulevard|Blvd|Terrace|Close|Place|Pl|Way|Square|Sq|Crescent|Cres|Grove|Gardens|Mews|Row|Hill|Walk|Parade|Highway|Hwy|Parkway|Pkwy|Circle|Alley"
_P = rf"{_U}[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_TAIL = rf"(?:,? (?:Apt|Apartment|Flat|Unit|Suite|Ste|Floor|No)\.? ?\w+)?(?:, {_P}(?: {_P}){{0,2}}(?=[,. \n;)]|$)(?:,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? ?\d[A-Z]{{2}})?(?:,? [A-Z]{{2}} \d{{5}})?)?"
ADDRESS = re.compile(
    rf"(?<![\w])(?:(?:(?:Flat|Apt|Apartment|Unit|Suite) \w+, ?)?\d{{1,5}}[A-Za-z]? (?:[NSEW]\. )?(?:{_P} ){{1,3}}(?:{STREETS})\b{_TAIL}"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai) (?:des |du |de la |de l’|de |d’)?{_P}(?:, \d{{5}} {_P})?"
    rf"|(?:{_U}[^\W\d_]+(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer)|{_P} (?:Straße|Weg|Platz|Allee)) \d{{1,4}} ?[a-z]?(?:, \d{{5}} {_P})?"
    rf"|(?:Calle|Avenida|Plaza|Rua|Praça|Travessa|ul\.|al\.|ул\.|пр\.) (?:de la |de los |del |de |da |do |dos )?{_P}(?: {_P})?,? \d{{1,4}}[a-z]?(?:, (?:\d{{2}}-\d{{3}}|\d{{5}}(?:-\d{{3}})?) {_P})?)"
)
# Words beside which a number is what they say; the seeds of the patterns.
ID_WORDS = re.compile(r"\b(?:passport|passeport|reisepass|ssn|social security|tax id|steuer-id|nino?|national insurance|driving licen[cs]e|licen[cs]e|identity card|identity number|personal (?:no|number)|dni|nie|pesel|travel document|personalausweis)\b", re.I)
PHONE_WORDS = re.compile(r"\b(?:call|phone|tel|telephone|mobile|fax|telefon|téléphone|teléfono|тел)\b", re.I)
OTHER_WORDS = re.compile(r"\b(?:tracking|ticket|part number|build|server|order|invoice|case|company no|po|device|profile|code|version|room|expediente|processo|dossier|vorgang|nummer|nr|номер|dated|date|sent|on|am|le|el|em|dniu)\b", re.I)


_AFTER = re.compile(rf" (?:[^\W\d_]\. )?({_W})")
_ENDING = re.compile(rf"(?<![\w’'\-]){_W}$")
_INITIAL_AFTER = re.compile(r" [A-Z]\.(?=\s|$)")
_INITIAL = re.compile(rf"(?<![\w.’'])[^\W\d_]\. ({_W})")


def _joined(text: str, at: int, step: int) -> bool:
    """Whether the character at ``at`` makes a longer word of the one beside it."""
    c = text[at]
    if c.isalnum() or c == "_":
        return True
    return c in "’'-" and 0 <= at + step < len(text) and text[at + step].isalpha()


#: What may follow a word: the blanks and marks at which short street words end.
_MARKS = " \t\n\r\v\f\0\u00a0\u2028\u2029" + "".join(c for c in string.punctuation if c != "_") + "“”„‘’‚«»‹›…–—·•"


def _address_cues() -> list[str]:
    """Texts without which no street address can stand in a text."""
    words = STREETS.split("|")
    short = [f" {w}{mark}" for w in words if len(w) < 4 for mark in _MARKS]
    french = ["rue ", "avenue ", "boulevard ", "place ", "allée ", "chemin ", "impasse ", "quai "]
    german = [f"{w} " for w in "weg straße strasse str. gasse platz allee ring damm ufer Straße Weg Platz Allee".split()]
    others = ["Calle ", "Avenida ", "Plaza ", "Rua ", "Praça ", "Travessa ", "ul. ", "al. ", "ул. ", "пр. "]
    return [*(f" {w}" for w in words if len(w) >= 4), *short, *french, *german, *others]


_SIGN = re.compile(r"@| ?[\[({] ?at ?[\])}]", re.I)
_LOCAL = re.compile(r"[\w+%\-][\w.+%\-]*$")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str


_DIGITS = str.maketrans("012345678", "9" * 9)
_SHAPE = str.maketrans("012345678BCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 9 + "A" * 25)


def shape(text: str) -> str:
    """Digits as 9, capitals as A, the rest as it is."""
    return text.translate(_SHAPE)


def _before(text: str, start: int) -> str:
    words = text[max(0, start - 40) : start].rpartition("\n")[2].split()[-2:]
    return " ".join(words).lower().translate(_DIGITS) or "^"


def _after(text: str, end: int) -> str:
    words = text[end : end + 30].partition("\n")[0].split()[:1]
    return " ".join(words).lower().translate(_DIGITS) or "$"


def seed_names(sender: str) -> list[tuple[str, str]]:
    """(given, family) if the mailbox agrees with the display name as a person's does."""
    m = re.match(rf'^"?({_W}), ({_W})"? *<([^@<>]+)@', sender) or re.match(rf"^({_W}) ({_W}) *(?:/[^<]*)?<([^@<>]+)@", sender)
    if m:
        a, b, local = m[1].lower(), m[2].lower(), m[3].lower().split("+")[0]
        if "," in sender.partition("<")[0]:
            a, b = b, a
        if local in (f"{a}.{b}", f"{a[0]}{b}", f"{b}_{a[0]}", b) or re.fullmatch(re.escape(a) + r"\d+", local):
            return [(a, b)]
    return []


def role_name(sender: str) -> str | None:
    """First word of a display name that is its mailbox written out, as of a role."""
    m = re.match(rf"^({_W}) ({_W}) *<([^@<>]+)@", sender)
    if m and m[3].lower() in (f"{m[1]}{m[2]}".lower(), f"{m[1]}-{m[2]}".lower(), f"{m[1]}_{m[2]}".lower()):
        return m[1].lower()
    return None


def sightings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between patterns and instances of distinct texts, counted within the batch.

    name: words before or after a capitalised pair, and its first word;
    pair: the first and the second word; number: words before, and the shape;
    seed: given names of sender headers; role: first words of role names.
    """
    for pdf in frames:
        n: Counter = Counter()
        for sender, text in zip(pdf["sender"], pdf["body"]):
            if sender:
                if role := role_name(sender):
                    n["role", "", role] += 1
                for given, family in seed_names(sender):
                    n["seed", "", given] += 1
                    n["pair", given, family] += 1
            if not text:
                continue
            for m in PAIR.finditer(text):
                first, second = m[1].lower(), m[2].lower()
                n["name", "<" + _before(text, m.start()), first] += 1
                n["name", ">" + _after(text, m.end()), first] += 1
                n["pair", first, second] += 1
            for m in NUMBER.finditer(text):
                n["number", _before(text, m.start()), shape(m[0])] += 1
        rows = [(k, p, x, c) for (k, p, x), c in n.items()]
        yield pd.DataFrame(rows, columns=["kind", "pattern", "instance", "n"])


def _salts(edges: DataFrame, node: str, other: str, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` with a salt for the joins on ``node``: 0, but of several values for
    nodes of more than ``hot`` edges; and those nodes (at most 1/``hot`` of the edges)."""
    many = durable(edges.groupBy("graph", node).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > hot).select("graph", node), "hot_nodes")
    if many.isEmpty():
        return edges.withColumn(f"salt_{node}", F.lit(0)), None
    marked = edges.join(F.broadcast(many.withColumn("hot", F.lit(True))), ["graph", node], "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)
    return marked.withColumn(f"salt_{node}", salt).drop("hot"), many


def _spread(scores: DataFrame, node: str, many: DataFrame | None) -> DataFrame:
    """Scores of nodes with the salts that their edges have."""
    if many is None:
        return scores.withColumn(f"salt_{node}", F.lit(0))
    marked = scores.join(F.broadcast(many.withColumn("hot", F.lit(True))), ["graph", node], "left")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn(f"salt_{node}", F.explode(salts)).drop("hot")


def propagate(edges: DataFrame, fixed_i: DataFrame, fixed_p: DataFrame, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """Scores of instances: (graph, instance, a, b).

    ``edges`` (graph, pattern, instance, n) hold several graphs at once, on which
    two scores a and b spread.  ``fixed_i`` (graph, instance, a, b) and ``fixed_p`` (graph,
    pattern, a, b) hold fixed scores, null where a score is free.  A score is the
    mean over the neighbours, weighted by the edges, shrunk towards 0 by one
    unseen neighbour.  Nodes of many edges are split in the joins and summed
    before the shuffle in the aggregates.
    """
    marked, hot_i = _salts(edges, "instance", "pattern", hot)
    marked, hot_p = _salts(marked, "pattern", "instance", hot)
    marked = durable(marked, "edges")

    def step(scores: DataFrame, of: str, to: str, many: DataFrame | None, fixed: DataFrame) -> DataFrame:
        known = marked.join(_spread(scores, of, many), ["graph", of, f"salt_{of}"], "left")
        sums = known.groupBy("graph", to).agg(*[(F.sum(F.col("n") * F.coalesce(c, F.lit(0.0))) / (F.sum("n") + 1)).alias(f"_{c}") for c in "ab"])
        return sums.join(fixed, ["graph", to], "left").select("graph", to, *[F.coalesce(c, f"_{c}").alias(c) for c in "ab"])

    scores = fixed_i
    for _ in range(rounds):
        patterns = step(scores, "instance", "pattern", hot_i, fixed_p)
        scores = durable(step(patterns, "pattern", "instance", hot_p, fixed_i), "scores")
    return scores


class Lexicons(NamedTuple):
    given: frozenset
    family: frozenset
    not_family: frozenset
    phone: frozenset
    id_number: frozenset


def _single(shapes: DataFrame) -> DataFrame:
    """Shapes without those of two numbers side by side, which have no shape of their own."""
    parts = F.split("instance", " ")
    heads = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " ")))
    double = shapes.select("instance", F.explode(heads).alias("head")).join(shapes.select(F.col("instance").alias("head")), "head", "left_semi")
    return shapes.join(double.select("instance").distinct(), "instance", "left_anti")


def learn(emails: DataFrame, rounds: int = ROUNDS, lexicon: int = LEXICON) -> Lexicons | DataFrame:
    """Lexicons of the corpus, of every row and without a least count.

    With more than ``lexicon`` entries they stay a table (kind, entry).
    """
    # what is stored again counts once, or one message would outweigh all others
    none = F.lit(None).cast("string")
    texts = emails.select(none.alias("sender"), "body").where("body is not null").distinct()
    headers = emails.select("sender", none.alias("body")).where("sender is not null").distinct()
    raw = headers.unionByName(texts).mapInPandas(sightings, "kind string, pattern string, instance string, n bigint")
    seen = durable(raw.groupBy("kind", "pattern", "instance").agg(F.sum("n").alias("n")), "sightings")

    edges = seen.where("kind in ('name', 'number')").select(F.col("kind").alias("graph"), "pattern", "instance", "n")
    roles = seen.where("kind = 'role'").select("instance").distinct()
    people = durable(seen.where("kind = 'seed'").select("instance").distinct().join(roles, "instance", "left_anti"), "people")
    none = F.lit(None).cast("double")
    given_seeds = people.withColumn("a", F.lit(1.0)).unionByName(roles.withColumn("a", F.lit(0.0))).select(F.lit("name").alias("graph"), "instance", "a", none.alias("b"))
    # of numbers a is the score as a phone, b as an identity number
    plus = edges.where("graph = 'number'").where(F.col("instance").startswith("+")).select("graph", "instance").distinct().select("*", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    p = F.col("pattern")
    phone, identity, other = (p.rlike(w.pattern) for w in (PHONE_WORDS, ID_WORDS, OTHER_WORDS))
    words = edges.where("graph = 'number'").select("graph", "pattern").distinct()
    words = words.select("*", F.when(phone, 1.0).when(identity | other, 0.0).alias("a"), F.when(identity, 1.0).when(phone | other, 0.0).alias("b")).where("a is not null or b is not null")
    scores = propagate(edges, given_seeds.unionByName(plus), words, rounds)
    pairs = seen.where("kind = 'pair'").select(F.col("pattern").alias("instance"), F.col("instance").alias("second"), F.col("n").alias("m"))
    # a given name goes with many families, a set phrase with one; what sender headers confirm is a name
    phrase = pairs.groupBy("instance").agg(F.max("m").alias("most"), F.sum("m").alias("all")).where("all >= 6 and most > 0.5 * all").select("instance")
    phrase = phrase.join(people, "instance", "left_anti")
    given = durable(scores.where((F.col("graph") == "name") & (F.col("a") >= ACCEPT)).select("instance").join(phrase, "instance", "left_anti"), "given_names")

    marked = pairs.join(broadcast_if_small(given.select("instance", F.lit(1).alias("g"))), "instance", "left")
    second = durable(marked.groupBy("second").agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.coalesce("g", F.lit(0))) / F.sum("m")).alias("share")), "second")
    families = second.where(F.col("share") >= ACCEPT)

    shapes = scores.where("graph = 'number'").withColumn("digits", F.length(F.regexp_replace("instance", "[^9]", "")))
    phone = _single(durable(shapes.where("a >= 0.4 and a > b and digits >= 9").select("instance"), "phone"))
    ids = _single(durable(shapes.where("b >= 0.4 and b > a and digits >= 6").select("instance"), "id_number"))
    lists = {"given": given.select("instance"), "family": families.select("second"), "not_family": second.where(F.col("share") < ACCEPT).select("second"), "phone": phone, "id_number": ids}
    table = None
    for kind, df in lists.items():
        one = df.toDF("entry").select(F.lit(kind).alias("kind"), "entry")
        table = one if table is None else table.unionByName(one)
    table = durable(table, "lexicon")
    return table if table.count() > lexicon else _lexicons((r["kind"], r["entry"]) for r in table.collect())


def _lexicons(entries: Iterable[tuple[str, str]]) -> Lexicons:
    found: dict[str, set] = {kind: set() for kind in Lexicons._fields}
    for kind, entry in entries:
        found[kind].add(entry)
    return Lexicons(**{kind: frozenset(x) for kind, x in found.items()})


@cache
def _cue_automaton():
    import ahocorasick

    cues = ahocorasick.Automaton()
    for w in _address_cues():
        cues.add_word(w, 0)
    cues.make_automaton()
    return cues


class Finder:
    """Finds the mentions of a text with the lexicons of the corpus."""

    def __init__(self, lex: Lexicons) -> None:
        import ahocorasick

        self.lex = lex
        self.given = ahocorasick.Automaton()
        for w in lex.given:
            self.given.add_word(w, len(w))
        if lex.given:
            self.given.make_automaton()
        self.cues = _cue_automaton()

    def _family(self, word: str) -> bool:
        return word in self.lex.family or word.partition("-")[0] in self.lex.family

    def names(self, text: str) -> Iterator[Mention]:
        """Given names with the family name after or before them, then initials with one."""
        lex = self.lex
        lower = text.lower()
        if len(lower) != len(text):  # letter by letter, so that places stay
            lower = "".join([c if len(c.lower()) != 1 else c.lower() for c in text])
        n, done = len(text), -1
        for last, length in self.given.iter(lower) if lex.given else ():
            s, e = last + 1 - length, last + 1
            if s < done or (s and _joined(text, s - 1, -1)) or (e < n and _joined(text, e, 1)):
                continue
            m = _AFTER.match(text, e)
            if m:
                raw = m[1]
                f = raw.lower()
                known = self._family(f)
                if f not in lex.given and (known or (raw[0].isupper() and text[s].isupper() and len(f) > 2 and f not in lex.not_family)):
                    done = m.end()
                    yield Mention(s, done, "name")
                    continue
            if text[s - 2 : s] == ", " and s >= 2:
                at = s - 2
                while at > max(done, 0) and (text[at - 1].isalpha() or text[at - 1] in "’'-"):
                    at -= 1
                m = _ENDING.search(text, at, s - 2)
                if m and m.start() >= done:
                    f = m[0].lower()
                    if self._family(f) and f not in lex.given:
                        extra = _INITIAL_AFTER.match(text, e)
                        done = extra.end() if extra else e
                        yield Mention(m.start(), done, "name")
        for m in _INITIAL.finditer(text):
            f = m[1].lower()
            if self._family(f) and f not in lex.given:
                yield Mention(m.start(), m.end(), "name")

    def mailboxes(self, text: str) -> Iterator[Mention]:
        """Mailboxes around the sign (or word) that parts their halves."""
        done = 0
        for sign in _SIGN.finditer(text):
            at = sign.start()
            while at > done and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
                at -= 1
            left = _LOCAL.search(text, at, sign.start())
            if left and (m := EMAIL.match(text, left.start())) and m.end() > sign.end():
                done = m.end()
                yield Mention(left.start(), done, "email")

    def numbers(self, text: str) -> Iterator[Mention]:
        for m in NUMBER.finditer(text):
            s, e = m.span()
            form = shape(m[0])
            if form in self.lex.phone:
                x = EXTENSION.match(text, e)
                yield Mention(s, x.end() if x else e, "phone")
            elif form in self.lex.id_number:
                yield Mention(s, e, "id_number")
            elif " " in form:
                # words that only resemble a prefix, or two numbers side by side
                for a, b in _splits(m[0]):
                    part = shape(m[0][a:b])
                    kind = "phone" if part in self.lex.phone else "id_number" if part in self.lex.id_number else None
                    if kind:
                        end = s + b
                        x = EXTENSION.match(text, end) if kind == "phone" else None
                        yield Mention(s + a, x.end() if x else end, kind)
                        break

    def find(self, text: str) -> list[Mention]:
        """Mentions that don't overlap, in the order of the text."""
        found: list[Mention] = []

        def add(new: Iterator[Mention]) -> None:
            for m in new:
                if all(m.end <= o.start or m.start >= o.end for o in found):
                    found.append(m)

        add(self.mailboxes(text))
        if next(self.cues.iter(text + "\0"), None) is not None:  # the end of the text ends a word
            add(Mention(m.start(), m.end(), "address") for m in ADDRESS.finditer(text))
        add(self.numbers(text))
        add(self.names(text))
        return sorted(found)

    def redact(self, text: str) -> str:
        """The text with a typed placeholder in place of each mention, otherwise unchanged."""
        out, at = [], 0
        for m in self.find(text):
            out += [text[at : m.start], f"<{m.kind.upper()}>"]
            at = m.end
        return "".join([*out, text[at:]])


def _splits(text: str) -> list[tuple[int, int]]:
    """Sub-spans of a number between blanks, longest first."""
    starts = [0, *[m.end() for m in re.finditer(" ", text)]]
    ends = [*[m.start() for m in re.finditer(" ", text)], len(text)]
    spans = [(a, b) for a in starts for b in ends if b - a >= 6]
    return sorted(spans, key=lambda x: x[0] - x[1])[1:]


def _rows(emails: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    out = None
    for name in fields:
        one = emails.select("record_id", F.lit(name).alias("field_name"), F.col(name).alias("text")).where(F.col("record_id").isNotNull() & F.col("text").rlike(r"(?U)\w"))
        out = one if out is None else out.unionByName(one)
    return out


def candidates(text: str) -> set[str]:
    """All entries of lexicons that matter to a text: its words, their first parts and the shapes of its numbers."""
    out = set()
    for m in WORD.finditer(text):
        word = m[0].lower()
        out |= {word, word.partition("-")[0]}
    for m in NUMBER.finditer(text):
        out |= {shape(m[0]), *(shape(m[0][a:b]) for a, b in _splits(m[0]))}
    return out


def _with_own(rows: DataFrame, lexicons: Lexicons | DataFrame) -> DataFrame:
    """Rows with ``own``, the entries for their text of lexicons that are a table; null if tasks get the whole."""
    if isinstance(lexicons, Lexicons):
        return rows.withColumn("own", F.lit(None).cast("array<string>"))
    keyed = durable(rows.withColumn("row_no", F.monotonically_increasing_id()), "texts")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(n, c) for n, text in zip(pdf["row_no"], pdf["text"]) for c in candidates(text)], columns=["row_no", "entry"])

    # a name may stand in a third of all texts: those are split over the salts
    wanted = keyed.select("row_no", "text").mapInPandas(run, "row_no bigint, entry string").withColumn("salt", F.pmod("row_no", F.lit(SALTS)).cast("int"))
    salted = lexicons.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = wanted.join(salted, ["entry", "salt"]).groupBy("row_no").agg(F.collect_list(F.concat_ws("\t", "kind", "entry")).alias("own"))
    return keyed.join(own, "row_no", "left").drop("row_no")


def _finders(pdf: pd.DataFrame, shared: Finder | None) -> Iterator[Finder]:
    """The finder of each row of a batch."""
    for own in pdf["own"]:
        yield shared or Finder(_lexicons(x.split("\t") for x in (own if own is not None else ())))


def mentions(emails: DataFrame, fields: tuple[str, ...] = ("body", "sender"), lexicons: Lexicons | DataFrame | None = None) -> DataFrame:
    """(record_id, field_name, pii_kind, pii_text): each distinct personal text of a field.

    Null, empty and blank fields have none; rows without a record_id are left out.
    """
    lex = learn(emails) if lexicons is None else lexicons
    whole = lex if isinstance(lex, Lexicons) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Finder(whole) if whole else None
        for pdf in frames:
            out = []
            for key, name, text, finder in zip(pdf["record_id"], pdf["field_name"], pdf["text"], _finders(pdf, shared)):
                for kind, value in dict.fromkeys((m.kind, text[m.start : m.end]) for m in finder.find(text)):
                    out.append((key, name, kind, value))
            yield pd.DataFrame(out, columns=["record_id", "field_name", "pii_kind", "pii_text"])

    return _with_own(_rows(emails, fields), lex).mapInPandas(run, "record_id bigint, field_name string, pii_kind string, pii_text string")


def redacted(emails: DataFrame, fields: tuple[str, ...] = ("body", "sender"), lexicons: Lexicons | DataFrame | None = None) -> DataFrame:
    """(record_id, field_name, redacted) of each field with text."""
    lex = learn(emails) if lexicons is None else lexicons
    whole = lex if isinstance(lex, Lexicons) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Finder(whole) if whole else None
        for pdf in frames:
            yield pdf[["record_id", "field_name"]].assign(redacted=[f.redact(t) for t, f in zip(pdf["text"], _finders(pdf, shared))])

    return _with_own(_rows(emails, fields), lex).mapInPandas(run, "record_id bigint, field_name string, redacted string")
