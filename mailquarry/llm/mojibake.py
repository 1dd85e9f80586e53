"""Problem 5: garbled text from wrong character encoding."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable
from . import words

LANGUAGES = ("en", "de", "fr", "es", "pt", "pl", "ru")
#: A word of a dictionary is seen once in so many documents at least, and twice in all: a rarer one
#: may be garbled itself, and in long dictionaries of rare words and names a match takes more bytes.
FREQUENT = 150
DICTIONARY_BYTES = 48_000
#: Bytes that each step of a chain costs beside the compressed text.
CHAIN_COST = 1.0
#: A step that maps single bytes is possible almost everywhere, so it costs more.
SINGLE_BYTE_COST = 2.0
LOST = "�"

#: Encodings in which UTF-8 bytes get read (fixed values).
READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "cp850", "cp437", "mac_roman", "cp866", "koi8-r")
#: (read as, written in) of single-byte texts (fixed values).
SINGLE_BYTE = (("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "koi8-r"), ("latin-1", "iso8859-2"), ("latin-1", "iso8859-5"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"))
#: Garbled characters that a word of a script outside the dictionaries must have come from: fewer may be valid bytes by chance.
OTHER_SCRIPT = 6
#: Characters that restored text may hold beside ASCII at any length (fixed values).
MARKS = "«»“”‘’„‚–—…€£°½¼¾№¿¡§©®™·•×±²³µªº "
LATIN = "áéíóúñüäößàâçèêëîïôùûœãõåøæýÿþðșț" + "".join(c for c in map(chr, range(0x100, 0x17F)) if c.islower() and c != "ŉ")
CYRILLIC = "".join(map(chr, range(0x430, 0x450))) + "ёіїєґ"
PLAUSIBLE = frozenset(MARKS + LATIN + LATIN.upper() + "İ" + CYRILLIC + CYRILLIC.upper() + "ẞŸ")
#: Letters of each language outside ASCII, with the marks it uses (fixed values).
ALPHABETS = {"de": "äöüßÄÖÜẞ", "fr": "àâçèéêëîïôùûœæÀÂÇÈÉÊËÎÏÔÙÛŒ", "es": "áéíóúñüÁÉÍÓÚÑÜ", "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ", "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "ru": CYRILLIC + CYRILLIC.upper()}
#: Seeds of the dictionaries, used also where no document exists (fixed values).
SEEDS = {
    "en": "café résumé naïve façade déjà vu El Niño the of and to in is with for from that are was",
    "de": "für über müssen können möchte später natürlich Größe Grüße geprüft wäre während zurück Lösung Büro jährlich gemütlich plötzlich vorläufig nächstens ändern klärte und der die das nicht ist",
    "fr": "été déjà très après près où à côté équipe propriété complètement régulièrement légèrement sûrement bientôt numéro reçu français élève être même ça dès et le la les des une pour",
    "es": "también después mañana número está están enviará según así allí todavía quizás fácilmente únicamente próximamente señor días años español cuándo quedó y el la los de una por",
    "pt": "não então amanhã também já até às você número questões será são possível código três rápido ação coordenação há é estação e o a os de uma por",
    "pl": "będzie już także później właśnie zupełnie według również ktoś dziś wysłał trafiła kosztować proszę być dość często około można żeby ważna dzień państwa są i w na z do się",
    "ru": "Сегодня завтра когда почти снова для наша номер сумму дело по словам отправит сведения коллеги обсудили проверена придёт спрашивает стоит будет начнётся вопросов про тему быстро уже ещё Ещё её Её неё моё своё всё Всё и в на не что из",
}
LETTERS = re.compile(r"[^\W\d_]+")
FIELD_WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f](?:[^\x00-\x7f]|[A-Za-z])*")


def _encode(text: str, codec: str) -> bytes:
    """As ``codec`` would have read it; bytes it leaves undefined stand for themselves."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(codec)
            except UnicodeEncodeError:
                if 0x80 <= ord(ch) <= 0x9F:
                    out.append(ord(ch))
                else:
                    raise
        return bytes(out)


@cache
def _script(ch: str) -> str:
    """Script of a letter, by the first word of its name; those of one writing system count as one."""
    name = unicodedata.name(ch, "").split(" ")[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "KATAKANA-HIRAGANA") else name


def _scripts(word: str) -> int:
    return len({_script(ch) for ch in word if ch.isalpha()})


@cache
def _symbol(ch: str) -> bool:
    """Signs, pictures, arrows and what joins them, from the planes that take three bytes or more."""
    return ord(ch) >= 0x2000 and unicodedata.category(ch) in ("So", "Sm", "Sc", "Sk", "Po", "Pd", "Ps", "Pe", "Pi", "Pf", "Mn", "Cf", "No", "Nl")


def _plausible(word: str, garbled: str | None = None) -> bool:
    """Whether a word may be text: letters and marks of the languages known, signs, or
    letters of another script if ``garbled`` is long enough to make it no accident."""
    rest = [ch for ch in word if ord(ch) >= 128 and ch not in PLAUSIBLE and not _symbol(ch)]
    if not rest:
        return True
    if garbled is None or not all(ch.isalpha() or unicodedata.combining(ch) for ch in rest):
        return False
    return sum(ord(ch) >= 128 for ch in garbled) >= OTHER_SCRIPT


def decodings(word: str, surely: bool = True) -> dict[tuple, str]:
    """Candidate originals of a word by chain; a chain is a tuple of steps.

    Without ``surely`` a few letters of another script will do, as where the chain
    is known from other words.
    """
    found: dict[tuple, str] = {}
    level: dict[str, tuple] = {word: ()}
    seen = {word}
    while level:  # every step makes the text shorter
        after: dict[str, tuple] = {}
        for text, chain in level.items():
            for codec in READ_AS:
                try:
                    fixed = _encode(text, codec).decode("utf-8")
                except (UnicodeError, ValueError):
                    continue
                if fixed in seen or any("\ud800" <= c <= "\udfff" for c in fixed):
                    continue
                after.setdefault(fixed, (*chain, codec))
                # the same original may come by several chains; a field needs one for all its words
                if _plausible(fixed, word if surely else word * OTHER_SCRIPT) and _scripts(fixed) <= 1:
                    found[(*chain, codec)] = fixed
        seen.update(after)
        level = after
    for codec, true in SINGLE_BYTE:
        try:
            fixed = word.encode(codec).decode(true)
        except (UnicodeError, ValueError):
            continue
        if fixed != word and any(ch.isalpha() for ch in word) and _plausible(fixed) and _scripts(fixed) <= 1:
            found[(f"{codec}>{true}",)] = fixed
    return found


class Describer:
    """Description length of words: zstd frames under the dictionary of each language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters.from_level(6, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors = []
        self.cache: dict[str, tuple[int, ...]] = {}
        for content in [*dictionaries.values(), f" {MARKS} ".encode()]:  # the last is of no language
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            self.compressors.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
        self.known = frozenset(w for c in dictionaries.values() for w in c.decode().split())

    def lengths(self, word: str) -> tuple[int, ...]:
        """Frame length of a word, by dictionary."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            data = f" {word.lower()} ".encode("utf-8", "surrogatepass")
            got = self.cache[word] = tuple(len(c.compress(data)) for c in self.compressors)
        return got

    def length(self, words: list[str]) -> int:
        """Words are described one by one, so that repeats within a garbled
        text don't make it cheap, and by the dictionary that suits them all best."""
        return min(map(sum, zip(*map(self.lengths, words))))


def _cost(chain: tuple) -> float:
    return sum(SINGLE_BYTE_COST if ">" in step else CHAIN_COST for step in chain)


class Restorer:
    """Finds garbled words of a text and the chain that explains them best."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.describe = Describer(dictionaries)
        self.cache: dict[str, dict[tuple, str]] = {}

    def candidates(self, word: str) -> dict[tuple, str]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            # a word of the dictionaries is taken as it stands
            got = self.cache[word] = {} if word in self.describe.known else decodings(word)
        return got

    def restore(self, text: str) -> tuple[str, list[tuple]]:
        """(restored text, chains used); chains are empty if nothing was gained."""
        words = list(dict.fromkeys(FIELD_WORD.findall(text)))
        fixed: dict[str, str] = {}
        chains: list[tuple] = []
        while True:
            by_chain: dict[tuple, list[str]] = {}
            for w in words:
                if w not in fixed:
                    for chain in self.candidates(w):
                        by_chain.setdefault(chain, []).append(w)
            best = None
            for chain, ws in by_chain.items():
                now = self.describe.length(ws)
                then = self.describe.length([self.candidates(w)[chain] for w in ws])
                gain = now - then - _cost(chain)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, chain, ws
            if best is None:
                break
            chains.append(best[1])
            fixed.update((w, self.candidates(w)[best[1]]) for w in best[2])
        if not fixed:
            return text, []
        for w in words:
            if w not in fixed and w not in self.describe.known:
                by = decodings(w, False)
                chain = next((c for c in chains if c in by and self.describe.length([by[c]]) < self.describe.length([w])), None)
                if chain:
                    fixed[w] = by[chain]
        return FIELD_WORD.sub(lambda m: fixed.get(m[0], m[0]), text), chains


def _good_words(counts: Counter, lang: str) -> dict[str, int]:
    """The words that lie within the language's alphabet."""
    letters = frozenset(ALPHABETS.get(lang, ""))
    good = {w: n for w, n in counts.items() if all(ord(c) < 128 or c in letters for c in w)}
    if lang == "ru":
        good = {w: n for w, n in good.items() if _scripts(w) == 1 and not w.isascii()}
    return good


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (lang, text) -> (lang, word, n) of each batch; the empty word stands for its documents."""
    for b in batches:
        for lang in LANGUAGES:
            own = b.filter(pc.equal(b.column("lang"), lang))
            if not own.num_rows:
                continue
            _, code, distinct = words.pieces(own.column("text"))
            counts: Counter = Counter()
            for piece, n in zip(distinct.to_pylist(), np.bincount(code, minlength=len(distinct)).tolist()):
                for w in LETTERS.findall(piece):
                    counts[w] += n
            good = {"": own.num_rows} | _good_words(counts, lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(good), pa.string()), pa.array(list(good), pa.string()), pa.array(list(good.values()), pa.int64())], names=["lang", "word", "n"])


def language_dictionaries(documents: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw zstd dictionaries: the frequent words of each language, counted over all its
    documents, the most frequent ones last (nearest), as far as ``size`` bytes hold
    them; words outside the language's alphabet left out."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.where(lang.isin(*LANGUAGES) & F.col("text").isNotNull()).select(lang.alias("lang"), "text")
    counts = durable(rows.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word_counts")
    least = F.lit(2.0)
    for row in counts.where("word = ''").collect():
        least = F.when(F.col("lang") == row["lang"], max(2.0, row["n"] / FREQUENT)).otherwise(least)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    picked = counts.where((F.col("word") != "") & (F.col("n") >= least)).withColumn("r", rank).where(F.col("r") <= size // 2).collect()  # a word takes two bytes or more
    out = {}
    for k in LANGUAGES:
        kept = [row["word"] for row in sorted((x for x in picked if x["lang"] == k), key=lambda x: x["r"])]
        content, room = [], size
        for w in [*SEEDS[k].split(), *kept]:
            room -= len(w.encode()) + 1
            if room < 0:
                break
            content.append(w)
        out[k] = (" " + " ".join(reversed(content)) + " ").encode()
    return out


def garbled_fields(emails: DataFrame, documents: DataFrame, fields: tuple[str, ...] = ("body", "subject"), key: str = "record_id") -> DataFrame:
    """One row for each field that holds text read in a wrong encoding.

    Columns: the key, field_name, chain (text of the steps; null if only lost
    characters show), restored (null if characters were lost).  Null, empty and
    pure ASCII fields are never garbled; text that no chain describes shorter is
    left unchanged.  Rows without a key are left out.
    """
    dictionaries = language_dictionaries(documents)
    packed = emails.where(F.col(key).isNotNull()).select(key, *fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(dictionaries)
        for pdf in frames:
            out = []
            for k, name, text in zip(pdf[key], pdf["field_name"], pdf["text"]):
                restored, chains = restorer.restore(text)
                lost = LOST in text
                if chains or lost:
                    out.append((k, name, " | ".join("+".join(c) for c in chains) or None, None if lost else restored))
            yield pd.DataFrame(out, columns=[key, "field_name", "chain", "restored"])

    def one(name: str) -> DataFrame:
        return packed.select(F.col(key), F.lit(name).alias("field_name"), F.col(name).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))

    rows = one(fields[0])
    for name in fields[1:]:
        rows = rows.unionByName(one(name))
    kind = emails.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, field_name string, chain string, restored string")
