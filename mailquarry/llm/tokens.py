"""Problem 8: encoding of the whole corpus with public tokenizers.

The byte-level encoder is a streaming transducer.  For each position of a
pre-token it keeps the one token that ends the encoding of the prefix up to
there; a token may follow another only if the merge list leaves the two apart
when it encodes their bytes together.  Tokens that end further before the last
byte than the merge list's sufficient lookahead are stable: they are emitted and
forgotten, so that memory doesn't grow with the text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Pre-tokens of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
OTHERS = {"word_bpe_49k": "word_bpe_49k.json", "piece_bpe_32k": "piece_bpe_32k.model"}
#: Pre-tokens up to this many characters are remembered, at most CACHE of them.
SHORT, CACHE = 48, 400_000
#: Bytes after which a stream looks for stable tokens.
CHUNK = 256


def merged(data: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The merges of a rank under ``below`` applied to a few bytes."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which no longer text can change a token any more.

    Let a text and a longer one be encoded merge by merge, in the order of rank.
    Both agree up to some token.  A merge (u, v) moves that border, by the length
    of u, only if u is the last token in common and v stands after it in one of the
    two alone; whatever moves it next has a higher rank and a right part that
    begins with u.  The longest such chain bounds how far the border ever moves.
    Raises ValueError if the list holds a token that no merge of it makes.
    """
    longest: dict[bytes, int] = {}  # by the beginning of the right part, over the merges of higher rank
    most = 0
    for token in sorted(ranks, key=ranks.get, reverse=True):
        parts = merged(token, ranks, ranks[token])
        if len(token) == 1:
            continue
        if len(parts) != 2:
            raise ValueError(f"no merge of the list makes {token!r}")
        left, right = parts
        reach = len(left) + longest.get(left, 0)
        most = max(most, reach)
        for k in range(1, len(right) + 1):
            if longest.get(right[:k], 0) < reach:
                longest[right[:k]] = reach
    return most


class Transducer:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int | None = None) -> None:
        import regex

        self.ranks = ranks
        self.lookahead = sufficient_lookahead(ranks) if lookahead is None else lookahead
        self.longest = max(map(len, ranks))
        #: Bytes that the window holds at most.
        self.limit = self.lookahead + self.longest + CHUNK
        self.suffixes = frozenset(t[k:] for t in ranks for k in range(len(t)))
        self.pattern = regex.compile(PATTERN)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _follows(self, a: bytes, b: bytes) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > CACHE:
                self.apart.clear()
            got = self.apart[a, b] = merged(a + b, self.ranks) == [a, b]
        return got

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in chunks of bytes; at most ``limit`` bytes are held."""
        ranks, suffixes, follows = self.ranks, self.suffixes, self._follows
        window = bytearray()  # bytes since the last emitted token
        last: list[bytes | None] = []  # last token of the encoding of each prefix of the window
        before = b""  # the last emitted token
        for chunk in chunks:
            for byte in chunk:
                window.append(byte)
                n = len(window)
                found = None
                for k in range(n - 1, max(-1, n - 1 - self.longest), -1):
                    piece = bytes(window[k:n])
                    if piece not in suffixes:
                        break
                    if piece in ranks and (k == 0 and (not before or follows(before, piece)) or k > 0 and last[k - 1] is not None and follows(last[k - 1], piece)):
                        found = piece
                last.append(found)
                if n == self.limit:
                    used = 0
                    for t in self._path(last, n):
                        if used + len(t) > n - self.lookahead:
                            break
                        yield ranks[t]
                        used += len(t)
                        before = t
                    # a token is at most ``longest`` bytes long, so CHUNK bytes or more are free again
                    del window[:used]
                    del last[:used]
        for t in self._path(last, len(window)):
            yield ranks[t]

    @staticmethod
    def _path(last: list[bytes | None], end: int) -> list[bytes]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for m in self.pattern.finditer(text):
            word = m[0]
            ids = cache.get(word)
            if ids is None:
                data = word.encode("utf-8", "replace")
                ids = (self.ranks[data],) if data in self.ranks else tuple(self.stream(data[k : k + 256] for k in range(0, len(data), 256)))
                if len(word) <= SHORT:
                    if len(cache) > CACHE:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, byte by byte; bytes that are no text become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join([machine.decode(self.bytes_of[i]) for i in ids]) + machine.decode(b"", True)


_LOADED: dict[tuple[str, str], object] = {}


def load_ranks(name: str, folder: str) -> dict[bytes, int]:
    lines = (Path(folder) / BYTE_LEVEL[name]).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


def transducer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS, lookahead: int | None = None) -> Transducer:
    """The transducer of a vocabulary, loaded once a process."""
    if (folder, name) not in _LOADED:
        _LOADED[folder, name] = Transducer(load_ranks(name, folder), lookahead)
    return _LOADED[folder, name]


def _other(name: str, folder: str):
    """Encoder of a vocabulary that isn't byte-level, by its public library."""
    path = str(Path(folder) / OTHERS[name])
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def encode_texts(docs: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row with a key; null and empty texts have an empty list."""
    kind = docs.schema[key].dataType.simpleString()
    lookahead = transducer(name, folder).lookahead if name in BYTE_LEVEL else None  # computed once, on the driver

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        byte_level = transducer(name, folder, lookahead).encode if name in BYTE_LEVEL else None
        other = None if byte_level else _other(name, folder)
        for pdf in frames:
            texts = [t or "" for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "ids": [byte_level(t) for t in texts] if byte_level else other(texts)})

    return docs.where(docs[key].isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of each row with a key."""
    kind = docs.schema[key].dataType.simpleString()
    lookahead = transducer(name, folder).lookahead

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = transducer(name, folder, lookahead).encode
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "n_tokens": [len(encode(t)) for t in pdf[text]]})

    return docs.where(docs[key].isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens int")


def decode_ids(encoded: DataFrame, name: str = "byte_bpe_50k", key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of rows of ids; an empty list gives an empty text."""
    kind = encoded.schema[key].dataType.simpleString()
    lookahead = transducer(name, folder).lookahead

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = transducer(name, folder, lookahead).decode
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "text": [decode(map(int, ids)) for ids in pdf["ids"]]})

    return encoded.select(key, "ids").mapInPandas(run, f"`{key}` {kind}, text string")
