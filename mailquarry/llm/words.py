"""Words of a batch of texts: only its distinct pieces between blanks are looked at closely."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every piece between blanks, in order, and the distinct pieces."""
    lists = pc.utf8_split_whitespace(texts)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def lower(texts: pa.Array) -> pa.Array:
    """In lower case, also where a letter has a special one."""
    if pc.any(pc.match_substring_regex(texts, "[\u0130\u03a3]")).as_py():
        return pa.array([x.lower() for x in texts.to_pylist()], pa.string())
    return pc.utf8_lower(texts)


def words_of(distinct: pa.Array, between: str, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of each piece: where they start in ``ids``, how many, ``ids``, and the distinct words.

    ``between``: the pattern that parts words; those of fewer than ``least`` letters are left out.
    """
    parts = pc.split_pattern_regex(lower(distinct), between)
    owner = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    coded = parts.flatten().dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    keep = (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= least)[ids] if len(words) else np.empty(0, bool)
    owner, ids = owner[keep], ids[keep]
    count = np.bincount(owner, minlength=len(distinct))
    return np.cumsum(count) - count, count, ids, words


def spread(code: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the piece in ``code``, word) of every word of the pieces ``code``."""
    n = count[code]
    at = np.repeat(np.arange(len(code)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, ids[start[code][at] + within]


def distinct(keys: np.ndarray) -> np.ndarray:
    """Keys without repeats, ascending, by a sort (numpy's own way goes through a hash table and is slower)."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def word_hash(words: pa.Array | list[str]) -> np.ndarray:
    """Hashes of words, the same in every process."""
    values = words if isinstance(words, list) else words.to_pylist()
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False) if values else np.empty(0, np.uint64)
