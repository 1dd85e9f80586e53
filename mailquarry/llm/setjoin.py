"""Exact Jaccard join of word sets in regions around pivots.

Every word is a pivot of the Jaccard metric space (the singleton set).  A
document lies nearest to the pivots it contains; ties go to the rarest one,
which gives its Voronoi region.  Two documents within distance ``1 - t`` of
each other are, by the overlap that the distance bound forces, both inside the
window of their first common pivot, so each document is replicated to exactly
the regions of its window (``n - ceil(t n) + 1`` rarest pivots).  A region whose
pivot is common is joined recursively: its members are counted, and where they
are too many they move on to regions of one pivot more with a window one wider.
Documents that may share no further word with a partner are joined where they
are; what is still large is split into blocks, each pair of blocks being joined
once.  Within a region, triangle-inequality windows
in the symmetric-difference metric discard pairs: the distance to the empty
set (sizes), to the pivot's position, and to 256 parity pivots (signatures).
A pair counts in the region of its first common pivot, where all words before it
are differences; so the signatures are those of the words after it, and the later
(that is, the more common) a pivot is, the fewer differences are left for them.
Survivors are verified on the whole sets, so the result is exact.

Document pivots, as the method has them in low dimension, cannot separate text:
README gives the figures.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable
from . import words

WORD = r"([\p{L}\p{N}]+)"
#: Frequencies of at most this many words go to every task; those of rarer words are joined.
MAX_RANKED = 500_000
#: A region of more documents than this hands them on to regions of one pivot more.
MAX_REGION = 400_000
#: Pivots that a region has at most; larger regions are split into blocks.
DEPTH = 4
BLOCK = 200_000
#: Documents whose replicas one task of the region join takes, on average.
DOCS_A_TASK = 20_000
#: 64-bit words of a signature.
SIG = 4
#: Regions of more documents are compared by tiles of so many rows and columns; smaller ones all at once, by steps.
DENSE, TILE = 192, (64, 1024)


def word_set(*cols: Column) -> Column:
    """Distinct maximal runs of letters and digits, lower-cased; null is empty."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)))


def _batch_words(batch: pa.RecordBatch, texts: list[str]):
    """Word occurrences of a batch of documents.

    Returns (document index, word index) of every occurrence and the hashes of
    the batch's words; a batch's words are few beside its occurrences.
    """
    cols = [pc.fill_null(batch.column(c).cast(pa.string()), "") for c in texts]
    text = pc.binary_join_element_wise(*cols, " ") if len(cols) > 1 else cols[0]
    doc, code, distinct = words.pieces(text)
    *where, known = words.words_of(distinct, r"[^\p{L}\p{N}]+")
    at, word = words.spread(code, *where)
    return doc[at], word, words.word_hash(known)


def _distinct(doc: np.ndarray, rank: np.ndarray, size: int):
    """(document, rank) without repeats, sorted."""
    key = words.distinct(doc * size + rank)
    return key // max(size, 1), key % max(size, 1)


def _profile(texts: list[str]):
    """mapInArrow function: one row for each document (kind 0: id, flags, size and
    hash of its set), one for each word of a batch (kind 1: hash, documents)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            doc, code, hashes = _batch_words(b, texts)
            doc, code = _distinct(doc, code, len(hashes))
            n = np.bincount(doc, minlength=b.num_rows)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            full = np.nonzero(n)[0]
            h = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                x = np.zeros(b.num_rows, np.uint64)
                if len(full):
                    x[full] = np.add.reduceat(_mix(hashes + np.uint64(salt))[code], start[full])
                h.append(x.view(np.int64))
            of = np.bincount(code, minlength=len(hashes))
            seen = of > 0
            k = int(seen.sum())
            none = np.zeros(k, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(b.num_rows, np.int32), np.ones(k, np.int32)])),
                    pa.array(np.concatenate([b.column("id").to_numpy(zero_copy_only=False), hashes[seen].view(np.int64)])),
                    pa.array(np.concatenate([n, of[seen]]).astype(np.int32)),
                    pa.array(np.concatenate([b.column("flags").to_numpy(zero_copy_only=False), none]).astype(np.int32)),
                    *[pa.array(np.concatenate([x, none])) for x in h],
                ],
                names=["kind", "id", "n", "flags", "h1", "h2"],
            )

    return run


def _hashed(texts: list[str]):
    """mapInArrow function: id and sorted hashes of the document's words."""

    def run(batches):
        for b in batches:
            doc, code, hashes = _batch_words(b, texts)
            order = np.argsort(hashes.view(np.int64))
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            doc, rank = _distinct(doc, back[code], len(hashes))
            n = np.bincount(doc, minlength=b.num_rows)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)[order][rank]))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "h"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class _Ordered:
    """Word sets of a batch, the rarest word first; sets that are too small are left out."""

    def __init__(self, batch: pa.RecordBatch, texts: list[str], t: float, min_words: int, hashes: np.ndarray, freqs: np.ndarray) -> None:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        flags = batch.column("flags").to_numpy(zero_copy_only=False).astype(np.int64)
        doc, code, hashed = _batch_words(batch, texts)
        signed = hashed.view(np.int64)
        of = np.ones(len(hashed), np.int64)  # every word that is not counted stands in one document
        counts = [(hashes, freqs)]
        if "own" in batch.schema.names:
            own = batch.column("own").flatten()
            h, at = np.unique(own.field("h").to_numpy(zero_copy_only=False), return_index=True)
            counts.append((h, own.field("c").to_numpy(zero_copy_only=False)[at]))
        for h, c in counts:
            if len(h) and len(hashed):
                at = np.minimum(np.searchsorted(h, signed), len(h) - 1)
                of = np.where(h[at] == signed, c[at], of)
        order = np.lexsort((signed, of))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        doc, rank = _distinct(doc, back[code], len(hashed))
        n = np.bincount(doc, minlength=len(ids))
        enough = n >= max(1, min_words)
        keep = enough[doc]
        new = np.cumsum(enough) - 1
        self.doc, rank = new[doc[keep]], rank[keep]
        self.n, self.ids, self.flags = n[enough], ids[enough], flags[enough]
        self.flat, self.freq = signed[order][rank], of[order][rank]
        n = self.n
        self.start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.empty(0, np.int64)
        self.pos = np.arange(len(self.flat)) - np.repeat(self.start, n)
        bits = _mix(hashed)
        self.sig, self.rest_sig = [], []  # of the whole sets, and of the words after each one
        for part in range(SIG):
            one = np.where((bits >> np.uint64(6)) % np.uint64(SIG) == part, np.uint64(1) << (bits & np.uint64(63)), np.uint64(0))
            upto = np.bitwise_xor.accumulate(one[order][rank]).view(np.int64)
            ends = upto[self.start + n - 1]
            self.sig.append(ends ^ np.concatenate([[0], ends[:-1]]) if len(n) else ends)
            self.rest_sig.append(ends[self.doc] ^ upto)
        self.need = np.ceil(t * n - 1e-9).astype(np.int64)
        self.probe = n - self.need + 1
        self.index = n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + 1


_SIGS = [f"s{k}" for k in range(SIG)]
_REPLICA = "key bigint, id bigint, packed bigint, " + ", ".join(f"{c} bigint" for c in _SIGS)
#: ``packed`` of a row that only says that its document has common pivots in its window.
HOT = -1


def _window_counts(texts: list[str], t: float, min_words: int, hashes: np.ndarray, freqs: np.ndarray, max_region: int):
    """mapInArrow function: (h, c) of the frequent words in windows of a batch, with the documents in whose window they are."""

    def run(batches):
        for b in batches:
            x = _Ordered(b, texts, t, min_words, hashes, freqs)
            h, c = np.unique(x.flat[(x.pos < x.probe[x.doc]) & (x.freq > max_region)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

    return run


def _replicas(texts: list[str], t: float, min_words: int, hashes: np.ndarray, freqs: np.ndarray, common: np.ndarray):
    """mapInArrow function: documents -> their replicas, one row a region; a row
    HOT more for each document whose window holds a pivot that is too ``common``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _Ordered(batch, texts, t, min_words, hashes, freqs)
        keep = x.pos < x.probe[x.doc]
        hot = keep & np.isin(x.flat, common) if len(common) else np.zeros(len(keep), bool)
        one = np.nonzero(keep & ~hot)[0]
        d, p = x.doc[one], x.pos[one]
        packed = (x.n[d] << 32) | (np.minimum(p, (1 << 24) - 1) << 8) | (x.flags[d] << 4) | (2 << 1) | (p < x.index[d])
        marked = words.distinct(x.doc[hot])
        ids = x.ids[marked]
        key = np.concatenate([x.flat[one], _mix(ids.view(np.uint64)).view(np.int64)])
        d = np.concatenate([d, marked])
        packed = np.concatenate([packed, np.full(len(marked), HOT)])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(x.ids[d]), pa.array(packed), *[pa.array(np.concatenate([v[one], v[x.start[marked]]])) for v in x.rest_sig]], names=["key", "id", "packed", *_SIGS])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield rows(b)

    return run


_WINDOW = "id bigint, flags int, n int, need int, probe int, idx int, w array<bigint>, c array<boolean>, " + ", ".join(f"{c} bigint" for c in _SIGS)


def _windows(texts: list[str], t: float, min_words: int, hashes: np.ndarray, freqs: np.ndarray, common: np.ndarray):
    """mapInArrow function: documents -> the words of their widest window, and which of them are too ``common``."""

    def run(batches):
        for b in batches:
            x = _Ordered(b, texts, t, min_words, hashes, freqs)
            keep = x.pos < (x.probe + DEPTH - 1)[x.doc]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(x.doc[keep], minlength=len(x.ids)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[keep])) for v in (x.flat, np.isin(x.flat, common))]
            numbers = [pa.array(v.astype(np.int32)) for v in (x.flags, x.n, x.need, x.probe, x.index)]
            yield pa.RecordBatch.from_arrays([pa.array(x.ids), *numbers, *lists, *[pa.array(v) for v in x.sig]], names=["id", "flags", "n", "need", "probe", "idx", "w", "c", *_SIGS])

    return run


def _recursive_replicas(windows: DataFrame, max_region: int, block: int) -> DataFrame:
    """Replicas for the common pivots of ``windows`` (durable).

    Level by level the members of each region are counted.  A region of at most
    ``max_region`` is done; of a larger one the members go on, each with every
    later word of its window, and stay only if a partner may share no more words
    than the region has pivots.
    """
    same = ["id", "flags", "n", "need", "probe", "idx", "w", *_SIGS]
    first = F.posexplode(F.slice("c", F.lit(1), F.col("probe"))).alias("pos", "hot")
    rows = windows.select(*same, first).where("hot")
    rows = rows.select(*same, "pos", F.col("w")[F.col("pos")].alias("key"), (F.col("pos") < F.col("idx")).alias("inside"))
    done = None
    for level in range(1, DEPTH + 1):
        rows = durable(rows, "hot_rows")
        stays = F.lit(True) if level == DEPTH else F.col("need") <= level
        counts = durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.count_if(stays).alias("stay")), "hot_counts")
        large = broadcast_if_small(counts.where(F.col("c") > max_region).select("key", F.greatest(F.lit(1), F.ceil(F.col("stay") / block)).cast("int").alias("m")))
        sized = rows.join(large, "key", "left")
        pos = F.greatest(F.lit(0), F.col("pos") - (level - 1)).alias("pos")  # the pivots before stand for its words
        final = sized.where(F.col("m").isNull() | stays).select("key", "id", "n", pos, "flags", "inside", F.coalesce("m", F.lit(1)).alias("m"), *_SIGS)
        done = final if done is None else done.unionByName(final)
        if level == DEPTH or counts.where(F.col("c") > max_region).isEmpty():
            break
        last = F.least(F.col("n"), F.col("probe") + level) - 1
        on = sized.where(F.col("m").isNotNull() & (F.col("pos") < last)).select(*same, "key", "inside", F.explode(F.sequence(F.col("pos") + 1, last)).alias("pos"))
        rows = on.select(*same, "pos", F.xxhash64("key", F.col("w")[F.col("pos")]).alias("key"), (F.col("inside") & (F.col("pos") < F.col("idx") + level)).alias("inside"))
    own = F.pmod(F.xxhash64("id"), F.col("m")).cast("int")
    blocks = done.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    key = F.when(F.col("m") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    packed = F.shiftleft(F.col("n").cast("bigint"), 32) + F.least("pos", F.lit((1 << 24) - 1)) * 256 + F.col("flags") * 16 + side * 2 + F.col("inside").cast("int")
    return blocks.select(key.alias("key"), "id", packed.cast("bigint").alias("packed"), *_SIGS)


def _region_pairs(t: float, bipartite: bool, rest_sigs: bool = True):
    """mapInArrow function over rows sorted by key and size: candidate pairs (a, b);
    rows HOT come out with their id as a and no b.

    With ``rest_sigs`` the signatures are those of the words after the pivot, and
    the words before it count as differences; else they are those of the whole sets.
    """
    share = t / (1 + t)

    def marks(ids):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64())], names=["a", "b"])

    def steps(key, n, most, index):
        """(i, j) of all pairs within sizes, j after i."""
        i = np.nonzero((key[:-1] == key[1:]) & (index[:-1] == 1))[0]
        step = 1
        while len(i):
            if i[-1] + step >= len(key):
                i = i[i + step < len(key)]
            j = i + step
            ok = (key[i] == key[j]) & (n[j] <= most[i])  # sorted by size: what leaves the window stays out
            i = i[ok]
            if not len(i):
                break
            yield i, j[ok]
            step += 1

    def tiles(n, most, index, room, bits):
        """(i, j) of the pairs of one region within sizes that one folded signature leaves, j after i."""
        kind = np.int8 if np.abs(room).max() <= 60 else np.int16
        long = n > 15_000  # their room doesn't count, so that 16 bits hold the sum of two
        up, down = (np.where(long, 16_000, f(room)).astype(kind) for f in (np.ceil, np.floor))
        high, wide = TILE
        xor, count, left, near = np.empty(high * wide, np.uint64), np.empty(high * wide, np.uint8), np.empty(high * wide, kind), np.empty(high * wide, bool)
        rows = np.nonzero(index)[0]
        rows = rows[np.lexsort((most[rows], np.log(n[rows]) // 0.06))]  # alike in size and reach
        for at in range(0, len(rows), high):
            i = rows[at : at + high]
            first, end = int(i.min()) + 1, int(np.searchsorted(n, most[i].max(), "right"))
            cols = first + np.nonzero(most[first:end] >= n[i].min())[0]
            for k in range(0, len(cols), wide):
                j = cols[k : k + wide]
                shape, size = (len(i), len(j)), len(i) * len(j)
                np.bitwise_xor(bits[i][:, None], bits[j][None, :], out=xor[:size].reshape(shape))
                np.bitwise_count(xor[:size], out=count[:size])
                np.add(up[i][:, None], down[j][None, :], out=left[:size].reshape(shape))
                np.less_equal(count[:size].view(np.int8), left[:size], out=near[:size])
                hit = np.flatnonzero(near[:size])
                if len(hit):
                    x, y = i[hit // len(j)], j[hit % len(j)]
                    ok = (y > x) & (n[y] <= most[x]) & (n[x] <= most[y])
                    yield x[ok], y[ok]

    def pairs(key, ids, packed, *sigs):
        n = packed >> 32
        pos = (packed >> 8) & 0xFFFFFF
        flags, side, index = (packed >> 4) & 15, (packed >> 1) & 3, packed & 1
        sigs = [s.view(np.uint64) for s in sigs]  # bit counts of signed values are those of their magnitude
        rest = n - pos  # words from the pivot on
        before = pos if rest_sigs else np.zeros_like(pos)
        most = np.floor(rest / share - n + 1e-6).astype(np.int64)  # size of the largest partner
        blocks = bool((side != 2).any())
        out_a, out_b = [], []

        def keep(i, j):
            need = np.ceil(share * (n[i] + n[j]) - 1e-9)
            ok = np.minimum(rest[i], rest[j]) >= need
            if blocks:
                ok &= (side[i] == 2) | (side[i] != side[j])
            if bipartite:
                ok &= (((flags[i] & 1) & (flags[j] >> 1)) | ((flags[i] >> 1) & (flags[j] & 1))) != 0
            k = np.nonzero(ok)[0]
            x, y = i[k], j[k]
            room = n[x] + n[y] - 2 * need[k] - before[x] - before[y]
            for s in sigs:  # far pairs drop out early
                room = room - np.bitwise_count(s[x] ^ s[y])
                near = room >= 0
                x, y, room = x[near], y[near], room[near]
            if len(x):
                out_a.append(np.minimum(ids[x], ids[y]))
                out_b.append(np.maximum(ids[x], ids[y]))

        start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        sizes = np.diff(np.append(start, len(key)))
        small = np.nonzero(np.repeat(sizes <= DENSE, sizes))[0]
        for i, j in steps(key[small], n[small], most[small], index[small]):
            keep(small[i], small[j])
        folded = np.bitwise_xor.reduce(sigs)
        room = (1 - 2 * share) * n - before + 1e-6  # of each row's part of the differences
        for at, size in zip(start[sizes > DENSE], sizes[sizes > DENSE]):
            of = slice(at, at + size)
            held, n_held = [], 0
            for i, j in tiles(n[of], most[of], index[of], room[of], folded[of]):
                held.append((at + i, at + j))
                n_held += len(i)
                if n_held > 100_000:
                    keep(*map(np.concatenate, zip(*held)))
                    held, n_held = [], 0
            if held:
                keep(*map(np.concatenate, zip(*held)))
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    def run(batches):
        names = ["key", "id", "packed", *_SIGS]
        held = [np.empty(0, np.int64) for _ in names]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            hot = new[2] == HOT
            if hot.any():
                yield marks(new[1][hot])
                new = [x[~hot] for x in new]
            held = [np.concatenate([x, y]) for x, y in zip(held, new)]
            if len(held[0]) < 200_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # keys ascend; the last may go on
            if cut:
                if (found := pairs(*[x[:cut] for x in held])) is not None:
                    yield found
                held = [x[cut:] for x in held]
        if len(held[0]) and (found := pairs(*held)) is not None:
            yield found

    return run


def _unranked(texts: list[str], hashes: np.ndarray):
    """mapInArrow function: (id, h) of each distinct word of a document that isn't ranked."""

    def run(batches):
        for b in batches:
            doc, code, hashed = _batch_words(b, texts)
            signed = hashed.view(np.int64)
            rest = ~np.isin(signed, hashes)[code] if len(hashes) else np.ones(len(code), bool)
            doc, code = _distinct(doc[rest], code[rest], len(hashed))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), pa.array(signed[code])], names=["id", "h"])

    return run


def _word_frequencies(profile: DataFrame, n_words: int, max_ranked: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """Document counts of the words in more than one document.

    Returns those that go to every task (hashes ascending, counts) and, if there
    are more than ``max_ranked`` words, the others as a table (h, c).  All counts
    sum up to ``n_words``, hence at most ``max_ranked`` reach the threshold: what
    comes to the driver is bounded at any input, and no word of the table is in
    more than ``n_words / max_ranked`` documents.
    """
    counts = durable(profile.where("kind = 1").groupBy(F.col("id").alias("h")).agg(F.sum("n").alias("c")).where("c > 1"), "word_counts")
    least = 2 if counts.count() <= max_ranked else max(2, math.ceil(n_words / max_ranked))
    got = counts.where(F.col("c") >= least).toArrow().sort_by("h")
    rest = counts.where(F.col("c") < least) if least > 2 else None
    return (got["h"].to_numpy().astype(np.int64), got["c"].to_numpy().astype(np.int64)), rest


def similar_sets(
    docs: DataFrame,
    id_col: str,
    text_cols: list[str],
    threshold: float,
    min_words: int,
    flags: Column | None = None,
    *,
    max_ranked: int = MAX_RANKED,
    max_region: int = MAX_REGION,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """All pairs of word sets with Jaccard likeness of at least ``threshold``.

    ``docs`` has a unique bigint ``id_col``; rows with a null id or with fewer
    than ``min_words`` distinct words take no part.  ``flags`` (1: first side,
    2: second side) limits the pairs to those between the two sides.

    Returns ``(members, pairs)``.  ``members`` (id, rep, flags) has one row for
    each document: ``rep`` is the smallest id with the same set of words, so a
    group of copies of any size is one class.  ``pairs`` (a, b, inter, uni) has each pair
    of different classes, by their reps, a < b.  Empty input gives empty tables.
    """
    bipartite = flags is not None
    base = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (flags if bipartite else F.lit(3)).cast("int").alias("flags"),
        *[F.col(c).alias(f"t{k}") for k, c in enumerate(text_cols)],
    ).where(F.col("id").isNotNull())
    texts = [f"t{k}" for k in range(len(text_cols))]
    profile = durable(base.mapInArrow(_profile(texts), "kind int, id bigint, n int, flags int, h1 bigint, h2 bigint"), "profile")
    keyed = profile.where("kind = 0").where(F.col("n") >= min_words)
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"), F.bit_or("flags").alias("all_flags")).where("c > 1")
    copies = durable(keyed.join(classes, ["h1", "h2"]).select("id", "rep", "all_flags"), "copies")
    members = keyed.select("id", "flags").join(broadcast_if_small(copies.select("id", "rep")), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), "flags")

    size = profile.where("kind = 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    ranked, rest = _word_frequencies(profile, size["words"] or 0, max_ranked)
    reps = base.join(broadcast_if_small(copies.where("id <> rep").select("id")), "id", "left_anti")
    if bipartite:
        both = copies.where("id = rep").select("id", "all_flags")
        reps = reps.join(broadcast_if_small(both), "id", "left").withColumn("flags", F.coalesce("all_flags", "flags")).drop("all_flags")
    reps = reps.select("id", "flags", *texts)
    if rest is not None:
        own = reps.select("id", *texts).mapInArrow(_unranked(texts, ranked[0]), "id bigint, h bigint").join(rest, "h").groupBy("id").agg(F.collect_list(F.struct("h", "c")).alias("own"))
        reps = durable(reps.join(own, "id", "left"), "reps")
    # a task holds the regions of about DOCS_A_TASK documents, however many there are
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["docs"] / DOCS_A_TASK))

    common = np.empty(0, np.int64)
    if (ranked[1] > max_region).any() or (rest is not None and not rest.where(F.col("c") > max_region).isEmpty()):
        counts = reps.mapInArrow(_window_counts(texts, threshold, min_words, *ranked, max_region), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
        common = np.sort(counts.where(F.col("c") > max_region).select("h").toArrow()["h"].to_numpy().astype(np.int64))

    def joined(replicas: DataFrame, rest_sigs: bool) -> DataFrame:
        regions = replicas.repartition(tasks, "key").sortWithinPartitions("key", "packed")
        return durable(regions.mapInArrow(_region_pairs(threshold, bipartite, rest_sigs), "a bigint, b bigint").distinct(), "candidates")

    found = joined(reps.mapInArrow(_replicas(texts, threshold, min_words, *ranked, common), _REPLICA), True)
    hot = found.where("b is null").select(F.col("a").alias("id"))
    found = found.where("b is not null")
    if len(common):
        windows = reps.join(broadcast_if_small(hot), "id", "left_semi").mapInArrow(_windows(texts, threshold, min_words, *ranked, common), _WINDOW)
        found = found.unionByName(joined(_recursive_replicas(durable(windows, "windows"), max_region, block), False)).distinct()

    ids = durable(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate_ids")
    held = durable(base.join(broadcast_if_small(ids), "id", "left_semi").select("id", *texts).mapInArrow(_hashed(texts), "id bigint, h array<bigint>"), "candidate_sets")
    both_sets = found.join(held.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(held.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    inter = F.size(F.array_intersect("ha", "hb"))
    pairs = both_sets.select("a", "b", inter.alias("inter"), (F.size("ha") + F.size("hb") - inter).alias("uni"))
    return members, pairs.where(F.col("inter") >= F.col("uni") * threshold - 1e-9)
