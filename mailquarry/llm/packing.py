"""Problem 9: filling fixed-capacity containers with documents.

Large items (above a third of the capacity) are matched first: at most two of
them share a container, each taking the largest partner that still fits.
Smaller items then go, largest first, to the container with the least room that
still holds them.  The plan is made on the histogram of sizes, which has at most
``capacity`` entries whatever the number of documents; documents take their
place in it by their rank among those of their size.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable
from .tokens import TOKENIZERS, token_counts

CAPACITY = 2048
#: A plan of at most so many places goes to every task; a longer one is joined by size.
SEATS = 100_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places of items: (size, first rank, number, first container) and the number of containers.

    Items of rank ``first rank + k`` go to container ``first container + k``.
    """
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    rank = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int]] = []
    bins = 0
    room: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, number)

    def put(size: int, number: int, first: int) -> None:
        places.append((size, rank[size], number, first))
        rank[size] += number
        left[size] -= number

    def free(space: int, first: int, number: int) -> None:
        if space > 0:
            room.setdefault(space, []).append((first, number))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            at = bisect.bisect_right(large, capacity - size) - 1
            while at >= 0 and (not left[large[at]] or (large[at] == size and left[size] < 2)):
                at -= 1
            if at < 0:
                n = left[size]
                put(size, n, bins)
                free(capacity - size, bins, n)
            else:
                partner = large[at]
                n = left[size] // 2 if partner == size else min(left[size], left[partner])
                put(size, n, bins)
                put(partner, n, bins)
                free(capacity - size - partner, bins, n)
            bins += n
    spaces = sorted(room)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(spaces, size)
            if at == len(spaces):  # new containers, filled with this size one layer after another
                layers = capacity // size
                n = -(-left[size] // layers)
                free(capacity, bins, n)
                bisect.insort(spaces, capacity)
                bins += n
                continue
            space = spaces[at]
            first, number = room[space].pop()
            n = min(number, left[size])
            put(size, n, first)
            if n < number:
                room[space].append((first + n, number - n))
            if not room[space]:
                del room[space]
                spaces.pop(at)
            rest = space - size
            if rest > 0:
                if rest not in room:
                    room[rest] = []
                    bisect.insort(spaces, rest)
                room[rest].append((first, n))
    return places, bins


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, piece_no, size, container) of each document and piece.

    Documents of up to ``capacity`` tokens are one piece (piece_no 1); longer
    ones are cut into full pieces and a rest.  Documents without tokens take no
    room and are spread over the containers by a hash (container 0 if there is none).
    """
    sizes = durable(token_counts(docs, tokenizer, key, text, folder), "token_counts")
    pieces = sizes.select(F.col(key).alias("k"), "n_tokens", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity).cast("int")))).alias("piece_no"))
    size = F.least(F.lit(capacity), F.col("n_tokens") - (F.col("piece_no") - 1) * capacity)
    pieces = pieces.select("k", "piece_no", size.alias("size"), F.pmod(F.xxhash64("k", "piece_no"), F.lit(1024)).alias("bucket"))
    counts = durable(pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")), "size_counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places, bins = plan(histogram, capacity)
    spark = docs.sparkSession
    seats = spark.createDataFrame(places, "size int, low bigint, number bigint, first bigint")
    if len(places) <= SEATS:
        seats = F.broadcast(seats)
    before = counts.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    before = broadcast_if_small(durable(before, "before"))  # at most `capacity` x 1,024 rows
    filled = pieces.where("size > 0")
    ranked = filled.withColumn("r", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("k", "piece_no")) - 1).join(before, ["size", "bucket"])
    ranked = ranked.select("k", "piece_no", "size", (F.col("r") + F.col("before")).alias("r"))
    seated = ranked.join(seats, (ranked["size"] == seats["size"]) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("low") + F.col("number")))
    placed = seated.select("k", "piece_no", ranked["size"], (F.col("first") + F.col("r") - F.col("low")).alias("container"))
    empty = pieces.where("size <= 0").select("k", "piece_no", F.lit(0).alias("size"), F.pmod(F.xxhash64("k"), F.lit(max(1, bins))).alias("container"))
    return placed.unionByName(empty).select(F.col("k").alias(key), "piece_no", F.col("size").cast("int").alias("size"), F.col("container").cast("bigint").alias("container"))


def splittable(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of which more than one piece was packed."""
    return packed.where("piece_no = 2").select(key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, pieces and the share of the room that is used."""
    whole = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return whole.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"))
