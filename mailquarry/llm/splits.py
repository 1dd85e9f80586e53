"""Problem 6: splits that keep related records together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Groups of at least 1/LARGE of the records are assigned one by one on the driver: at most LARGE of them.
LARGE = 20_000
#: Edges that one task may merge; beyond it the merge goes on by star contraction.
MERGE_EDGES = 300_000


def domain_key(raw: Column) -> Column:
    """Last two non-empty labels, trimmed and in lower case; null if ``raw`` is no host name."""
    host = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    ok = host.rlike(r"(?U)^[\w.\-]+$") & (F.size(labels) >= 2)
    return F.when(ok, F.array_join(F.slice(labels, -2, 2), "."))


class Forest:
    """Union-find over strings; the root of a tree is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def link(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        return pd.DataFrame([(x, self.find(x)) for x in self.up], columns=["a", "b"], dtype="object")


def _local_forest(frames: Iterator[pd.DataFrame], bound: int = MERGE_EDGES) -> Iterator[pd.DataFrame]:
    """Forests of the edges of a task, a new one wherever ``bound`` edges are held."""
    forest = Forest()
    for pdf in frames:
        for a, b in zip(pdf["a"], pdf["b"]):
            forest.link(a, b)
            if len(forest.up) >= bound:
                yield forest.edges()
                forest = Forest()
    yield forest.edges()


def _star_contraction(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds until nothing changes; every
    step is a grouped minimum and a join, so no group is held in one task."""
    last = None
    while True:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        both = down.join(least, "a")
        small = both.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = durable(small, "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return edges
        last = state


def connected_components(edges: DataFrame, merge_edges: int = MERGE_EDGES, fan_in: int = 8) -> DataFrame:
    """(a, root) of every node of an edge table (a, b) that has a neighbour.

    Each task builds forests of its own edges, of at most ``merge_edges`` each;
    forests are merged ``fan_in`` at a time until all fit one task.  Where a level
    no longer shrinks them, star contraction finishes instead.
    Self links and nulls link nothing; an empty table gives an empty result.
    """
    schema = "a string, b string"
    links = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _local_forest(frames, merge_edges)

    forests = durable(links.mapInPandas(local, schema), "forests")
    held = forests.count()
    while held > merge_edges:
        parts = max(2, math.ceil(held / (merge_edges * fan_in)))
        forests = durable(forests.repartition(parts, "b").mapInPandas(local, schema), "forests")
        before, held = held, forests.count()
        if held > merge_edges and held > 0.7 * before:
            return _star_contraction(forests).select("a", F.col("b").alias("root"))
    return forests.coalesce(1).mapInPandas(_local_forest, schema).select("a", F.col("b").alias("root"))


def entity_components(aliases: DataFrame) -> DataFrame:
    """(domain, entity) of the domains that ``domain_aliases`` links."""
    edges = aliases.select(domain_key(F.col("domain_name")).alias("a"), domain_key(F.col("same_as")).alias("b"))
    return durable(connected_components(edges).select(F.col("a").alias("domain"), F.col("root").alias("entity")), "entities")


def entity_pairs(emails: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of different sending domains of one entity: (domain_a, domain_b), a < b.

    Domains that never send link others but are in no pair.
    """
    entity = entity_components(aliases)
    roots = entity.select(F.col("entity").alias("domain"), "entity").distinct()
    sending = emails.select(domain_key(F.col("sender_domain")).alias("domain")).where("domain is not null").distinct()
    known = durable(sending.join(entity.unionByName(roots).distinct(), "domain"), "sending")
    other = known.select(F.col("domain").alias("domain_b"), "entity")
    return known.withColumnRenamed("domain", "domain_a").join(other, "entity").where("domain_a < domain_b").select("domain_a", "domain_b")


def _fill(room: dict[str, float], size: int, count: int) -> dict[str, int]:
    """How many of ``count`` equal groups each split gets when each goes to the
    split furthest below its target."""
    low, high = min(room.values()) - size * (count + 1), max(room.values())
    for _ in range(100):  # the level at which the splits stand afterwards
        mid = (low + high) / 2
        if sum(max(0, math.ceil((r - mid) / size)) for r in room.values()) > count:
            low = mid
        else:
            high = mid
    got = {k: max(0, math.ceil((r - high) / size)) for k, r in room.items()}
    for _ in range(count - sum(got.values())):
        k = max(room, key=lambda s: (room[s] - got[s] * size, s))
        got[k] += 1
    for k in room:
        room[k] -= got[k] * size
    return got


def grouped_split(emails: DataFrame, aliases: DataFrame, proportions: dict[str, float] | None = None, large: int = LARGE) -> DataFrame:
    """(record_id, split_name) of every record, whole entities together.

    Entity: the component of the sender's domain; records without a domain form
    one group for each ``source`` (null is a source of its own).  Groups are taken
    largest first and go to the split furthest below its target.  Groups under
    1/``large`` of the records are placed by their size: of each size, so many go
    to each split, in the order of a hash.
    """
    proportions = proportions or PROPORTIONS
    spark = emails.sparkSession
    domain = domain_key(F.col("sender_domain"))
    key = F.when(domain.isNotNull(), F.concat(F.lit("d:"), domain)).otherwise(F.concat(F.lit("s:"), F.coalesce("source", F.lit("null"))))
    records = emails.select("record_id", key.alias("key"))
    keys = durable(records.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "keys")
    linked = entity_components(aliases).select(F.concat(F.lit("d:"), "domain").alias("key"), F.concat(F.lit("d:"), "entity").alias("entity"))
    owned = durable(keys.join(broadcast_if_small(linked), "key", "left").select("key", "c", F.coalesce("entity", "key").alias("entity")), "owned")
    groups = durable(owned.groupBy("entity").agg(F.sum("c").alias("c")), "groups")
    total = groups.agg(F.sum("c")).first()[0] or 0

    room = {k: v * total for k, v in proportions.items()}
    least = max(1, total / large)
    placed = []
    for row in groups.where(F.col("c") >= least).orderBy(F.desc("c"), "entity").collect():  # at most `large` rows
        k = max(room, key=lambda s: (room[s], s))
        room[k] -= row["c"]
        placed.append((row["entity"], k))
    big = spark.createDataFrame(placed, "entity string, split_name string")

    rest = groups.where(F.col("c") < least)
    plan = []
    for row in rest.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect():  # distinct sizes: under sqrt(2 total)
        start = 0
        for name, n in _fill(room, row["c"], row["n"]).items():
            if n:
                plan.append((row["c"], start, start + n, name))
                start += n
    cuts = spark.createDataFrame(plan, "c bigint, low bigint, high bigint, split_name string")
    hashed = rest.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(4096)))
    offsets = hashed.groupBy("c", "bucket").agg(F.count(F.lit(1)).alias("k"))
    offsets = offsets.select("c", "bucket", (F.sum("k").over(Window.partitionBy("c").orderBy("bucket")) - F.col("k")).alias("before"))
    ranked = hashed.withColumn("r", F.row_number().over(Window.partitionBy("c", "bucket").orderBy("entity")) - 1).join(offsets, ["c", "bucket"])
    ranked = ranked.select("entity", "c", (F.col("r") + F.col("before")).alias("r"))
    little = ranked.join(F.broadcast(cuts), "c").where("r >= low and r < high").select("entity", "split_name")

    chosen = durable(owned.join(big.unionByName(little), "entity").select("key", "c", "split_name"), "chosen")
    frequent = broadcast_if_small(chosen.where(F.col("c") >= least).select("key", "split_name"))  # at most `large` rows
    hot = records.join(frequent, "key")
    cold = records.join(frequent, "key", "left_anti").join(chosen.where(F.col("c") < least).select("key", "split_name"), "key")
    return hot.unionByName(cold).select("record_id", "split_name")


def split_shares(emails: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records and share of each split."""
    counts = grouped_split(emails, aliases).groupBy("split_name").agg(F.count(F.lit(1)).alias("records"))
    return counts.select("split_name", "records", F.round(F.col("records") / emails.count(), 4).alias("share"))
