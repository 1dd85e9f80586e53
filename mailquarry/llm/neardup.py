"""Problem 1: near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable
from .setjoin import similar_sets


def near_duplicate_classes(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.7, min_words: int = 20) -> DataFrame:
    """One row for each record with at least ``min_words`` words.

    Columns: the id, ``class_id`` (smallest id with the same set of words),
    ``n_links`` (other classes at or above ``threshold``).  Copies are not
    expanded.  Nulls count as empty text; an empty table gives an empty result.
    """
    members, pairs = similar_sets(df, id_col, text_cols, threshold, min_words)
    links = durable(pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links")), "links")
    return members.join(broadcast_if_small(links), "rep", "left").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.7, min_words: int = 20) -> DataFrame:
    """Every pair of records at or above ``threshold``: (record_a, record_b), a < b.

    Repeated rows of one class are expanded, since the result asks for pairs.
    """
    members, pairs = similar_sets(df, id_col, text_cols, threshold, min_words)
    return expand_pairs(members, pairs).select(F.col("x").alias("record_a"), F.col("y").alias("record_b"))


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of members (x, y, fx, fy) from class pairs and from equal members."""
    m = members.select("rep", "id", "flags")
    linked = pairs.select("a", "b", F.lit(False).alias("same"))
    copied = m.where("id <> rep").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("same")).distinct()
    sides = durable(linked.unionByName(copied), "class_pairs")
    involved = durable(sides.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "involved")
    m = durable(m.join(broadcast_if_small(involved), "rep", "left_semi"), "involved_members")
    left = m.select(F.col("rep").alias("a"), F.col("id").alias("ida"), F.col("flags").alias("fa"))
    right = m.select(F.col("rep").alias("b"), F.col("id").alias("idb"), F.col("flags").alias("fb"))
    both = sides.join(left, "a").join(right, "b").where("not same or ida < idb")
    swap = F.col("ida") > F.col("idb")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return both.select(pick("ida", "idb").alias("x"), pick("idb", "ida").alias("y"), pick("fa", "fb").alias("fx"), pick("fb", "fa").alias("fy"))
