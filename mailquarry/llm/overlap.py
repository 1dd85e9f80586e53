"""Problem 3: same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, durable
from .neardup import expand_pairs
from .setjoin import similar_sets

#: Spellings of the three splits (fixed values).
SPLIT_NAMES = {"train": "train", "training": "train", "validation": "validation", "val": "validation", "valid": "validation", "dev": "validation", "test": "test", "testing": "test"}
TRAIN, EVAL = 1, 2


def split_name(raw: Column) -> Column:
    """``train``, ``validation`` or ``test``; null for any other spelling."""
    known = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return known[F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))]


def holding_split(splits: DataFrame) -> DataFrame:
    """(record_id, split): the row with the latest ``assigned_at`` holds.

    Ties go to the larger run, then to the alphabetically last name.  Rows
    with a null time count as the oldest; unknown names don't hold.
    """
    rows = splits.select("record_id", split_name(F.col("split_name")).alias("split"), "assigned_at", "run_no").where("record_id is not null and split is not null")
    return rows.groupBy("record_id").agg(F.max(F.struct("assigned_at", "run_no", "split")).alias("m")).select("record_id", F.col("m.split").alias("split"))


def canonical_hash(text: Column) -> Column:
    """Hash of a text after case, punctuation and white space are normalised; null counts as empty."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))))


def cross_split_pairs(emails: DataFrame, splits: DataFrame, threshold: float = 0.8, min_words: int = 15) -> DataFrame:
    """Pairs between train and evaluation rows with the columns of both sides.

    Evaluation hashes of the canonical text are joined with training hashes; those
    pairs are ``exact``.  One record of each hash goes on to ``similar_sets``, whose
    links between different hashes are the other pairs.  Columns: record_a,
    record_b (a < b), train_id, eval_id, exact.  Records without a split are in no
    pair, nor are bodies of fewer than ``min_words`` words.
    """
    held = holding_split(splits)
    side = F.when(F.col("split") == "train", TRAIN).otherwise(EVAL)
    docs = emails.select("record_id", "body").join(held, "record_id").select("record_id", "body", side.alias("side"), canonical_hash(F.col("body")).alias("h"))
    docs = durable(docs, "held_texts")
    classes = docs.groupBy("h").agg(F.min("record_id").alias("rep"), F.bit_or("side").alias("sides"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = durable(docs.select("record_id", "side", "h").join(classes, "h").select("record_id", "side", "rep", "sides"), "text_copies")
    first = docs.select("record_id", "body", "side").join(broadcast_if_small(copies.where("record_id <> rep").select("record_id")), "record_id", "left_anti")
    first = first.join(broadcast_if_small(copies.where("record_id = rep").select("record_id", "sides")), "record_id", "left")
    first = first.select("record_id", "body", F.coalesce("sides", "side").alias("side"))
    members, links = similar_sets(first, "record_id", ["body"], threshold, min_words, F.col("side"))

    long_enough = copies.where("sides = 3").join(members.select(F.col("id").alias("rep")), "rep", "left_semi")
    sided = durable(long_enough, "both_sides")
    exact = sided.where(F.col("side") == TRAIN).select("rep", F.col("record_id").alias("train_id")).join(sided.where(F.col("side") == EVAL).select("rep", F.col("record_id").alias("eval_id")), "rep")
    near = durable(expand_pairs(members, links).select("x", "y"), "near_texts")
    involved = durable(near.select(F.explode(F.array("x", "y")).alias("rep")).distinct(), "near_reps")
    alone = docs.select("record_id", "side").join(broadcast_if_small(copies.select("record_id")), "record_id", "left_anti").select(F.col("record_id").alias("rep"), "record_id", "side")
    records = durable(alone.unionByName(copies.select("rep", "record_id", "side")).join(broadcast_if_small(involved), "rep", "left_semi"), "near_records")
    of = lambda name: records.select(F.col("rep").alias(name), F.col("record_id").alias(f"id_{name}"), F.col("side").alias(f"side_{name}"))
    both = near.join(of("x"), "x").join(of("y"), "y").where("side_x <> side_y")
    left = F.col("side_x") == TRAIN
    near = both.select(F.when(left, F.col("id_x")).otherwise(F.col("id_y")).alias("train_id"), F.when(left, F.col("id_y")).otherwise(F.col("id_x")).alias("eval_id"))
    found = exact.select("train_id", "eval_id", F.lit(True).alias("exact")).unionByName(near.withColumn("exact", F.lit(False)))
    return found.select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b"), "train_id", "eval_id", "exact")


def overlap_report(emails: DataFrame, splits: DataFrame, threshold: float = 0.8, min_words: int = 15) -> DataFrame:
    """Overlapping pairs, those with equal canonical text, and distinct evaluation records, per split and source."""
    pairs = cross_split_pairs(emails, splits, threshold, min_words)
    info = emails.select(F.col("record_id").alias("eval_id"), "source").join(holding_split(splits).withColumnRenamed("record_id", "eval_id"), "eval_id")
    each = pairs.groupBy("eval_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("exact").alias("exact_pairs"))
    return each.join(info, "eval_id").groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.sum("exact_pairs").alias("exact_pairs"), F.count(F.lit(1)).alias("eval_records"))
