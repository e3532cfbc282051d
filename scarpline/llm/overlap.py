"""Records of evaluation splits that stand, the same or almost, in training.

Two kinds of overlap, each joined across the splits only:

* of names: winnowing over each record's corpus-ordered word sequence (scarpline.llm.names). The selected minima are the words
  that come first in that order, of which records within the threshold share at least one; seeds on one chain keep their order in
  both sequences, which bounds the overlap that an extension can still reach; the merge of the two sequences gives it exactly.
* of images: 64-bit hashes that differ in at most 5 bits. A run of equal bits is then only 10 long at least, too short to select
  anything by, so the windows here are three fixed blocks of 21 or 22 bits, one of which has at most one differing bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.llm.names import ITEM_TEXTS, candidates, classed, exact, sequences, spread_pairs
from scarpline.operators.hygiene import near_hashes
from scarpline.session import materialize, scope

def split_of(old_split: Column) -> Column:
    """train, validation, test or NULL, by the first letters, without regard to case and outer blanks."""
    s = F.lower(F.regexp_replace(old_split, r"^[\s\p{Z}]+", ""))
    return F.when(s.startswith("tr"), "train").when(s.startswith("va"), "validation").when(s.startswith("te") | s.startswith("ts"), "test")


def _in_splits(items: DataFrame) -> DataFrame:
    r = items.select("item_id", *ITEM_TEXTS, "phash", "dataset", split_of(F.col("old_split")).alias("split")).where("split is not null")
    return r.withColumn("training", F.col("split") == "train")


def name_overlaps(items: DataFrame) -> DataFrame:
    """(a, b, shared, total, size_a, size_b): one item in train, the other in validation or test, and near names; counted in words. Items of one side with equal words are joined as one."""
    r = _in_splits(items)
    with scope(items.sparkSession) as keep:
        records, copies = classed(sequences(r, "item_id", ITEM_TEXTS, ("training",)), "item_id", ("training",))
        found, copies = keep(materialize(exact(candidates(records, "training"), r, "item_id", ITEM_TEXTS))), keep(copies)
    return spread_pairs(found, copies)


def image_overlaps(items: DataFrame) -> DataFrame:
    """(e, t): evaluation and training items whose hashes are within 5 bits; equal hashes are joined once and spread to their items at the end."""
    hashed = _in_splits(items).where("phash is not null").select("item_id", F.col("phash").alias("h"), "training")
    close = near_hashes(hashed.where("not training"), hashed.where("training"))
    ev = hashed.where("not training").select(F.col("item_id").alias("e"), F.col("h").alias("g"))
    tr = hashed.where("training").select(F.col("item_id").alias("t"), "h")
    return close.join(ev, "g").join(tr, "h").select("e", "t").distinct()


def cross_split_pairs(items: DataFrame) -> DataFrame:
    """(item_a, item_b), item_a < item_b: one item in train, the other in validation or test, and hashes within 5 bits or near names.

    Items whose old_split is NULL, blank or unknown take no part; a NULL phash matches nothing; repeated rows count once.
    """
    by_hash = image_overlaps(items).select(F.least("e", "t").alias("item_a"), F.greatest("e", "t").alias("item_b"))
    by_name = name_overlaps(items).select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
    return by_hash.unionByName(by_name).where("item_a <> item_b").distinct()


def coverage(items: DataFrame) -> DataFrame:
    """(item_id, split, dataset, names, images, coverage) of each evaluation item that stands in train.

    names and images count its partners of each kind; coverage is the greatest share of the item's own words that one training item
    of a near name covers, NULL if there is none.
    """
    r = _in_splits(items).groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("split", "dataset")])
    n = name_overlaps(items)
    ends = n.select(F.inline(F.array(F.struct(F.col("a").alias("item_id"), (F.col("shared") / F.col("size_a")).alias("part")), F.struct(F.col("b").alias("item_id"), (F.col("shared") / F.col("size_b")).alias("part")))))
    by_name = ends.groupBy("item_id").agg(F.count(F.lit(1)).alias("names"), F.max("part").alias("coverage"))
    by_image = image_overlaps(items).groupBy(F.col("e").alias("item_id")).agg(F.count(F.lit(1)).alias("images"))
    both = by_name.join(by_image, "item_id", "full").join(r.where("split <> 'train'"), "item_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("item_id", "split", "dataset", zero("names"), zero("images"), F.round("coverage", 6).alias("coverage"))


def overlap_report(items: DataFrame) -> DataFrame:
    """(split, dataset, items, overlapping, pairs): for each evaluation split and dataset, its items, those that also stand in train, and the pairs; split and dataset of the evaluation item. A NULL dataset is a group of its own."""
    one = items.groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("dataset", "old_split")])
    ev = one.select("item_id", "dataset", split_of(F.col("old_split")).alias("split")).where("split in ('validation', 'test')")
    pairs = materialize(cross_split_pairs(items))
    ends = pairs.select(F.col("item_a").alias("item_id")).unionByName(pairs.select(F.col("item_b").alias("item_id")))
    hits = ends.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        ev.join(hits, "item_id", "left")
        .groupBy("split", "dataset")
        .agg(F.count(F.lit(1)).alias("items"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    )
