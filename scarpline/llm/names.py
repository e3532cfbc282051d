"""Near-duplicate records by their words: rare-word roots, vantage-point trees, exact pairs.

A record is the set of words of its texts. Two records are near when they share at least 4/5 of all their different words. Records with
the same words are one class, of which the first stands for all. Records are sequences of word hashes in one corpus-wide order, rare
words first; near records share a word among their first few (for sizes x <= y: the first x - ceil(8x/9) + 1 of the smaller, the first
y - ceil(4y/5) + 1 of the larger). Each such word is the root of a vantage-point tree over the fingerprints of its records. A fingerprint
is the record's word set folded by xor onto 128 bits, so the Hamming distance of two fingerprints is at most the number of words that
only one has, which for near records is at most (x + y) div 9.

The tree grows level by level: one record of a node with more than LEAF is its vantage point, and the others are parted at the median of
their measured distances from it, until every node is a leaf. The smaller record of a pair lives in one leaf; the larger one visits each
leaf that the triangle bounds leave open to it, on both sides of a border that is nearer than its radius.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.session import materialize, release, scope

#: Words are counted in so many buckets, whatever the corpus: the size of what goes to each task is fixed.
BUCKETS = 1 << 16
#: A node of a tree with more records is parted.
LEAF = 16


def words(*texts: Column) -> Column:
    """The distinct longest runs of a-z and 0-9 in the lower-cased texts; a NULL text has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("([a-z0-9]+)"), F.lit(1)))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def word_ranks(hashed: DataFrame) -> Column:
    """A binary literal of 2 bytes a bucket: how often words fall into it, over all records, on a logarithmic scale. hashed: a column h of word hashes."""
    counts = hashed.select(F.explode("h").alias("h")).select(_bucket(F.col("h")).alias("k")).groupBy("k").count()
    ranks = np.zeros(BUCKETS, dtype=">u2")
    for k, n in counts.collect():  # at most BUCKETS rows
        ranks[k] = min(65535, int(1024 * math.log2(1 + n)))
    return F.lit(ranks.tobytes())


def sequences(records: DataFrame, key: str, texts: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, seq): the record's word hashes, rare words first. Records without a word are left out: they are near to nothing."""
    hashed = records.select(key, *keep, F.transform(words(*map(F.col, texts)), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)
    ranks = word_ranks(hashed)
    order = F.array_sort(F.transform("h", lambda h: F.struct(F.substring(ranks, _bucket(h) * 2 + 1, F.lit(2)).alias("n"), h.alias("h"))))
    return hashed.select(key, *keep, F.transform(order, lambda x: x["h"]).alias("seq"))


def _fold(seq: Column, half: int) -> Column:
    """One of the two longs of a fingerprint: bits 0 to 5 of a word's hash choose the bit to flip, bit 6 the long."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    flip = lambda acc, h: acc.bitwiseXOR(F.when(h.bitwiseAND(64) == 64 * half, bit(h)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(seq, F.lit(0).cast("long"), flip)


def classed(seqs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, copies): a record (id, *keep, size, f0, f1, head) for each class of equal words and keep, and (id, first) of the others of a class."""
    n = F.size("seq")
    head = F.slice("seq", 1, n - F.floor((n * 4 + 4) / 5).cast("int") + 1)
    same = [F.xxhash64(F.lit(k), "seq").alias(f"c{k}") for k in (0, 1)]
    every = materialize(seqs.select(F.col(key).alias("id"), *keep, n.cast("int").alias("size"), _fold(F.col("seq"), 0).alias("f0"), _fold(F.col("seq"), 1).alias("f1"), head.alias("head"), *same))
    by = ["c0", "c1", *keep]
    firsts = materialize(every.groupBy(*by).agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "f0", "f1", "head")], F.count(F.lit(1)).alias("n")))
    several = firsts.where("n > 1").select(*by, F.col("id").alias("first"))
    copies = materialize(every.select("id", *by).join(several, by).where("id <> first").select("id", "first").distinct())
    release(every)
    return firsts.drop("c0", "c1", "n"), copies


def roots(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record and each of its first words: (root, id, size, short, f0, f1, *keep); short marks the first of them, by which a record is found by larger ones."""
    out = records.select("id", *keep, "size", "f0", "f1", F.posexplode("head").alias("at", "root"))
    return out.select("root", "id", *keep, "size", (F.col("at") <= F.col("size") - F.floor((F.col("size") * 8 + 8) / 9)).alias("short"), "f0", "f1")


def _distance(f0: Column, f1: Column, g0: Column, g1: Column) -> Column:
    return (F.bit_count(f0.bitwiseXOR(g0)) + F.bit_count(f1.bitwiseXOR(g1))).cast("int")


def grow(rooted: DataFrame, leaf: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(homes, visits): rows of rooted with the leaf (node) they live in, and with each leaf that is open to them, of their root's tree.

    Only the short rows live in leaves; all rows visit. A node that its vantage point doesn't part (all others are equally far) is a leaf.
    The levels of a tree are as many as the logarithm of its records, so that a root of any size needs no task of its own.
    """
    leaf = LEAF if leaf is None else leaf
    homes, visits = (rooted.where("short").withColumn("node", F.lit(1).cast("long")), rooted.withColumn("node", F.lit(1).cast("long")))
    done_homes, done_visits = [], []
    while True:
        full = homes.groupBy("root", "node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", "id"), "f0", "f1")).alias("p")).where(F.col("n") > leaf).select("root", "node", F.col("p.f0").alias("p0"), F.col("p.f1").alias("p1"))
        full = materialize(full)
        measured = lambda d, how="inner": d.join(full, ["root", "node"], how)  # noqa: B023, E731
        done_homes.append(measured(homes, "left_anti"))
        done_visits.append(measured(visits, "left_anti"))
        if full.isEmpty():
            break
        v = _distance(F.col("f0"), F.col("f1"), F.col("p0"), F.col("p1"))
        h = materialize(measured(homes).withColumn("v", v).drop("p0", "p1"))
        middle = h.groupBy("root", "node").agg(F.percentile_approx("v", 0.5).alias("m"), F.max("v").alias("most"), F.min("v").alias("least"))
        # the inner side takes distances up to the border, which must leave something outside
        middle = materialize(middle.select("root", "node", F.when(F.col("m") < F.col("most"), F.col("m")).when(F.col("least") < F.col("most"), F.col("most") - 1).alias("border")))
        stuck = F.col("border").isNull()
        h = h.join(middle, ["root", "node"])
        done_homes.append(h.where(stuck).drop("border", "v"))
        inner = F.col("node") * 2
        homes = materialize(h.where(~stuck).withColumn("node", F.when(F.col("v") <= F.col("border"), inner).otherwise(inner + 1)).drop("border", "v"))
        w = measured(visits).withColumn("v", v).join(middle, ["root", "node"])
        done_visits.append(w.where(stuck).drop("border", "v", "p0", "p1"))
        radius = F.floor(F.col("size") * 2 / 9)
        sides = F.filter(F.array(F.when(F.col("v") - radius <= F.col("border"), inner), F.when(F.col("v") + radius > F.col("border"), inner + 1)), lambda x: x.isNotNull())
        visits = materialize(w.where(~stuck).withColumn("node", F.explode(sides)).drop("border", "v", "p0", "p1"))
    one = lambda parts: parts[0] if len(parts) == 1 else one(parts[:-1]).unionByName(parts[-1])
    return one(done_homes), one(done_visits)


def candidates(records: DataFrame, side: str | None = None) -> DataFrame:
    """(a, b), a < b: pairs of records that share a root and a leaf and whose fingerprints are within the bound.

    side: a boolean column of records; only records of different sides are paired, and roots with one side only are left out at once.
    """
    keep = (side,) if side else ()
    rooted = roots(records, keep)
    enough = F.count(F.lit(1)) > 1 if side is None else (F.max(side) != F.min(side))
    shared = rooted.groupBy("root").agg(enough.alias("ok")).where("ok").select("root")  # combined before the shuffle; a hot root is one row
    homes, visits = grow(materialize(rooted.join(shared, "root")))
    cols = ("id", "size", "f0", "f1")
    x = homes.select("root", "node", *[F.col(c).alias(f"x_{c}") for c in cols], *([F.col(side).alias("side")] if side else []))
    y = visits.select("root", "node", *[F.col(c).alias(f"y_{c}") for c in cols], *([(~F.col(side)).alias("side")] if side else []))
    bound = F.floor((F.col("x_size") + F.col("y_size")) / 9)
    near = (
        (F.col("x_id") != F.col("y_id"))
        & (F.col("x_size") <= F.col("y_size"))
        & ((F.col("x_size") < F.col("y_size")) | (F.col("x_id") < F.col("y_id")))
        & (F.col("x_size") * 5 >= F.col("y_size") * 4)
        & (_distance(*[F.col(c) for c in ("x_f0", "x_f1", "y_f0", "y_f1")]) <= bound)
    )
    found = x.join(y, ["root", "node", *(["side"] if side else [])]).where(near)
    return found.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def exact(pairs: DataFrame, records: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Of (a, b) those whose words are near, with the exact counts: (a, b, shared, total, size_a, size_b)."""
    ends = pairs.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias(key), F.lit(True).alias("first")), F.struct(F.col("b").alias(key), F.lit(False).alias("first")))))
    told = ends.join(records.select(key, *texts), key).select("a", "b", "first", words(*map(F.col, texts)).alias("w"))
    both = told.groupBy("a", "b").agg(F.max(F.when(F.col("first"), F.col("w"))).alias("wa"), F.max(F.when(~F.col("first"), F.col("w"))).alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", shared.alias("shared"), (F.size("wa") + F.size("wb") - shared).alias("total"), F.size("wa").alias("size_a"), F.size("wb").alias("size_b")).where("total > 0 and shared * 5 >= total * 4")


def members(copies: DataFrame, ends: DataFrame) -> DataFrame:
    """(first, id): the classes of the firsts in ends, each first itself and its copies."""
    own = ends.select("first").distinct()
    return own.withColumn("id", F.col("first")).unionByName(copies.join(own, "first", "left_semi").select("first", "id"))


def spread_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of firsts as pairs of all members of their classes; the other columns stay."""
    if copies.isEmpty():
        return pairs
    m = members(copies, pairs.select(F.col("a").alias("first")).unionByName(pairs.select(F.col("b").alias("first"))))
    for c in ("a", "b"):
        pairs = pairs.join(m.select(F.col("first").alias(c), F.col("id").alias(f"{c}_")), c)
    return pairs.drop("a", "b").withColumnsRenamed({"a_": "a", "b_": "b"})


ITEM_TEXTS = ["img_path", "mask_path"]


def _found(items: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs of firsts with their counts, copies); what led to them is deleted."""
    r = items.select(key, *texts)
    with scope(items.sparkSession) as keep:
        records, copies = classed(sequences(r, key, texts), key)
        return keep(materialize(exact(candidates(records), r, key, texts))), keep(copies)


def near_names(items: DataFrame, key: str = "item_id", texts: list[str] | None = None) -> DataFrame:
    """(item_a, item_b), item_a < item_b: the pairs of records that share at least 0.8 of all their different words.

    A NULL or wordless text adds no words; a record without words is in no pair. Repeated rows of a key count once. Texts may
    be of any length. Columns other than key and texts are not read. Records of equal words are compared as one; all pairs come out at
    the end, also those of equal records (near_name_groups does without).
    """
    pairs, copies = _found(items, key, texts or ITEM_TEXTS)
    every = spread_pairs(pairs.select("a", "b"), copies).select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
    m = members(copies, copies)
    alike = m.withColumnRenamed("id", "item_a").join(m.withColumnRenamed("id", "item_b"), "first").where("item_a < item_b").select("item_a", "item_b")
    return every.unionByName(alike)


def near_name_groups(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(item_id, group_id): for each record in a pair of near_names, the smallest key linked with it over any number of pairs; equal records are linked by their first."""
    from scarpline.llm.components import components

    pairs, copies = _found(items, key, ITEM_TEXTS)
    links = materialize(pairs.select("a", "b").unionByName(copies.select(F.col("first").alias("a"), F.col("id").alias("b"))))
    out = components(links, "a", "b").select(F.col("node").alias(key), F.col("seed").alias("group_id"))
    release(links)
    return out
