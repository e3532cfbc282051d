"""Image-dataset hygiene: pairing files, near-duplicate hashes, leakage, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scarpline import constants as C
from scarpline.operators.graph import linked_groups
from scarpline.session import materialize


def paired(images: DataFrame, masks: DataFrame, image_key: Column, mask_key: Column, by: list[str] | None = None) -> DataFrame:
    """images (path) with mask_path where a mask has the same key; images without a mask are left out."""
    by = by or []
    i = images.withColumn("_key", image_key)
    m = masks.select(*by, mask_key.alias("_key"), F.col("path").alias("mask_path"))
    return i.join(m, [*by, "_key"]).drop("_key")


def hash_blocks(limit: int) -> list[tuple[int, int]]:
    """(first bit, width) of blocks of a 64-bit hash, of which one has at most one differing bit where two hashes differ in at most limit bits."""
    n = limit // 2 + 1
    edges = [round(64 * j / n) for j in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys(at: int, width: int, k: int, spread: bool) -> Column:
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    b = F.shiftrightunsigned("h", at).bitwiseAND(mask)
    keys = F.array(b)
    if spread:
        flip = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        keys = F.concat(keys, F.transform(flip, lambda bit: b.bitwiseXOR(bit)))
    return F.transform(keys, lambda x: F.struct(F.call_function("shiftleft", x, F.lit(6)).bitwiseOR(F.lit(k).cast("long")).alias("block")))


def _blocks(hashes: DataFrame, limit: int, spread: bool) -> DataFrame:
    """(h, block): the value and number of each block, with spread also each value that differs from it in one bit."""
    return hashes.select("h", F.inline(F.concat(*[_keys(a, w, k, spread) for k, (a, w) in enumerate(hash_blocks(limit))])))


def near_hashes(left: DataFrame, right: DataFrame, limit: int = C.HASH_BITS, ordered: bool = False) -> DataFrame:
    """(g, h): the pairs of a hash of left and one of right (columns h, BIGINT, NULLs left out) that differ in at most limit bits; ordered: those with g <= h only.

    Repeated hashes count once. Each hash of left looks its blocks up with up to one bit changed, so that rows grow as the tables and
    not as their product; the smaller table is better left.
    """
    assert 0 <= limit < 64
    few = _blocks(left.where("h is not null").select("h").distinct(), limit, limit > 0).withColumnRenamed("h", "g")
    many = _blocks(right.where("h is not null").select("h").distinct(), limit, False)
    near = F.bit_count(F.col("g").bitwiseXOR(F.col("h"))) <= limit
    return few.join(many, "block").where(near & (F.col("g") <= F.col("h")) if ordered else near).select("g", "h").distinct()


def hash_pairs(items: DataFrame, key: str, hash_: str, limit: int = C.HASH_BITS, keep: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """(a, b, distance, *a_keep, *b_keep), a < b: items whose hashes differ in at most limit bits; NULL hashes match nothing.

    Different hashes are compared once, in one order, and spread to their items at the end; where is a condition on a_ and b_ columns of keep.
    """
    d = items.where(F.col(hash_).isNotNull()).select(key, F.col(hash_).alias("h"), *keep).distinct()
    close = near_hashes(d, d, limit, ordered=True)
    side = lambda p, h: d.select(F.struct(F.col(key).alias("id"), *keep).alias(p), F.col("h").alias(h))
    j = close.join(side("x", "g"), "g").join(side("y", "h"), "h").where((F.col("g") != F.col("h")) | (F.col("x.id") < F.col("y.id")))
    first = F.col("x.id") < F.col("y.id")
    j = j.where(F.col("x.id") != F.col("y.id")).select("g", "h", F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"))
    j = j.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *[F.col(f"{s}.{c}").alias(f"{p}_{c}") for s, p in (("x", "a"), ("y", "b")) for c in keep], F.bit_count(F.col("g").bitwiseXOR(F.col("h"))).cast("int").alias("distance"))
    return j if where is None else j.where(where)


def duplicate_groups(pairs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, group_id) of every item: the smallest item linked with it; an item in no pair is a group of its own."""
    g = linked_groups(pairs, "a", "b").select(F.col("node").alias(key), F.col("label").alias("group_id"))
    return items.select(key).distinct().join(g, key, "left").withColumn("group_id", F.coalesce("group_id", key))


def group_summary(groups: DataFrame) -> DataFrame:
    """(n_groups, n_multi, largest) of (key, group_id)."""
    size = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return size.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi"), F.max("n").alias("largest"))


def greedy_split(groups: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """(group_id, size, split): groups, larger ones first and then by id, each to the split farthest below its share of what is assigned; ties in the order of targets.

    Only the number of groups of each size comes to the driver; the order within a size is by group_id. Among groups of one size the
    choice repeats itself once the shortfalls do, so that a million groups take no more steps than some hundreds.
    """
    targets = targets or C.SPLIT_TARGETS
    names, total = list(targets), sum(targets.values())
    sized = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    have, assigned, table = [0] * len(names), 0, []
    for size, n in sorted(((r["size"], r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        seen: dict[tuple[int, ...], int] = {}
        chosen: list[int] = []
        start, period = n, 1
        while len(chosen) < n:
            short = tuple(t * assigned - total * h for t, h in zip(targets.values(), have)) if assigned else tuple(targets.values())
            if assigned and short in seen:
                start, period = seen[short], len(chosen) - seen[short]
                turn = chosen[start:]
                rounds, rest = divmod(n - len(chosen), period)
                for k, s in enumerate(turn):
                    have[s] += size * (rounds + (k < rest))
                assigned += size * (n - len(chosen))
                break
            seen[short] = len(chosen)
            s = max(range(len(names)), key=lambda k: short[k])
            chosen.append(s)
            have[s] += size
            assigned += size
        table += [(size, k, start, period, names[s]) for k, s in enumerate(chosen)]
    steps = groups.sparkSession.createDataFrame(table, "size long, step int, start int, period int, split string")
    turns = steps.select("size", "start", "period").distinct()
    # groups are ranked within ranges, so that no task sorts all groups of a size; the table keeps the ranges as they were cut
    cut = materialize(sized.repartitionByRange("size", "group_id").withColumn("part", F.spark_partition_id()))
    before = cut.groupBy("size", "part").agg(F.count(F.lit(1)).alias("own"))
    before = before.select("size", "part", F.coalesce(F.sum("own").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = cut.withColumn("n", F.row_number().over(W.partitionBy("size", "part").orderBy("group_id")) - 1).join(before, ["size", "part"])
    ranked = ranked.withColumn("n", F.col("n") + F.col("base")).drop("base", "part").join(turns, "size")
    step = F.when(F.col("n") < F.col("start"), F.col("n")).otherwise(F.col("start") + (F.col("n") - F.col("start")) % F.col("period")).cast("int")
    return ranked.withColumn("step", step).join(steps.select("size", "step", "split"), ["size", "step"]).select("group_id", "size", "split")


def stratified_sample(items: DataFrame, key: str, stratum: str, order: Column, total: int = C.AUDIT_SAMPLE, last: str | None = None) -> DataFrame:
    """total items: of each stratum its rounded share, of the last the rest, none more than there is; within a stratum the first by order, then key.

    last: the stratum that takes the rest, by default the greatest.
    """
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    every = W.partitionBy()
    q = sizes.withColumn("_last", F.col(stratum) == (F.lit(last) if last else F.max(stratum).over(every)))
    share = F.least(F.bround(F.lit(total) * F.col("_size") / F.sum("_size").over(every)).cast("long"), F.col("_size"))
    q = q.withColumn("_share", F.when(F.col("_last"), 0).otherwise(share))
    q = q.withColumn("_quota", F.when(F.col("_last"), F.least(F.greatest(F.lit(total) - F.sum("_share").over(every), F.lit(0)), F.col("_size"))).otherwise(F.col("_share")))
    n = F.row_number().over(W.partitionBy(stratum).orderBy(order, key))
    first = items.withColumn("_n", n).where(F.col("_n") <= total)  # a fixed number, which each task keeps to before the shuffle
    return first.join(q.select(stratum, "_quota"), stratum).where("_n <= _quota").drop("_n", "_quota")


def sample_each(items: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """n items of each stratum, or all where there are fewer: the first by a hash of the key and the seed, which is random but the same in every run."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return items.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def tagged_union(pools: dict[str, DataFrame], tag: str = "pool") -> DataFrame:
    """The rows of all pools, one after the other, with the name of their pool; columns that a pool lacks are NULL."""
    out = None
    for name, d in pools.items():
        d = d.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise ValueError("no pools")
    return out


def flattened(by_split: DataFrame, split: str = "split", members: str = "items") -> DataFrame:
    """(split, item) of one row a split with the array or map of its items; of a map, the keys. An empty split has no rows."""
    m = F.col(members)
    if by_split.schema[members].dataType.typeName() == "map":
        m = F.map_keys(m)
    return by_split.select(split, F.explode(m).alias("item"))


def new_names(items: DataFrame, old_split: str, stem: str) -> DataFrame:
    """items with new_name, the stem behind its old split, and unique, whether no other item gets that name."""
    d = items.withColumn("new_name", F.concat(F.col(old_split), F.lit("_"), F.regexp_replace(stem, "^image_", "")))
    return d.withColumn("unique", F.count(F.lit(1)).over(W.partitionBy("new_name")) == 1)


def split_stats(labels: DataFrame, split: str = "split", lines: str = "lines") -> DataFrame:
    """(split, images, instances, empty): of one row an image with its number of label lines."""
    return labels.groupBy(split).agg(F.count(F.lit(1)).alias("images"), F.sum(lines).alias("instances"), F.count_if(F.col(lines) == 0).alias("empty"))
