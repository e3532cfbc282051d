"""Splits that keep related records together.

Records and the entities they share form a bipartite graph; the smallest label spreads over it until no label changes. Groups then go
to splits, larger ones first, each to the split where the counts of labels and the sizes come closest to what is wanted: groups with the
same labels are of one profile and are shared out together. Single records come last, in exact numbers for each label and split, so that
what the groups left uneven is made up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scarpline.llm.components import LINK_BITS
from scarpline.session import materialize, release

#: Fixed: the wanted shares.
SHARES = {"train": 230, "validation": 35, "test": 10}
#: The STRATA most frequent labels have sums of their own on the driver; all others are spread along one line, a label after the other.
STRATA = 500
#: Profiles of groups that are placed by their deviation, those with most records; groups of rarer ones are shared out along a hash.
PROFILES = 20_000
_SLOTS = 1024


def propagate(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(entity, label) from a record-entity table (record, entity): entities that records link, directly or over others, get the same, smallest label.

    Records with the same entities are one record here; NULLs link nothing. A hub or a record with very many entities is safe.
    """
    e = edges.where("record is not null and entity is not null").select("record", "entity")
    star = materialize(e.join(e.groupBy("record").agg(F.min("entity").alias("first")), "record").select(F.col("entity").alias("u"), F.col("first").alias("v")).distinct())
    return spread_labels(star, max_rounds)


def spread_labels(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(entity, label) from records of two entities each (u, v; equal ones stand for an entity alone); label is the smallest entity linked.

    In each round an entity takes the least label among its records, in an order that is new in each round, so that chains of any order
    shrink by a constant part. Records then link labels instead of entities, and those that link a label with itself are done. The labels
    of all rounds are put together at the end.
    """
    ends = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("entity")), F.struct(F.col("v").alias("entity"))))).distinct()
    left, maps = pairs.where("u <> v"), []
    while not left.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = left.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        low = materialize(low.select(F.col("u").alias("entity"), F.least(order("u"), "m")["x"].alias("label")))
        name = lambda c: low.select(F.col("entity").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        after = left.join(name("u"), "u").join(name("v"), "v").where("u_label <> v_label")
        after = materialize(after.select(F.least("u_label", "v_label").alias("u"), F.greatest("u_label", "v_label").alias("v")).distinct())
        if maps:
            release(left)
        maps.append(low)
        left = after
    if not maps:
        return ends.withColumn("label", F.col("entity"))
    found = ends.withColumn("last", F.col("entity"))
    for low in maps:
        found = found.join(low.select(F.col("entity").alias("last"), F.col("label").alias("next")), "last", "left").select("entity", F.coalesce("next", "last").alias("last"))
    found = materialize(found)
    release(left, *maps)
    return found.join(found.groupBy("last").agg(F.min("entity").alias("label")), "last").select("entity", "label")


def _wanted(n: int, shares: dict[str, int]) -> np.ndarray:
    """n in whole numbers, as near to the shares as can be (largest remainders)."""
    f = np.array(list(shares.values()), dtype=float) * n / sum(shares.values())
    out = np.floor(f).astype(np.int64)
    for k in np.argsort(-(f - out), kind="stable")[: n - out.sum()]:
        out[k] += 1
    return out


def _rounded(table: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A table of whole numbers with these sums of rows and columns, near to the given one (iterative proportional fitting, then moves by remainder)."""
    t = np.maximum(table.astype(float), 1e-9)
    for _ in range(200):
        t *= (rows / np.maximum(t.sum(1), 1e-12))[:, None]
        t *= cols / np.maximum(t.sum(0), 1e-12)
    out = np.floor(t).astype(np.int64)
    need_r, need_c = rows - out.sum(1), cols - out.sum(0)
    for i in range(len(rows)):
        while need_r[i] > 0:
            k = max(range(len(cols)), key=lambda j: (need_c[j] > 0, t[i, j] - out[i, j]))
            out[i, k] += 1
            need_r[i] -= 1
            need_c[k] -= 1
        while need_r[i] < 0:
            k = max(range(len(cols)), key=lambda j: (out[i, j] > 0, out[i, j] - t[i, j]))
            out[i, k] -= 1
            need_r[i] += 1
            need_c[k] += 1
    for k in range(len(cols)):
        while need_c[k] > 0:  # some other column has as many too many
            j = int(np.argmin(need_c))
            i = int(np.argmax(np.where(out[:, j] > 0, t[:, k] - out[:, k], -np.inf)))
            out[i, j] -= 1
            out[i, k] += 1
            need_c[j] += 1
            need_c[k] -= 1
    return out


def place_profiles(profiles: list[tuple[dict[int, int], int]], want: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """How many groups of each profile (records of each stratum, number of groups) go to each split, and what that gives (stratum x split).

    Larger groups first; of many with one profile a thirty-second of those left at a time, each time to the split where the squared
    deviation of labels and sizes, relative to what is wanted, grows least.
    """
    have, out = np.zeros_like(want, dtype=float), [np.zeros(want.shape[1], np.int64) for _ in profiles]
    total = want.sum(0)
    for p in sorted(range(len(profiles)), key=lambda k: (-sum(profiles[k][0].values()), sorted(profiles[k][0].items()))):
        labels, left = profiles[p]
        rows, v = np.array(list(labels), dtype=np.int64), np.array(list(labels.values()), dtype=float)
        while left:
            n = max(1, left // 32)
            add, size = v * n, v.sum() * n
            sums = have.sum(0)
            over = np.maximum(0.0, sums + size - total)
            h, w = have[rows], want[rows]
            part = (((h + add[:, None] - w) ** 2 - (h - w) ** 2) / np.maximum(w, 1)).sum(0)
            whole = ((sums + size - total) ** 2 - (sums - total) ** 2) / np.maximum(total, 1)
            s = min(range(len(total)), key=lambda k: (over[k], part[k] + whole[k], k))
            out[p][s] += n
            have[rows, s] += add
            left -= n
    return out, have


def _along(df: DataFrame, by: str, size: Column, slot: Column, order: list[Column | str]) -> DataFrame:
    """df with at, the sum of sizes before this row in its by; ranked within slots, so that no task sorts a whole by."""
    d = df.withColumn("slot", slot).withColumn("weight", size)
    before = d.groupBy(by, "slot").agg(F.sum("weight").alias("all"))
    before = before.withColumn("base", F.coalesce(F.sum("all").over(W.partitionBy(by).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")
    inside = F.coalesce(F.sum("weight").over(W.partitionBy(by, "slot").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(before, [by, "slot"]).withColumn("at", F.col("base") + F.col("inside")).drop("slot", "weight", "inside", "base")


def _turn(at: Column, quota: Column, n: int) -> Column:
    """The split of place at in a line where the splits take turns in proportion to their quota, each exactly as often as it says."""
    pick, left, size = F.lit(n - 1), at, sum((quota[k] for k in range(1, n)), quota[0])
    steps = []
    for k in range(n - 1):
        rest = sum((quota[j] for j in range(k + 2, n)), quota[k + 1])
        now = F.floor(left * rest / F.greatest(size, F.lit(1)))
        steps.append(F.floor((left + 1) * rest / F.greatest(size, F.lit(1))) == now)  # not a turn of the later ones
        left, size = now, rest
    for k in reversed(range(n - 1)):
        pick = F.when(steps[k], F.lit(k)).otherwise(pick)
    return pick


def group_splits(members: DataFrame, shares: dict[str, int] | None = None) -> DataFrame:
    """(group_id, new_split) for each group of members (group_id BIGINT, label STRING, one row a record).

    Groups are never divided. Sizes of splits come as near to the shares as the groups allow: exactly, when there are single
    records enough to make up for the others. Labels are spread alike over the splits, any number of them; a NULL label is a label. What
    comes to the driver is bounded: sums of at most STRATA + 1 strata, and at most PROFILES profiles of groups.
    """
    shares = shares or SHARES
    names = list(shares)
    spark = members.sparkSession
    counts = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "label").limit(STRATA).collect()
    strata = spark.createDataFrame([(r["label"] or "", r["label"] is None, k) for k, r in enumerate(top)], "l string, none boolean, stratum int")
    m = members.select("group_id", F.coalesce("label", F.lit("")).alias("l"), F.col("label").isNull().alias("none"))
    m = m.join(F.broadcast(strata), ["l", "none"], "left").select("group_id", "l", F.coalesce("stratum", F.lit(len(top))).alias("stratum"))  # at most STRATA rows
    by = m.groupBy("group_id", "stratum").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("l"))
    profile = F.array_sort(F.collect_list(F.struct("stratum", "n")))  # at most STRATA + 1 of them
    groups = materialize(by.groupBy("group_id").agg(F.sum("n").alias("size"), profile.alias("profile"), F.min("l").alias("l")))
    sizes, singles = np.zeros(len(top) + 1, np.int64), np.zeros(len(top) + 1, np.int64)
    each = groups.select("size", F.inline("profile")).groupBy("stratum").agg(F.sum("n").alias("n"), F.count_if(F.col("size") == 1).alias("one"))
    for k, n, one in each.collect():
        sizes[k], singles[k] = n, one
    want = np.array([_wanted(int(n), shares) for n in sizes], dtype=float).reshape(len(sizes), len(names))
    goal = _wanted(int(sizes.sum()), shares)

    many = groups.where("size > 1").withColumn("p", F.xxhash64("profile"))
    kinds = many.groupBy("profile", "p", "size").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc(F.col("size") * F.col("m")), "p").limit(PROFILES).collect()
    out, have = place_profiles([({x["stratum"]: x["n"] for x in r["profile"]}, r["m"]) for r in kinds], want)
    table = spark.createDataFrame([(r["profile"], [int(x) for x in np.cumsum(o)]) for r, o in zip(kinds, out)], "profile array<struct<stratum:int,n:bigint>>, upto array<bigint>")
    mixed = F.xxhash64(F.lit(1), "group_id")
    slot = F.pmod(F.xxhash64("group_id"), F.lit(_SLOTS)).cast("int")
    known = many.join(F.broadcast(table), "profile")  # at most PROFILES rows
    ranked = _along(known, "p", F.lit(1), slot, [mixed, "group_id"])
    pick = F.lit(len(names) - 1)
    for k in reversed(range(len(names) - 1)):
        pick = F.when(F.col("at") < F.col("upto")[k], F.lit(k)).otherwise(pick)
    placed = ranked.select("group_id", pick.alias("s"))
    if len(kinds) == PROFILES:  # the others in turns along a hash
        rest = _along(many.join(F.broadcast(table), "profile", "left_anti").withColumn("one", F.lit(0)), "one", F.col("size"), slot, [mixed, "group_id"])
        line = F.array(*[F.lit(int(x)) for x in shares.values()])
        rest = materialize(rest.select("group_id", "profile", _turn(F.floor(F.col("at") + F.col("size") / 2), line, len(names)).alias("s")))
        for k, s, n in rest.select("s", F.inline("profile")).groupBy("stratum", "s").agg(F.sum("n")).collect():
            have[k, s] += n
        placed = placed.unionByName(rest.select("group_id", "s"))

    cols = np.maximum(goal - have.sum(0), 0)
    if cols.sum() > 0 and singles.sum() > 0:
        cols = _wanted(int(singles.sum()), {str(j): x for j, x in enumerate(cols)})
        quota = _rounded(np.maximum(want - have, 0), singles, cols)
    else:
        quota = np.array([_wanted(int(n), shares) for n in singles]).reshape(len(sizes), len(names))
    quotas = spark.createDataFrame([(k, [int(x) for x in q]) for k, q in enumerate(quota)], "stratum int, quota array<bigint>")
    single = groups.where("size = 1").select("group_id", "l", F.col("profile")[0]["stratum"].alias("stratum"))
    beyond = F.col("stratum") == len(top)
    slot = F.when(beyond, F.pmod(F.xxhash64("l"), F.lit(_SLOTS)).cast("int")).otherwise(slot)
    line = _along(single, "stratum", F.lit(1), slot, [F.when(beyond, F.col("l")), mixed, "group_id"])
    one = line.join(F.broadcast(quotas), "stratum").select("group_id", _turn(F.col("at"), F.col("quota"), len(names)).alias("s"))  # at most STRATA + 1 rows
    return placed.unionByName(one).select("group_id", F.element_at(F.array(*map(F.lit, names)), F.col("s") + 1).alias("new_split"))


def keep_together(items: DataFrame, dup_groups: DataFrame, shares: dict[str, int] | None = None) -> DataFrame:
    """(item_id, group_id, new_split, old_split) for every item, counted once: items that share a non-NULL source_scene or a group of matched img_paths are in one split.

    group_id is the same for all records that have to stay together; an item without scene and match is a group of its own. Entities are
    64-bit hashes of scenes and paths; two with one hash would only keep more together. Labels to spread alike are the datasets. Empty
    tables give an empty table; an item whose rows differ counts with its smallest values.
    """
    scene, path = (lambda c, k=k: F.xxhash64(F.lit(k), F.col(c)) for k in ("scene", "path"))
    match = dup_groups.where((F.col("hamming") <= LINK_BITS) & (F.col("img_path") != F.col("neighbour_path"))).select(path("img_path").alias("u"), path("neighbour_path").alias("v")).distinct()
    matched = match.select(F.inline(F.array(F.struct(F.col("u").alias("path")), F.struct(F.col("v").alias("path"))))).distinct()
    one = items.groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("dataset", "old_split", "source_scene", "img_path")])
    one = one.select("item_id", "dataset", "old_split", F.when(F.col("source_scene").isNotNull(), scene("source_scene")).alias("scene"), F.when(F.col("img_path").isNotNull(), path("img_path")).alias("path"))
    one = materialize(one.join(matched.withColumn("match", F.col("path")), "path", "left").drop("path"))
    both = one.where("scene is not null and match is not null").select(F.col("scene").alias("u"), F.col("match").alias("v")).distinct()
    labels = spread_labels(materialize(match.unionByName(both)))
    entity = F.coalesce("match", "scene", F.xxhash64(F.lit("item"), "item_id"))
    found = one.withColumn("entity", entity).join(labels, "entity", "left")
    grouped = materialize(found.select("item_id", "old_split", "dataset", F.coalesce("label", "entity").alias("group_id")))
    release(one)
    placed = group_splits(grouped.select("group_id", F.col("dataset").alias("label")), shares)
    return grouped.join(placed, "group_id").select("item_id", "group_id", "new_split", "old_split")


def torn_apart(items: DataFrame, groups: DataFrame, splits: DataFrame) -> DataFrame:
    """(kind, entity, splits): scenes and groups of matched paths (img_path, group_path) whose items are in more than one split (item_id, new_split); none, if all is well."""
    one = items.groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("source_scene", "img_path")]).join(splits.select("item_id", "new_split"), "item_id")
    by_scene = one.where("source_scene is not null").select(F.lit("scene").alias("kind"), F.col("source_scene").alias("entity"), "new_split")
    by_group = one.join(groups, "img_path").select(F.lit("group").alias("kind"), F.col("group_path").alias("entity"), "new_split")
    return by_scene.unionByName(by_group).groupBy("kind", "entity").agg(F.countDistinct("new_split").alias("splits")).where("splits > 1")
