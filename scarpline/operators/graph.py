"""Groups of linked nodes, and walks along a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scarpline.session import materialize, release


def linked_groups(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, label): for each end of an edge, the smallest node linked with it.

    Each round a node joins the neighbour, or itself, that comes first in an order that is new in each round; edges then link what was
    joined, and those inside one are done, so that the table shrinks by a constant part. Loops are kept as groups of one; NULL ends are
    left out; repeated and reversed edges add nothing.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    first = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    found = first.select(F.inline(F.array(F.struct(F.col("u").alias("node")), F.struct(F.col("v").alias("node"))))).distinct().withColumn("last", F.col("node"))
    left, maps = first.where("u <> v"), []
    while not left.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = left.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        low = materialize(low.select(F.col("u").alias("node"), F.least(order("u"), "m")["x"].alias("into")))
        into = lambda c: low.select(F.col("node").alias(c), F.col("into").alias(f"{c}_into"))  # noqa: B023, E731
        after = left.join(into("u"), "u").join(into("v"), "v").where("u_into <> v_into")
        after = materialize(after.select(F.least("u_into", "v_into").alias("u"), F.greatest("u_into", "v_into").alias("v")).distinct())
        if maps:
            release(left)
        maps.append(low)
        left = after
    for low in maps:
        found = found.join(low.select(F.col("node").alias("last"), "into"), "last", "left").select("node", F.coalesce("into", "last").alias("last"))
    found = materialize(found)
    release(first, *maps)
    return found.join(found.groupBy("last").agg(F.min("node").alias("label")), "last").select("node", "label")


def walk(starts: DataFrame, edges: DataFrame, key: str, node: str, limit: float, max_doublings: int = 40) -> DataFrame:
    """(key, seq, node, dist): the nodes on the only way from each start, up to and with the first at or beyond limit.

    edges (src, dst, dist): at most one from each node; if there are more, the smallest dst counts. Steps are doubled: after k joins
    every way is known for 2^k steps. A way ends at a node without an edge, and before a node it was at already: as many steps as there
    are edges reach all of a way, so that no way is cut; the limit of doublings is an error.
    """
    e = edges.where("src is not null and dst is not null").groupBy("src").agg(F.min(F.struct("dst", "dist")).alias("e")).select("src", "e.dst", "e.dist")
    jump = materialize(e)
    n_edges = jump.count()
    rows = materialize(starts.where(F.col(node).isNotNull()).select(key, F.lit(0).alias("seq"), F.col(node).alias("node"), F.lit(0.0).alias("dist")))
    for k in range(max_doublings):
        on = rows.where(F.col("dist") < limit).join(jump.select(F.col("src").alias("node"), "dst", F.col("dist").alias("d")), "node")
        more = materialize(on.select(key, (F.col("seq") + (1 << k)).alias("seq"), F.col("dst").alias("node"), (F.col("dist") + F.col("d")).alias("dist")))
        if more.isEmpty():
            release(more, jump)
            break
        rows = rows.unionByName(more)
        if 1 << (k + 1) > n_edges:  # only rounds go on; they come back to nodes they were at
            break
        j2 = jump.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("dist").alias("d2"))
        after = materialize(jump.where(F.col("dist") < limit).join(j2, "dst").select("src", F.col("end").alias("dst"), (F.col("dist") + F.col("d2")).alias("dist")))
        release(jump)
        jump = after
    else:
        raise RuntimeError(f"no end after {max_doublings} doublings")
    first = rows.withColumn("again", F.row_number().over(W.partitionBy(key, "node").orderBy("seq"))).where("again = 1").drop("again")
    before = F.lag("dist").over(W.partitionBy(key).orderBy("seq"))
    return first.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") < limit)).drop("before")


def is_acyclic(edges: DataFrame, max_doublings: int = 40) -> bool:
    """Whether every way along edges (src, dst), at most one from each node, ends: no node is left after doubling steps beyond their number."""
    jump = materialize(edges.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst")))
    n = jump.count()
    steps = 1
    for _ in range(max_doublings):
        if jump.isEmpty():
            return True
        if steps > n:
            return False
        j2 = jump.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        after = materialize(jump.join(j2, "dst").select("src", F.col("end").alias("dst")))
        release(jump)
        jump, steps = after, steps * 2
    return jump.isEmpty()
