"""Groups from pairwise matches: seed-tree pruning.

Every vertex of a graph proposes its smallest neighbour to its whole neighbourhood; a vertex that nobody calls the smallest
leaves the graph and hangs itself under the smallest proposal it got. The rest goes on with edges between the proposals only.
The forest of those that left has at most one level a round, so that pointer doubling brings the seed to every vertex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.session import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, seed) for each end of an edge, seed being the smallest node linked with it directly or indirectly.

    edges: two columns of one orderable type. Loops, NULLs, repeated and reversed edges add nothing; an empty table gives an
    empty table. Other columns are ignored. Hubs are safe: each step is an aggregate with map-side combine or an equi-join
    that AQE can split; no neighbourhood is ever collected.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    graph = materialize(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    first, trees, rounds = graph, [], 0
    while not graph.isEmpty():
        if rounds >= max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        proposals = materialize(both.join(low, "u").select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m")).distinct())
        best = proposals.groupBy("v").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("v")).alias("stays"))
        trees.append(materialize(best.where("not stays").select(F.col("v").alias("node"), F.col("best").alias("up"))))
        after = materialize(proposals.join(best.select("v", "best"), "v").where("m <> best").select(F.col("best").alias("u"), F.col("m").alias("v")).distinct())
        release(proposals, *([graph] if graph is not first else []))
        graph, rounds = after, rounds + 1
    ends = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    if not trees:
        return ends.withColumn("seed", F.col("node"))
    forest = trees[0]
    for t in trees[1:]:
        forest = forest.unionByName(t)
    for _ in range(math.ceil(math.log2(max(rounds, 2)))):
        jump = forest.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        nxt = materialize(forest.join(jump, "up", "left").select("node", F.coalesce("upper", "up").alias("up")))
        release(forest, *trees)
        forest = nxt
    return ends.join(forest, "node", "left").select("node", F.coalesce("up", "node").alias("seed"))


def consolidate(pairs: DataFrame, a: str, b: str, matched: Column | None = None) -> DataFrame:
    """(path, group_path): for each text in a group of two or more, the smallest text of its group in byte order.

    pairs: columns a and b hold texts; matched says which rows count (NULL counts as no). The rounds work on 64-bit ids of
    the texts; ids are checked for collisions over all texts, and another seed is taken if there is one, so that groups are
    exact. A text linked only with itself is in no group.
    """
    p = pairs if matched is None else pairs.where(matched)
    p = p.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null and a <> b")
    texts = p.select(F.col("a").alias("path")).unionByName(p.select(F.col("b").alias("path"))).distinct()
    for seed in range(1000):
        code = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023, E731
        names = materialize(texts.select("path", code("path").alias("node")))
        if names.groupBy("node").count().where("count > 1").isEmpty():
            break
        release(names)
    found = materialize(components(p.select(code("a").alias("a"), code("b").alias("b"))))
    named = found.join(names, "node")
    smallest = named.groupBy("seed").agg(F.min("path").alias("group_path"))
    return named.join(smallest, "seed").select("path", "group_path")


LINK_BITS = 5


def match_groups(dup_groups: DataFrame, limit: int = LINK_BITS) -> DataFrame:
    """(img_path, group_path) of every path linked by comparisons of at most limit bits; failed comparisons link nothing."""
    g = consolidate(dup_groups, "img_path", "neighbour_path", F.col("hamming") <= limit)
    return g.select(F.col("path").alias("img_path"), "group_path")
