import random

import pytest

from scarpline.llm.components import components, consolidate, match_groups


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def graph(kind, seed):
    rnd = random.Random(seed)
    n = 300
    if kind == "sparse":
        return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)]
    if kind == "dense":
        return [(rnd.randrange(40), rnd.randrange(40)) for _ in range(200)]
    if kind == "chain":
        order = rnd.sample(range(n), n)
        return list(zip(order, order[1:]))
    if kind == "hub":
        return [(n, k) for k in range(n)] + [(k + 1000, k + 1001) for k in range(0, 50, 2)]
    return []


@pytest.mark.parametrize("kind", ["sparse", "dense", "chain", "hub", "empty"])
def test_like_union_find(spark, kind):
    edges = graph(kind, 1)
    edges += [(b, a) for a, b in edges[:20]] + edges[:20] + ([(7, 7), (None, 3), (5000, 5000)] if edges else [])
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in edges], "a long, b long, u int, v string")
    assert {r.node: r.seed for r in components(d).collect()} == brute(edges)


def test_texts(spark):
    pairs = [("Ä", "b"), ("b", "c"), ("z", "z"), (None, "c"), ("q", "r"), ("r", "q"), ("", "q")]
    d = spark.createDataFrame(pairs, "x string, y string")
    got = {r.path: r.group_path for r in consolidate(d, "x", "y").collect()}
    assert got == {"Ä": "b", "b": "b", "c": "b", "": "", "q": "", "r": ""}


def test_match_groups_reads_hamming(spark):
    rows = [("a", "b", 5), ("b", "a", 9), ("b", "c", 6), ("c", "d", None), ("c", "d", 0), ("e", "e", 0), ("f", None, 1)]
    d = spark.createDataFrame([(*r, "extra", 1) for r in rows], "img_path string, neighbour_path string, hamming int, path string, node int")
    assert {tuple(r) for r in match_groups(d).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    assert match_groups(d.limit(0)).count() == 0
