import random
from collections import Counter, defaultdict

import pytest

from scarpline.llm.components import match_groups
from scarpline.llm import splits
from scarpline.llm.splits import group_splits, keep_together, place_profiles, propagate
from tests.llm.test_components import brute


def test_propagate(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(200), 1000 + rnd.randrange(150)) for _ in range(220)] + [(5000 + k, 2000 + k) for k in range(60)] + [(5000 + k, 2001 + k) for k in range(60)]
    d = spark.createDataFrame([*pairs, (None, 3), (4, None)], "record long, entity long")
    got = {r.entity: r.label for r in propagate(d).collect()}
    groups = brute([(10**6 + r, e) for r, e in pairs])
    by = defaultdict(list)
    for e in got:
        by[groups[e]].append(e)
    assert got == {e: min(own) for own in by.values() for e in own}
    assert propagate(d.limit(0)).count() == 0


def test_long_chains_take_few_rounds(spark):
    n = 3000
    d = spark.range(n).selectExpr("id as record", "explode(array(id, id + 1)) as entity")
    assert {r.label for r in propagate(d, 20).select("label").distinct().collect()} == {0}


def world(spark, seed, n=3000, hot=0.34):
    rnd = random.Random(seed)
    items, pairs = [], []
    for i in range(n):
        scene = "hot" if rnd.random() < hot else rnd.choice([None, f"s{rnd.randrange(n // 8)}"])
        items.append((i, rnd.choice(["a", "a", "a", "b", "b", None]), rnd.choice(["train", "val", None]), f"p{i}", scene))
    quiet = [i for i in range(n) if items[i][4] is None]
    for _ in range(n // 6):
        pairs.append((f"p{rnd.choice(quiet)}", f"p{rnd.choice(quiet)}", rnd.choice([0, 3, 9, None])))
    pairs.append(("p1", "p-unknown", 1))
    d = spark.createDataFrame(items + items[:50], "item_id long, dataset string, old_split string, img_path string, source_scene string")
    return items, d, spark.createDataFrame(pairs, "img_path string, neighbour_path string, hamming int")


@pytest.mark.parametrize("seed", [1, 2])
def test_related_records_stay_together(spark, seed):
    items, d, pairs = world(spark, seed)
    rows = keep_together(d, pairs).collect()
    split = {r.item_id: r.new_split for r in rows}
    assert len(rows) == len(items) == len(split) and set(split.values()) == {"train", "validation", "test"}
    group = {r.img_path: r.group_path for r in match_groups(pairs).collect()}
    near = defaultdict(set)
    for i, _, _, path, scene in items:
        if scene is not None:
            near["s", scene].add(split[i])
        if path in group:
            near["g", group[path]].add(split[i])
    assert all(len(v) == 1 for v in near.values())
    n = Counter(split.values())
    for k, share in {"train": 230, "validation": 35, "test": 10}.items():
        assert abs(n[k] - len(items) * share / 275) < 1
    label = Counter((r[1], split[r[0]]) for r in items)
    for k in ("a", "b", None):
        own = sum(v for (a, _), v in label.items() if a == k)
        assert abs(label[k, "train"] / own - 230 / 275) < 0.05


def test_small_and_empty(spark):
    _, d, pairs = world(spark, 3, 60)
    assert keep_together(d.limit(0), pairs).count() == 0
    assert keep_together(d, pairs.limit(0)).count() == 60
    one = spark.createDataFrame([(1, "x"), (1, None), (1, "x")], "group_id long, label string")
    assert [tuple(r) for r in group_splits(one).collect()] == [(1, "train")]
    whole = spark.createDataFrame([(g, f"l{g % 700}") for g in range(2000) for _ in range(1 + g % 3)], "group_id long, label string")
    n = Counter()
    for r in group_splits(whole).collect():
        n[r.new_split] += 1 + r.group_id % 3
    total = sum(n.values())
    assert all(abs(n[k] - total * s / 275) < 1 for k, s in {"train": 230, "validation": 35, "test": 10}.items())


@pytest.mark.parametrize("limits", [(500, 20_000), (2, 20_000), (2, 3)])
def test_labels_are_spread_alike_with_any_limits(spark, monkeypatch, limits):
    monkeypatch.setattr(splits, "STRATA", limits[0])
    monkeypatch.setattr(splits, "PROFILES", limits[1])
    rnd = random.Random(4)
    members = [(g, rnd.choice("abcdefgh")) for g in range(3000) for _ in range(1 if g > 400 else rnd.choice((2, 2, 3, 5)))]
    got = {r.group_id: r.new_split for r in group_splits(spark.createDataFrame(members, "group_id long, label string")).collect()}
    assert len(got) == 3000
    n = Counter((x, got[g]) for g, x in members)
    for k, share in {"train": 230, "validation": 35, "test": 10}.items():
        assert abs(sum(n[x, k] for x in "abcdefgh") - len(members) * share / 275) < 1
        for x in "abcdefgh":
            assert abs(n[x, k] - sum(n[x, s] for s in ("train", "validation", "test")) * share / 275) < (2 if limits[0] > 8 else 30)


def test_groups_go_where_they_deviate_least():
    import numpy as np

    want = np.array([[80.0, 15, 5], [40, 8, 2]])
    out, have = place_profiles([({0: 2, 1: 1}, 20), ({0: 30}, 1), ({1: 3}, 4)], want)
    assert [o.sum() for o in out] == [20, 1, 4] and out[1].tolist() == [1, 0, 0]
    assert (np.abs(have.sum(0) / have.sum() - want.sum(0) / want.sum()) < 0.08).all()
