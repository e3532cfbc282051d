import random
import re

import pytest

from scarpline.llm import names as N
from scarpline.llm.overlap import cross_split_pairs, overlap_report


def words(*texts):
    return frozenset(re.findall("[a-z0-9]+", " ".join(t for t in texts if t is not None).lower()))


def brute(rows):
    w = {i: words(a, b) for i, a, b in rows if i is not None}
    keys = sorted(w)
    out = set()
    for x, i in enumerate(keys):
        for j in keys[x + 1 :]:
            n = len(w[i] & w[j])
            if w[i] and n * 5 >= 4 * len(w[i] | w[j]):
                out.add((i, j))
    return out


def items(seed, n=250, common=12, rare=2000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"c{rnd.randrange(common)}" for _ in range(rnd.randrange(1, 12))] + [f"r{rnd.randrange(rare)}" for _ in range(rnd.randrange(0, 10))]
        if rows and rnd.random() < 0.5:
            own = re.findall("[a-z0-9]+", rnd.choice(rows)[1].lower()) or ["x"]
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(50)}"
            rnd.shuffle(own)
        text = rnd.choice("/_- .").join(own)
        rows.append((i, text.upper() if rnd.random() < 0.2 else text, None if rnd.random() < 0.3 else "_".join(own[: rnd.randrange(len(own) + 1)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "item_id long, img_path string, mask_path string, root string, seq int")


EDGE = [(9000, None, None), (9001, "", " "), (9002, "только кириллица", None), (9003, "a", None), (9004, "A", "a"), (9005, "one " * 3000, None), (9006, " ".join(f"w{k}" for k in range(3000)), None), (9007, " ".join(f"w{k}" for k in range(2500)), None), (9008, "K", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_brute_force(spark, seed):
    rows = items(seed) + EDGE
    got = [tuple(r) for r in N.near_names(frame(spark, rows + rows[:30])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("leaf", [2, 16, 1000])
def test_hot_roots_have_trees(spark, monkeypatch, leaf):
    """All records share their words but for a few, so that each root holds most records."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.sample([f"c{k}" for k in range(14)], 12)), None) for i in range(300)]
    want = brute(rows)
    assert len(want) > 1000 and len(want) < 40000
    d = frame(spark, rows)
    records, copies = N.classed(N.sequences(d, "item_id", N.ITEM_TEXTS), "item_id")
    rooted = N.roots(records)
    assert records.count() == len({words(*r[1:]) for r in rows}) == 300 - copies.count()
    assert rooted.groupBy("root").count().where("count > 50").count() > 0
    monkeypatch.setattr(N, "LEAF", leaf)
    homes, visits = N.grow(rooted)
    assert homes.count() == rooted.where("short").count()
    assert leaf == 1000 or homes.select("root", "node").distinct().count() > homes.select("root").distinct().count()
    assert {tuple(r) for r in N.near_names(d).collect()} == want


def test_trees_prune(spark):
    """Records of far families in one root: some half of all visits is spared."""
    rnd = random.Random(6)
    rows = []
    for f in range(12):
        own = [f"f{f}w{k}" for k in range(40)]
        rows += [(f * 100 + i, " ".join(["all", *own[: 38 + i % 2], f"x{f}i{i}"]), None) for i in range(20)]
    seqs = N.sequences(frame(spark, rows), "item_id", N.ITEM_TEXTS)
    records, _ = N.classed(seqs, "item_id")
    rooted = N.roots(records.withColumn("head", N.F.array(N.F.lit(7).cast("long"))))
    homes, visits = N.grow(rooted, 20)
    leaves = homes.select("root", "node").distinct().count()
    assert leaves >= 6 and visits.count() < 240 * leaves * 0.6
    assert {tuple(r) for r in N.near_names(frame(spark, rows)).collect()} == brute(rows)


def test_equal_records_are_one_class(spark):
    rows = [(i, "a b c d e f", None) for i in range(60)] + [(100 + i, "F e d c", "b a g") for i in range(3)] + [(200, "z y", None)]
    d = frame(spark, rows)
    assert {tuple(r) for r in N.near_names(d).collect()} == brute(rows)
    assert {r.item_id: r.group_id for r in N.near_name_groups(d).collect()} == {r[0]: 0 for r in rows[:-1]}


def test_empty_and_groups(spark):
    d = frame(spark, items(5))
    assert N.near_names(d.limit(0)).count() == 0 and N.near_name_groups(d.limit(0)).count() == 0
    pairs = {tuple(r) for r in N.near_names(d).collect()}
    up = {}
    for a, b in sorted(pairs):
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(len(up)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert {r.item_id: r.group_id for r in N.near_name_groups(d).collect()} == up


SPLITS = ["train", " TRAIN ", "trn", "val", "Validation", "test", "tst", None, " ", "other"]


def split_of(s):
    s = (s or "").strip().lower()
    return "train" if s.startswith("tr") else "validation" if s.startswith("va") else "test" if s[:2] in ("te", "ts") else None


def test_cross_split_pairs(spark):
    rnd = random.Random(7)
    hashes = [rnd.randrange(2**40) for _ in range(30)]
    rows = [(i, rnd.choice("ab"), rnd.choice(SPLITS), a, b, rnd.choice([*[rnd.choice(hashes) ^ (1 << rnd.randrange(64) if rnd.random() < 0.3 else 0) for _ in range(3)], None])) for i, a, b in items(8)]
    rows = [(i, d, s, a, b, h - 2**64 if h is not None and h >= 2**63 else h) for i, d, s, a, b, h in rows]
    d = spark.createDataFrame(rows + rows[:40], "item_id long, dataset string, old_split string, img_path string, mask_path string, phash long")
    by = {r[0]: r for r in rows}
    near = brute([(r[0], r[3], r[4]) for r in rows])
    want = set()
    for i in by:
        for j in by:
            s, t = split_of(by[i][2]), split_of(by[j][2])
            if i < j and s and t and (s == "train") != (t == "train"):
                g, h = by[i][5], by[j][5]
                if (i, j) in near or (g is not None and h is not None and bin((g ^ h) & (2**64 - 1)).count("1") <= 5):
                    want.add((i, j))
    got = [tuple(r) for r in cross_split_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    report = {(r.split, r.dataset): (r["items"], r.overlapping, r.pairs) for r in overlap_report(d).collect()}
    ends = [e for p in want for e in p]
    for (s, k), (n, hit, pairs) in report.items():
        own = [i for i in by if split_of(by[i][2]) == s and by[i][1] == k]
        assert (n, hit, pairs) == (len(own), sum(i in ends for i in own), sum(ends.count(i) for i in own))
    assert cross_split_pairs(d.limit(0)).count() == 0 and overlap_report(d.limit(0)).count() == 0
