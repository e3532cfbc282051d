"""Queries of image-dataset hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from scarpline.functions.texts import after_first_underscore, file_name, literal_list, part_from_end, percent, stem, without_affix
from scarpline.operators import hygiene as H
from scarpline.plans import views as V


def _split():
    s = F.lower(F.trim("old_split"))
    return F.when(s.startswith("tr"), "train").when(s.startswith("va"), "validation").when(s.rlike("^t[es]"), "test")


def pair_files(s, d):
    i = V.items(s, d)
    images = i.select("item_id", "dataset", F.col("img_path").alias("path"))
    masks = i.where("mask_path is not null").select("dataset", F.col("mask_path").alias("path"))
    p = H.paired(images, masks, after_first_underscore(file_name("path")), after_first_underscore(file_name("path")), ["dataset"])
    return p.select("item_id", "path", "mask_path")


def pair_affixes(s, d):
    """Masks named X_mask.png with images b_X.tiff, made from line items."""
    o = V.table(s, d, "orders")
    images = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("raw/b_"), F.col("o_orderkey").cast("string"), F.lit(".tiff")).alias("path"))
    masks = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string"), F.lit("_mask.png")).alias("path"))
    return H.paired(images, masks, without_affix(stem("path"), "b_"), without_affix(stem("path"), "", "_mask"))


def path_parts(s, d):
    i = V.items(s, d)
    return i.select("item_id", file_name("img_path").alias("file"), stem("img_path").alias("stem"), part_from_end(F.col("img_path"), 2).alias("folder"), part_from_end(F.col("img_path"), 4).alias("folder4"))


def near_dup_pairs(s, d):
    return H.hash_pairs(V.items(s, d), "item_id", "phash")


def near_dup_groups(s, d):
    i = V.items(s, d)
    return H.duplicate_groups(H.hash_pairs(i, "item_id", "phash"), i, "item_id")


def dup_group_summary(s, d):
    i = V.items(s, d)
    return H.group_summary(H.duplicate_groups(H.hash_pairs(i, "item_id", "phash"), i, "item_id"))


def cross_split_leakage(s, d):
    i = V.items(s, d).withColumn("split", _split()).where("split is not null")
    order = {"train": 0, "validation": 1, "test": 2}
    i = i.withColumn("ord", sum(F.when(F.col("split") == k, v).otherwise(0) for k, v in order.items()))
    p = H.hash_pairs(i, "item_id", "phash", keep=("dataset", "split", "ord"), where=(F.col("a_dataset") == F.col("b_dataset")) & (F.col("a_ord") != F.col("b_ord")))
    first = F.col("a_ord") < F.col("b_ord")
    p = p.select(F.col("a_dataset").alias("dataset"), F.when(first, F.col("a_split")).otherwise(F.col("b_split")).alias("split_a"), F.when(first, F.col("b_split")).otherwise(F.col("a_split")).alias("split_b"), "distance")
    return p.groupBy("dataset", "split_a", "split_b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("distance") == 0).alias("exact"))


def cross_dataset_leakage(s, d):
    p = H.hash_pairs(V.items(s, d), "item_id", "phash", keep=("dataset",), where=F.col("a_dataset") != F.col("b_dataset"))
    p = p.select(F.least("a_dataset", "b_dataset").alias("dataset_a"), F.greatest("a_dataset", "b_dataset").alias("dataset_b"), "distance")
    return p.groupBy("dataset_a", "dataset_b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("distance") == 0).alias("exact"))


def exact_leakage(s, d):
    t = V.table(s, d, "documents").where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.when(F.col("doc_id") % 20 == 0, "test").when(F.col("doc_id") % 20 <= 2, "validation").otherwise("train").alias("split"))
    return t.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("split").alias("splits")).where("splits > 1")


def failed_hashes(s, d):
    return V.items(s, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("phash").isNull()).alias("skipped"))


def stratified_sample(s, d):
    i = V.items(s, d).withColumn("split", _split()).where("split is not null")
    return H.stratified_sample(i, "item_id", "split", F.md5(F.col("item_id").cast("string"))).select("split", "item_id")


def greedy_group_split(s, d):
    i = V.items(s, d)
    return H.greedy_split(H.duplicate_groups(H.hash_pairs(i, "item_id", "phash"), i, "item_id"))


def new_names(s, d):
    i = V.items(s, d).withColumn("split", _split()).where("split is not null").withColumn("stem", stem("img_path"))
    return H.new_names(i, "split", "stem").select("item_id", "new_name", "unique")


def split_stats(s, d):
    o = V.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("lines"))
    o = o.withColumn("split", F.when(F.col("l_orderkey") % 20 == 0, "test").when(F.col("l_orderkey") % 20 <= 2, "val").otherwise("train"))
    return H.split_stats(o)


def sample_per_split(s, d):
    i = V.items(s, d).withColumn("split", _split()).where("split is not null")
    return H.sample_each(i, "item_id", "split", 5).select("split", "item_id")


def training_pools(s, d):
    """Customers and suppliers as two pools of one training set."""
    c = V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return H.tagged_union({"customers": c, "suppliers": V.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"))})


def flattened_splits(s, d):
    i = V.items(s, d).withColumn("split", _split()).where("split is not null")
    return H.flattened(i.groupBy("split").agg(F.collect_list("item_id").alias("items")))


def literal_lists(s, d):
    t = V.table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "nothing").when(F.col("p_partkey") % 4 == 1, F.format_string("(%d, %d.5,)", "p_size", "p_partkey")).otherwise(F.format_string("[%d, %d.5]", "p_size", "p_partkey")).alias("text"))
    v = t.select("p_partkey", literal_list("text").alias("v"))
    return v.select("p_partkey", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), F.size("v").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


def skipped_share(s, d):
    f = failed_hashes(s, d)
    return f.select("dataset", percent(F.col("skipped"), F.col("items")).alias("skipped"))


_NAMES = (
    "sample_per_split training_pools flattened_splits literal_lists skipped_share pair_files pair_affixes path_parts near_dup_pairs near_dup_groups dup_group_summary cross_split_leakage cross_dataset_leakage exact_leakage failed_hashes stratified_sample "
    "greedy_group_split new_names split_stats"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_PART = f"{V.ITEMS}, parted AS (SELECT *, CASE WHEN lower(trim(old_split)) LIKE 'tr%' THEN 'train' WHEN lower(trim(old_split)) LIKE 'va%' THEN 'validation' WHEN regexp_matches(lower(trim(old_split)), '^t[es]') THEN 'test' END AS split FROM items)"
_PAIRS = f"{V.ITEMS}, pair AS (SELECT a.item_id AS a, b.item_id AS b, a.dataset AS a_dataset, b.dataset AS b_dataset, bit_count(xor(a.phash, b.phash))::INT AS distance FROM items a JOIN items b ON a.item_id < b.item_id AND bit_count(xor(a.phash, b.phash)) <= 5)"
_GROUPS = f"""WITH RECURSIVE {_PAIRS}, link AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach(a, b) AS (SELECT item_id, item_id FROM items UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b), grp AS (SELECT a AS item_id, min(b) AS group_id FROM reach GROUP BY a)"""
_FILE = "regexp_extract({}, '[^/]*$')"
SQL = {
    "sample_per_split": f"""WITH {_PART} SELECT split, item_id FROM (SELECT split, item_id, row_number() OVER (PARTITION BY split ORDER BY md5('0:' || item_id), item_id) AS rn FROM parted WHERE split IS NOT NULL) WHERE rn <= 5""",
    "training_pools": "SELECT c_custkey AS id, c_mktsegment AS kind, 'customers' AS pool FROM customer UNION ALL SELECT s_suppkey, NULL, 'suppliers' FROM supplier",
    "flattened_splits": f"WITH {_PART} SELECT split, item_id AS item FROM parted WHERE split IS NOT NULL",
    "literal_lists": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size::DOUBLE END AS a, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey + 0.5::DOUBLE END AS b, CASE WHEN p_partkey % 4 <> 0 THEN 2 END AS n FROM part",
    "skipped_share": f"WITH {V.ITEMS} SELECT dataset, printf('%d/%d (%.1f%%)', count(*) FILTER (WHERE phash IS NULL), count(*), count(*) FILTER (WHERE phash IS NULL) * 100.0 / count(*)) AS skipped FROM items GROUP BY dataset",
    "pair_files": f"""WITH {V.ITEMS}, f AS (SELECT *, regexp_extract({_FILE.format('img_path')}, '^[^_]*_(.*)$', 1) AS ik, contains({_FILE.format('img_path')}, '_') AS i_ok, regexp_extract({_FILE.format('mask_path')}, '^[^_]*_(.*)$', 1) AS mk, contains({_FILE.format('mask_path')}, '_') AS m_ok FROM items)
SELECT i.item_id, i.img_path AS path, m.mask_path FROM f i JOIN f m ON i.dataset = m.dataset AND i.ik = m.mk AND i.i_ok AND m.m_ok""",
    "pair_affixes": "SELECT 'raw/b_' || o_orderkey || '.tiff' AS path, 'raw/' || o_orderkey || '_mask.png' AS mask_path FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0",
    "path_parts": f"WITH {V.ITEMS} SELECT item_id, {_FILE.format('img_path')} AS file, regexp_replace({_FILE.format('img_path')}, '(.)\\.[^.]*$', '\\1') AS stem, string_split(img_path, '/')[-2] AS folder, string_split(img_path, '/')[-4] AS folder4 FROM items",
    "near_dup_pairs": f"WITH {_PAIRS} SELECT a, b, distance FROM pair",
    "near_dup_groups": f"{_GROUPS} SELECT item_id, group_id FROM grp",
    "dup_group_summary": f"{_GROUPS}, size AS (SELECT group_id, count(*) AS n FROM grp GROUP BY group_id) SELECT count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_multi, max(n) AS largest FROM size",
    "greedy_group_split": f"""{_GROUPS}, size AS (SELECT group_id, count(*) AS size FROM grp GROUP BY group_id), line AS (SELECT *, row_number() OVER (ORDER BY size DESC, group_id) AS n FROM size),
turn(n, t, v, e, split) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' UNION ALL
  SELECT l.n, t + CASE WHEN pick = 'train' THEN size ELSE 0 END, v + CASE WHEN pick = 'validation' THEN size ELSE 0 END, e + CASE WHEN pick = 'test' THEN size ELSE 0 END, pick
  FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END AS pick
    FROM (SELECT *, CASE WHEN n = 0 THEN 230 ELSE 230 * (t + v + e) - 275 * t END AS a, CASE WHEN n = 0 THEN 35 ELSE 35 * (t + v + e) - 275 * v END AS b, CASE WHEN n = 0 THEN 10 ELSE 10 * (t + v + e) - 275 * e END AS c FROM turn)) s
  JOIN line l ON l.n = s.n + 1)
SELECT group_id, size, split FROM line JOIN turn USING (n)""",
    "cross_split_leakage": f"""WITH {_PART}, o AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS ord FROM parted WHERE split IS NOT NULL)
SELECT a.dataset, a.split AS split_a, b.split AS split_b, count(*) AS pairs, count(*) FILTER (WHERE a.phash = b.phash) AS exact FROM o a JOIN o b ON a.dataset = b.dataset AND a.ord < b.ord AND bit_count(xor(a.phash, b.phash)) <= 5 GROUP BY ALL""",
    "cross_dataset_leakage": f"WITH {_PAIRS} SELECT least(a_dataset, b_dataset) AS dataset_a, greatest(a_dataset, b_dataset) AS dataset_b, count(*) AS pairs, count(*) FILTER (WHERE distance = 0) AS exact FROM pair WHERE a_dataset <> b_dataset GROUP BY ALL",
    "exact_leakage": "SELECT md5(text) AS h, count(*) AS docs, count(DISTINCT CASE WHEN doc_id % 20 = 0 THEN 'test' WHEN doc_id % 20 <= 2 THEN 'validation' ELSE 'train' END) AS splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING splits > 1",
    "failed_hashes": f"WITH {V.ITEMS} SELECT dataset, count(*) AS items, count(*) FILTER (WHERE phash IS NULL) AS skipped FROM items GROUP BY dataset",
    "stratified_sample": f"""WITH {_PART}, p AS (SELECT * FROM parted WHERE split IS NOT NULL), z AS (SELECT split, count(*) AS n FROM p GROUP BY split),
q AS (SELECT split, n, split = (SELECT max(split) FROM z) AS is_last, least(round_even(30 * n / sum(n) OVER (), 0)::BIGINT, n) AS share FROM z),
k AS (SELECT split, CASE WHEN is_last THEN least(greatest(30 - sum(CASE WHEN is_last THEN 0 ELSE share END) OVER (), 0), n) ELSE share END AS quota FROM q)
SELECT split, item_id FROM (SELECT p.split, item_id, quota, row_number() OVER (PARTITION BY p.split ORDER BY md5(item_id::VARCHAR), item_id) AS rn FROM p JOIN k ON k.split = p.split) WHERE rn <= quota""",
    "new_names": f"""WITH {_PART}, n AS (SELECT item_id, split || '_' || regexp_replace(regexp_replace({_FILE.format('img_path')}, '(.)\\.[^.]*$', '\\1'), '^image_', '') AS new_name FROM parted WHERE split IS NOT NULL)
SELECT item_id, new_name, count(*) OVER (PARTITION BY new_name) = 1 AS "unique" FROM n""",
    "split_stats": """WITH o AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS lines FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN l_orderkey % 20 = 0 THEN 'test' WHEN l_orderkey % 20 <= 2 THEN 'val' ELSE 'train' END AS split, count(*) AS images, sum(lines)::BIGINT AS instances, count(*) FILTER (WHERE lines = 0) AS empty FROM o GROUP BY 1""",
}
