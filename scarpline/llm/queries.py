"""The queries of this folder and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scarpline.llm.components import match_groups
from scarpline.llm.encode import token_ids
from scarpline.llm.garbled import garbled
from scarpline.llm.names import near_name_groups, near_names
from scarpline.llm.overlap import coverage, cross_split_pairs, overlap_report
from scarpline.llm.packing import pack_texts
from scarpline.llm.splits import keep_together, torn_apart
from scarpline.session import materialize


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return keep_together(_table(spark, sf, "rebuild_nepal_split"), _table(spark, sf, "dup_groups"))


def _torn(spark: SparkSession, sf: str) -> DataFrame:
    """Has no rows: what must stay together does."""
    splits = materialize(_splits(spark, sf))
    return torn_apart(_table(spark, sf, "rebuild_nepal_split"), match_groups(_table(spark, sf, "dup_groups")), splits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": lambda s, d: match_groups(_table(s, d, "dup_groups")),
    "p3_found": lambda s, d: cross_split_pairs(_table(s, d, "rebuild_nepal_split")),
    "p3_overlap_report": lambda s, d: overlap_report(_table(s, d, "rebuild_nepal_split")),
    "p3_coverage": lambda s, d: coverage(_table(s, d, "rebuild_nepal_split")),
    "p4_found": lambda s, d: near_names(_table(s, d, "rebuild_nepal_split")),
    "p4_groups": lambda s, d: near_name_groups(_table(s, d, "rebuild_nepal_split")),
    "p5_splits": _splits,
    "p5_sizes": lambda s, d: _splits(s, d).groupBy("new_split").count().withColumnRenamed("count", "items"),
    "p5_torn": _torn,
    "p6_ids": lambda s, d: token_ids(_table(s, d, "documents")),
    "p7_containers": lambda s, d: pack_texts(_table(s, d, "documents")),
    "p8_found": lambda s, d: garbled(_table(s, d, "documents")).select("doc_id"),
    "p8_restored": lambda s, d: garbled(_table(s, d, "documents")),
}

_WORDS = """
item AS (SELECT item_id, any_value(img_path) AS img_path, any_value(mask_path) AS mask_path, any_value(old_split) AS old_split, any_value(phash) AS phash, any_value(dataset) AS dataset FROM rebuild_nepal_split GROUP BY item_id),
word AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(concat_ws(' ', img_path, mask_path)), '[a-z0-9]+')) AS w FROM item),
size AS (SELECT item_id, count(*) AS n FROM word GROUP BY item_id),
shared AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n FROM word a JOIN word b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL),
near AS (SELECT item_a, item_b FROM shared JOIN size x ON x.item_id = item_a JOIN size y ON y.item_id = item_b WHERE shared.n * 5 >= 4 * (x.n + y.n - shared.n))
"""
_REACH = """
edge AS (SELECT img_path AS a, neighbour_path AS b FROM dup_groups WHERE hamming <= 5 AND img_path <> neighbour_path
         UNION SELECT neighbour_path, img_path FROM dup_groups WHERE hamming <= 5 AND img_path <> neighbour_path),
"""
_CROSS = """
part AS (SELECT item_id, phash, dataset, CASE WHEN lower(ltrim(old_split)) LIKE 'tr%' THEN 'train' WHEN lower(ltrim(old_split)) LIKE 'va%' THEN 'validation'
         WHEN lower(ltrim(old_split)) LIKE 'te%' OR lower(ltrim(old_split)) LIKE 'ts%' THEN 'test' END AS split FROM item),
cross_pair AS (SELECT least(e.item_id, t.item_id) AS item_a, greatest(e.item_id, t.item_id) AS item_b, e.split, e.dataset, e.item_id AS item_id
  FROM part e JOIN part t ON e.split IN ('validation', 'test') AND t.split = 'train'
  WHERE bit_count(xor(e.phash, t.phash)) <= 5 OR (least(e.item_id, t.item_id), greatest(e.item_id, t.item_id)) IN (SELECT (item_a, item_b) FROM near))
"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {_REACH}
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT a AS img_path, least(a, min(b)) AS group_path FROM reach GROUP BY a""",
    "p3_found": f"WITH {_WORDS}, {_CROSS} SELECT item_a, item_b FROM cross_pair",
    "p3_overlap_report": f"""WITH {_WORDS}, {_CROSS}
SELECT p.split, p.dataset, count(*) AS items, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM part p
LEFT JOIN (SELECT item_id, count(*) AS n FROM cross_pair GROUP BY item_id) c ON c.item_id = p.item_id WHERE p.split IN ('validation', 'test') GROUP BY ALL""",
    "p3_coverage": f"""WITH {_WORDS}, {_CROSS},
ends AS (SELECT item_a AS item_id, item_b AS other FROM near UNION ALL SELECT item_b, item_a FROM near),
named AS (SELECT e.item_id, count(*) AS names, round(max(shared.n / size.n), 6) AS coverage FROM ends e JOIN part p ON p.item_id = e.item_id AND p.split IN ('validation', 'test') JOIN part t ON t.item_id = e.other AND t.split = 'train'
  JOIN shared ON shared.item_a = least(e.item_id, e.other) AND shared.item_b = greatest(e.item_id, e.other) JOIN size ON size.item_id = e.item_id GROUP BY e.item_id),
imaged AS (SELECT e.item_id, count(*) AS images FROM part e JOIN part t ON e.split IN ('validation', 'test') AND t.split = 'train' AND bit_count(xor(e.phash, t.phash)) <= 5 GROUP BY e.item_id)
SELECT p.item_id, p.split, p.dataset, coalesce(names, 0) AS names, coalesce(images, 0) AS images, coverage FROM part p LEFT JOIN named USING (item_id) LEFT JOIN imaged USING (item_id) WHERE names IS NOT NULL OR images IS NOT NULL""",
    "p4_found": f"WITH {_WORDS} SELECT item_a, item_b FROM near",
    "p4_groups": f"""WITH RECURSIVE {_WORDS}, edge AS (SELECT item_a AS a, item_b AS b FROM near UNION SELECT item_b, item_a FROM near),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT a AS item_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
    "p5_sizes": """WITH n AS (SELECT count(DISTINCT item_id) AS n FROM rebuild_nepal_split), w(new_split, share, k) AS (VALUES ('train', 230, 0), ('validation', 35, 1), ('test', 10, 2)),
f AS (SELECT new_split, k, n, n * share // 275 AS items, n * share % 275 AS part FROM n, w), r AS (SELECT *, row_number() OVER (ORDER BY part DESC, k) AS nth, n - sum(items) OVER () AS more FROM f)
SELECT new_split, (items + CASE WHEN nth <= more THEN 1 ELSE 0 END)::BIGINT AS items FROM r""",
    "p5_torn": "SELECT 'scene' AS kind, source_scene AS entity, count(*) AS splits FROM rebuild_nepal_split WHERE false GROUP BY ALL",
}
