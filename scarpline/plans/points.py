"""Queries of points near assets and inside study areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scarpline.operators.points_near import points_near


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    return points_near(t("lookup"), "lookup_id", "lat", "lon", t("exposure"), "asset_id", "geometry", t("study_areas"), "name", "bbox")


QUERIES = {"p1_found": p1_found}

_FOUND = r"""WITH l AS (SELECT lookup_id, min((lat, lon))[1] AS lat, min((lat, lon))[2] AS lon FROM lookup WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY lookup_id),
geo AS (SELECT DISTINCT asset_id, trim(regexp_replace(geometry, '^\s*SRID\s*=\s*\d+\s*;', '', 'i')) AS g FROM exposure WHERE geometry IS NOT NULL),
form AS (SELECT asset_id, lower(regexp_extract(g, '^\w+', 0)) AS kind, regexp_extract_all(g, '\(([^()]*)\)', 1) AS rings FROM geo WHERE g NOT LIKE '{%'
  UNION ALL SELECT asset_id, lower(regexp_extract(g, '"type"\s*:\s*"(\w+)"', 1)), list_transform(regexp_extract_all(regexp_replace(regexp_extract(g, '"coordinates"\s*:\s*([-+0-9.,eE\[\]\s]*)', 1), '\s', '', 'g'), '\[[^\[\]]+\](?:,\[[^\[\]]*\])*', 0),
    lambda r: replace(replace(replace(replace(replace(r, '],[', ';'), '[', ''), ']', ''), ',', ' '), ';', ',')) FROM geo WHERE g LIKE '{%'),
ring AS (SELECT asset_id, kind, unnest(rings) AS ring, unnest(range(len(rings))) AS r FROM form),
vertex AS (SELECT asset_id, kind, r, unnest(string_split(ring, ',')) AS v, unnest(range(len(string_split(ring, ',')))) AS k FROM ring),
xy AS (SELECT asset_id, kind, r, k, try_cast(string_split_regex(trim(v), '\s+')[1] AS DOUBLE) AS x, try_cast(string_split_regex(trim(v), '\s+')[2] AS DOUBLE) AS y FROM vertex),
good AS (SELECT *, first_value(x) OVER (PARTITION BY asset_id ORDER BY r, k) AS start FROM xy WHERE asset_id NOT IN (SELECT asset_id FROM xy WHERE coalesce(NOT isfinite(x) OR NOT isfinite(y), true))),
pt AS (SELECT asset_id, kind LIKE '%polygon' AS poly, r, k, x - 360 * round((x - start) / 360) AS x, y, start FROM good),
step AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, count(*) OVER (PARTITION BY asset_id, r) AS n FROM pt WINDOW w AS (PARTITION BY asset_id, r ORDER BY k)),
edge AS (SELECT asset_id, poly, x AS x0, y AS y0, coalesce(nx, fx) AS x1, coalesce(ny, fy) AS y1 FROM step WHERE nx IS NOT NULL OR poly OR n = 1),
box AS (SELECT asset_id, min(start) AS start, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM pt GROUP BY asset_id),
pair AS (SELECT lookup_id, asset_id, lat, lon + 360 * round((start - lon) / 360) AS x, cos(radians(lat)) AS c FROM l JOIN box b ON lat BETWEEN s - 0.001 AND n + 0.001 AND lon + 360 * round((start - lon) / 360) BETWEEN w - 0.001 / greatest(abs(cos(radians(lat))), 1e-6) AND e + 0.001 / greatest(abs(cos(radians(lat))), 1e-6)),
side AS (SELECT lookup_id, asset_id, poly, (x0 - x) * c AS a, y0 - lat AS b, (x1 - x0) * c AS p, y1 - y0 AS q, poly AND (y0 > lat) <> (y1 > lat) AND x < x0 + (lat - y0) / (y1 - y0) * (x1 - x0) AS crossed FROM pair JOIN edge USING (asset_id)),
foot AS (SELECT *, CASE WHEN p * p + q * q > 0 THEN least(1, greatest(0, -(a * p + b * q) / (p * p + q * q))) ELSE 0 END AS t FROM side)
SELECT lookup_id, 'near' AS relation, asset_id::VARCHAR AS target FROM foot GROUP BY lookup_id, asset_id HAVING min(111320 * sqrt((a + t * p) * (a + t * p) + (b + t * q) * (b + t * q))) <= 60 OR count(*) FILTER (WHERE crossed) % 2 = 1
UNION ALL SELECT lookup_id, 'inside', name FROM l JOIN study_areas ON lat BETWEEN bbox[2] AND bbox[4] AND (lon BETWEEN bbox[1] AND bbox[3] OR (bbox[1] > bbox[3] AND (lon >= bbox[1] OR lon <= bbox[3])))"""

SQL: dict[str, str] = {"p1_found": _FOUND}
