"""Readers and writers of the file formats around the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarpline.functions.polygon import label_line, parse_label
from scarpline.functions.texts import part_from_end, stem

AREA_SCHEMA = "display_name string, bbox array<double>, utm_crs string, local_relief_fallback_m double, osm_pbf_path string, source_notes string"
CONFIG_SCHEMA = "gsd_m_per_px double, source string, sensor string, gsd_verified boolean, georeferenced boolean"
_TEXT_ROWS = {"wholetext": "true"}


def study_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of folder/*/config.json, named by their folder."""
    d = spark.read.schema(AREA_SCHEMA).option("multiLine", True).json(f"{folder}/*/config.json")
    return d.select(part_from_end(F.input_file_name(), 2).alias("name"), "*")


def dataset_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations of folder/*/dataset_config.json, named by their folder, with all of the file as a variant: keys vary."""
    t = spark.read.options(**_TEXT_ROWS).text(f"{folder}/*/dataset_config.json").select(part_from_end(F.input_file_name(), 2).alias("dataset"), "value")
    return t.select("dataset", F.from_json("value", CONFIG_SCHEMA).alias("c"), F.try_parse_json("value").alias("every")).select("dataset", "c.*", "every")


def write_configs(models: DataFrame, path: str) -> None:
    """One JSON text for each model of (model, config), in a folder named by it."""
    models.select("model", "config").write.mode("overwrite").partitionBy("model").text(path)


def geojson(spark: SparkSession, path: str, properties: str = "name string, highway string, bridge string, amenity string, place string, asset_type string") -> DataFrame:
    """(properties, geometry): one row for each feature; properties a file lacks are NULL, geometry stays GeoJSON text."""
    schema = f"features array<struct<properties:struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in properties.split(', '))}>,geometry:string>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def write_geojson(assets: DataFrame, path: str, columns: list[str], geometry: str = "geometry") -> None:
    """Features, one a line; of the columns those that are there."""
    have = [c for c in columns if c in assets.columns]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*have).alias("properties"), F.try_parse_json(geometry).alias("geometry"))
    assets.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, at, label, flat) of label text files: a row for each line that is not blank, numbered within its file from 0."""
    t = spark.read.options(**_TEXT_ROWS).text(path).select(stem(F.input_file_name()).alias("stem"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    p = t.select("stem", "line_no", parse_label("line").alias("l")).where("l is not null")
    from pyspark.sql.window import Window as W

    return p.select("stem", (F.row_number().over(W.partitionBy("stem").orderBy("line_no")) - 1).alias("at"), "l.label", "l.flat")


def write_labels(polygons: DataFrame, path: str) -> None:
    """polygons (split, stem, at, label, flat) as text, a folder for each split and image."""
    lines = polygons.select("split", "stem", "at", label_line("flat", F.col("label")).alias("value"))
    one = lines.groupBy("split", "stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    one.write.mode("overwrite").partitionBy("split", "stem").text(path)


def data_yaml(root: str, names: tuple[str, ...] = ("landslide",)) -> str:
    """The description of a training set."""
    return f"path: {root}\ntrain: images/train\nval: images/val\ntest: images/test\nnc: {len(names)}\nnames: {list(names)}\n"


def training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Curves of path/*/results.csv: run, epoch INT, and the other columns as DOUBLE, whatever their number."""
    head = spark.read.option("header", True).csv(f"{path}/*/results.csv").columns
    schema = T.StructType([T.StructField(c, T.IntegerType() if c.strip() == "epoch" else T.DoubleType()) for c in head])
    d = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(f"{path}/*/results.csv")
    d = d.withColumn("run", part_from_end(F.input_file_name(), 2))
    return d.select("run", *[F.col(f"`{c}`").alias(c.strip()) for c in head])


def band_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(file, band, minimum, maximum, mean, stddev) of raster statistics in XML sidecars."""
    schema = "_band int, Metadata struct<MDI:array<struct<_VALUE:double,_key:string>>>"
    d = spark.read.format("xml").option("rowTag", "PAMRasterBand").schema(schema).load(path)
    value = lambda k: F.get(F.filter(F.col("Metadata.MDI"), lambda m: m["_key"] == f"STATISTICS_{k}"), F.lit(0))["_VALUE"]
    return d.select(stem(F.input_file_name()).alias("file"), F.col("_band").alias("band"), *[value(k.upper()).alias(k) for k in ("minimum", "maximum", "mean", "stddev")])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, bands) of PNG, JPEG, BMP and GIF files: red, green and blue as flat arrays, grey three times; files that are none have no row."""
    d = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):  # an image at a time
                h, w, n = (b.column(c)[k].as_py() for c in (1, 2, 3))
                x = np.frombuffer(b.column(4)[k].as_buffer(), np.uint8).reshape(h, w, n)[:, :, : 3 if n > 2 else 1]
                bands = [x[:, :, c].ravel().astype(float) for c in ((2, 1, 0) if n > 2 else (0, 0, 0))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), b.column(2).slice(k, 1), pa.array([bands], pa.list_(pa.list_(pa.float64())))], names=["path", "height", "width", "bands"])

    return d.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, height int, width int, bands array<array<double>>")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, area: str = "area") -> None:
    """A drainage graph as two tables, a folder for each area."""
    nodes.write.mode("overwrite").partitionBy(area).parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy(area).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of write_graph(); an area asked for is read alone."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def example_table(spark: SparkSession, rows: list[tuple[str, float, float, int, int]], folder: str) -> DataFrame:
    """(id, lat, lon, area_m2, n_landslides, image_path) of a static list of located examples, each with its chip in folder."""
    d = spark.createDataFrame(rows, "id string, lat double, lon double, area_m2 long, n_landslides int")
    return d.withColumn("image_path", F.concat(F.lit(folder.rstrip("/") + "/"), "id", F.lit(".tif")))
