"""Scenes, configurations and training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scarpline import constants as C


def in_window(ts: Column, target: Column, days: Column | int) -> Column:
    """From days before the target, included, to days after it, excluded."""
    d = days if isinstance(days, Column) else F.lit(days)
    start, end = F.date_sub(target, d), F.date_add(target, d)
    return (ts >= start) & (ts < end)


def stages(cases: DataFrame) -> DataFrame:
    """(case, stage, target, window_days) of cases (case, stages MAP<STRING, STRUCT<target, window_days>>)."""
    return cases.select("case", F.explode("stages").alias("stage", "s")).select("case", "stage", "s.target", "s.window_days")


def least_cloudy(scenes: DataFrame, wanted: DataFrame, keys: list[str], on: Column | None = None) -> DataFrame:
    """(keys, scene_id, ts, cloud): for each row of wanted (keys, target, window_days) the scene (scene_id, ts, cloud) in its window with the least cloud, then the earliest, then the smallest id; none, no row."""
    cond = in_window(F.col("ts"), F.col("target"), F.col("window_days"))
    j = scenes.join(wanted, cond if on is None else on & cond)
    return j.groupBy(*keys).agg(F.min(F.struct("cloud", "ts", "scene_id")).alias("s")).select(*keys, "s.scene_id", "s.ts", "s.cloud")


def best_so_far(metrics: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """metrics with best, the greatest value up to each epoch, and since, the epochs since it was first reached."""
    w = W.partitionBy(run).orderBy(epoch)
    d = metrics.withColumn("best", F.max(metric).over(w.rowsBetween(W.unboundedPreceding, 0)))
    reached = F.max(F.when((F.col(metric) == F.col("best")) & (F.col("best") > F.coalesce(F.lag("best").over(w), F.lit(float("-inf")))), F.col(epoch))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("since", F.col(epoch) - reached)


def best_epoch(metrics: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """(run, best_epoch, best, epochs): the earliest epoch with the greatest value."""
    top = F.max(F.struct(F.col(metric).alias("best"), (-F.col(epoch)).alias("e")))
    return metrics.groupBy(run).agg(top.alias("t"), F.max(epoch).alias("epochs")).select(run, (-F.col("t.e")).alias("best_epoch"), F.col("t.best").alias("best"), "epochs")


def largest_per_bucket(chips: DataFrame, bucket: str, chip: str, area: str) -> DataFrame:
    """(bucket, chip, area): the chip with the greatest area in each bucket, the smallest id of equal ones."""
    return chips.groupBy(bucket).agg(F.min(F.struct((-F.col(area)).alias("a"), F.col(chip).alias("c"))).alias("m")).select(bucket, F.col("m.c").alias(chip), (-F.col("m.a")).alias(area))


def config_agreement(configs: DataFrame, keys: list[str] | None = None, gsd: str = "gsd_m_per_px", strict: bool = False) -> DataFrame:
    """(keys, n_gsd, gsd_m_per_px, agree): the pixel size that all configurations have, 10 m if none has one; NULL, or an error in strict mode, if they differ."""
    n = F.countDistinct(gsd)
    d = configs.groupBy(*(keys or [])).agg(n.alias("n_gsd"), F.min(gsd).alias("_g"))
    differ = F.raise_error(F.lit("datasets disagree on gsd_m_per_px")).cast("double") if strict else F.lit(None).cast("double")
    value = F.when(F.col("n_gsd") == 0, C.DEFAULT_GSD_M_PER_PX).when(F.col("n_gsd") == 1, F.col("_g")).otherwise(differ)
    return d.withColumn("gsd_m_per_px", value).withColumn("agree", F.col("n_gsd") <= 1).drop("_g")


def model_configs(configs: DataFrame, trained_on: DataFrame) -> DataFrame:
    """(model, config): JSON of the pixel size and the sources of each model; trained_on (model, dataset). Datasets without a configuration are skipped."""
    j = trained_on.join(configs, "dataset")
    d = j.groupBy("model").agg(F.countDistinct("gsd_m_per_px").alias("n"), F.min("gsd_m_per_px").alias("g"), F.array_sort(F.collect_list(F.struct("dataset", *[c for c in configs.columns if c != "dataset"]))).alias("sources"))
    gsd = F.when(F.col("n") == 0, C.DEFAULT_GSD_M_PER_PX).when(F.col("n") == 1, F.col("g")).otherwise(F.raise_error(F.lit("datasets disagree on gsd_m_per_px")).cast("double"))
    return d.select("model", F.to_json(F.struct(gsd.alias("gsd_m_per_px"), "sources")).alias("config"))


def gsd_of(models: DataFrame, config: str = "config") -> DataFrame:
    """models with gsd_m_per_px of their JSON configuration, 10 m where there is none."""
    return models.withColumn("gsd_m_per_px", F.coalesce(F.get_json_object(config, "$.gsd_m_per_px").cast("double"), F.lit(C.DEFAULT_GSD_M_PER_PX)))


def first_available(choices: Column) -> Column:
    """The first of an array of weight paths that is not NULL; NULL, for the stub, if none is."""
    return F.get(F.filter(choices, lambda c: c.isNotNull()), F.lit(0))
