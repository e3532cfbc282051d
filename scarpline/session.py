"""Session settings and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: All tables of this process lie in one folder of this name.
_RUN = uuid.uuid4().hex
#: Tables written and not released yet with the thread that wrote them, and the folders that are to go when the session's process ends.
_alive: dict[str, int] = {}
_ending: set[str] = set()


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from outside."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scarpline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a local session a temporary one of our own."""
    global _own
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="scarpline-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    Unlike checkpoint(), which runs the last stage twice, this computes each row once and keeps columns prunable. The table stays until
    release(), scope() or release_all() deletes it, at the latest until the driver's JVM ends.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/scarpline/{_RUN}"
    path = f"{run}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _alive[path] = threading.get_ident()
    if run not in _ending:
        fs, p = _file_system(spark, run)
        fs.deleteOnExit(p)
        _ending.add(run)
    out = spark.read.schema(df.schema).parquet(path)
    out._scarpline_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if _alive.pop(path, None) is not None:
            fs, p = _file_system(spark, path)
            fs.delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later result reads."""
    for t in tables:
        path = getattr(t, "_scarpline_path", None)
        if path:
            _delete(t.sparkSession, [path])


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, when it ends, every table that its thread wrote inside it but those given to what it yields; results that read the others must have been written by then."""
    before, kept = set(_alive), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._scarpline_path)
        return table

    try:
        yield keep
    finally:
        _delete(spark, [p for p, t in _alive.items() if t == threading.get_ident() and p not in before and p not in kept])


def release_all(spark: SparkSession) -> None:
    """Delete every table that this process has written."""
    _delete(spark, list(_alive))
