"""A session with the settings that the engine assumes: UTC and adaptive execution."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_paths: dict[int, str] = {}


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("lexigraph")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may do without one, and gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigraph-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get()
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lexigraph-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, codec: str = "snappy", apart: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there. Rows lie apart by columns ``apart``.

    Lost executors cost no recomputation behind it. The files go with ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexigraph-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*apart).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path], _paths[id(out)] = spark, path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` gave and that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(id(df), None):
            _delete(_written.pop(path), path)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    _written[path] = spark


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of the shuffles of queries that run inside go as each ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, *apart: str) -> DataFrame:
    """Ends lineage by a table, which, unlike a checkpoint, carries no constraints on: in loops these would only grow."""
    with shuffles_removed(df.sparkSession):
        return durable(df, "cut", "zstd", apart)
