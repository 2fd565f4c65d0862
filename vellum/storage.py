"""Staged tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []
#: Scopes of the thread, or whatever context runs; a pool's work gets its caller's by a copy of the context.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without that setting a local master gets a temporary folder of its own; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="vellum-"))
    return f"file://{_local_root[0]}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out if it comes in fewer parts than there are cores, as a small file does; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@contextmanager
def scope() -> Iterator[None]:
    """What is staged inside is deleted at the end, when all that reads it has been written."""
    own: list[DataFrame] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for df in own:
            discard(df)


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage. A lasting table outlives its scope."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/vellum-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if (scopes := _scopes.get()) and not lasting:
        scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
