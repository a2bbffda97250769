"""Intermediates that several parts of a query read: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="waymark-")
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back: computed once, and safe from lost executors."""
    return kept_at(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def kept_at(df: DataFrame, path: str) -> DataFrame:
    """``kept`` in a folder of the caller's choice within the shared folder."""
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_so_far() -> int:
    """How many intermediates this process has written and not removed; a mark for ``clear``."""
    return len(_kept)


def clear(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Remove the intermediates written after a mark, but the last ones; results that still read them are void then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = max(since, len(_kept) - but_last)
    for path in _kept[since:end]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _kept[since:end]


@atexit.register
def _remove() -> None:
    spark = SparkSession.getActiveSession() if _kept else None
    if spark is not None and spark.sparkContext._jsc is not None:
        clear(spark)
