"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.scratch import clear, kept_so_far  # noqa: F401
from waymark.sources.scratch import kept as stage  # noqa: F401
from waymark.sources.scratch import kept_at as stage_at  # noqa: F401
from waymark.sources.scratch import shared_folder as shared_dir  # noqa: F401
from waymark.sources.shipping import ship  # noqa: F401


def lower_az(text):
    """Lower-case A-Z only, in the JVM."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(doc_id):
    """crc32 of the id written as text; fixes the folds of the learned operators."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names not in ``df`` yet, made from ``wanted`` by appending underscores, so extra columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
