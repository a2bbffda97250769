"""Photographs as a stream: files land, owners whose sessions changed are rebuilt whole, so a stream equals a full rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.journeys import numbered_stops, outings, stays
from waymark.sources.catalog import Catalog
from waymark.sources.scratch import kept

PHOTOS = "photo_id string, owner_id long, t long, lt long, lat double, lon double, kind string, preference boolean"


def photo_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PHOTOS).parquet(folder)


def session_counts(stream: DataFrame, lateness: str = "8 hours") -> DataFrame:
    """Photographs per owner and run without a silence of 90 minutes, given out once no later photograph can change it."""
    rows = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", lateness)
    return rows.groupBy("owner_id", F.session_window("ts", "90 minutes")).agg(F.count("*").alias("n")).select("owner_id", F.col("session_window.start").alias("begun"), "n")


def keep_journeys(stream: DataFrame, catalog: Catalog, checkpoint: str):
    """Put each batch into ``photos`` and rebuild ``outings`` of the owners it touches, in the owners' buckets alone.

    A batch that is run again gives the same tables. A photograph that comes again takes the place of the first.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df = kept(df, "batch")
        touched = [r[0] for r in df.select(Catalog.bucket(F.col("owner_id"))).distinct().collect()]  # buckets, a fixed number at most
        if not touched:
            return
        owners = df.select("owner_id").distinct()
        fresh = df.groupBy("photo_id").agg(F.max(F.struct(*df.columns)).alias("r")).select("r.*")
        stored = catalog.read_buckets("photos", touched)
        if stored is not None:
            fresh = stored.join(fresh.select("photo_id"), "photo_id", "left_anti").select(*df.columns).unionByName(fresh)
        photos = kept(fresh, "photos")
        journeys = outings(numbered_stops(stays(photos.join(owners, "owner_id", "left_semi"))))
        old = catalog.read_buckets("outings", touched) if catalog.exists("outings") else None
        if old is not None:
            journeys = old.join(owners, "owner_id", "left_anti").select(*journeys.columns).unionByName(journeys)
        catalog.replace_buckets("outings", journeys, "owner_id", touched)
        catalog.replace_buckets("photos", photos, "owner_id", touched)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
