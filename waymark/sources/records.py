"""Producers' files: photograph records, daily activity, place names; checks that set bad rows apart; a synthetic library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.globs import excluded

RECORD = "id string, captured_at string, location struct<lat:double,lon:double>, kind string, thumbnail string, consent struct<use_for_story:boolean,use_for_preferences:boolean>"
ID_PATTERN = r"^sha256:[0-9a-f]{64}$"
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def photo_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of documents that hold a ``records`` list; a byte order mark is fine."""
    return spark.read.schema(f"schema_version string, owner string, records array<struct<{RECORD.replace(' string', ':string').replace(' struct', ':struct')}>>").option("multiLine", True).json(path).select("owner", F.inline("records"))


def instant(iso: Column) -> Column:
    """Microseconds of an ISO time with an offset."""
    return F.unix_micros(F.try_to_timestamp(iso))


def wall_clock(iso: Column) -> Column:
    """Microseconds of the time as written, the offset put aside."""
    return F.unix_micros(F.try_to_timestamp(F.concat(F.substring(iso, 1, 19), F.lit("Z"))))


def observations(records: DataFrame) -> DataFrame:
    """Photographs whose story consent is not refused, with both readings of time and flat columns."""
    return records.filter(F.coalesce("consent.use_for_story", F.lit(True))).select(
        F.col("id").alias("photo_id"), F.col("owner").alias("owner_id"), instant(F.col("captured_at")).alias("t"), wall_clock(F.col("captured_at")).alias("lt"),
        F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), "kind", F.col("consent.use_for_preferences").alias("preference"), "thumbnail",
    )


def defects(records: DataFrame) -> DataFrame:
    """Records with ``defects``: bad id, repeated id, bad time, half or impossible location."""
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("id").orderBy("captured_at")) > 1
    where = F.col("location")
    found = F.array(
        F.when(~F.coalesce(F.regexp_like("id", F.lit(ID_PATTERN)), F.lit(False)), "identifier"),
        F.when(again, "repeated identifier"),
        F.when(~F.coalesce(F.regexp_like("captured_at", F.lit(TIME_PATTERN)), F.lit(False)) | instant(F.col("captured_at")).isNull(), "timestamp"),
        F.when(where.isNotNull() & (where["lat"].isNull() | where["lon"].isNull() | ~where["lat"].between(-90, 90) | ~where["lon"].between(-180, 180)), "location"),
    )
    return records.withColumn("defects", F.array_compact(found))


def daily_activity(spark: SparkSession, path: str) -> DataFrame:
    """Valid days of a bare list: steps within 0..200000, no negative distance or floors; unknown fields are left out."""
    rows = spark.read.schema("day string, steps long, distance_m double, floors long").option("multiLine", True).json(path)
    rows = rows.withColumn("day", F.try_to_date("day"))
    return rows.filter(F.col("day").isNotNull() & F.col("steps").between(0, 200_000) & (F.coalesce("distance_m", F.lit(0.0)) >= 0) & (F.coalesce("floors", F.lit(0)) >= 0))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """label, lat, lon, country of tab-separated place names; short and unreadable rows go, the plain name is preferred."""
    c = F.split("value", "\t", -1)
    rows = spark.read.text(path).filter(F.size(c) >= 9).select(
        F.coalesce(F.nullif(F.trim(F.get(c, 2)), F.lit("")), F.trim(F.get(c, 1))).alias("label"), F.get(c, 4).try_cast("double").alias("lat"), F.get(c, 5).try_cast("double").alias("lon"), F.get(c, 8).alias("country")
    )
    return rows.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("label") != ""))


def image_files(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """path, length and content id of image files below a folder, one of each content, in path order; globs of ``exclude`` match the path below it or the file name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.regexp_like("path", F.lit(r"(?i)\.(jpe?g|png|hei[cf]|webp|bmp|tiff?)$")))
    if exclude:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
        rows = rows.filter(~excluded(F.substring("path", len(root) + 2, 2**31 - 1), exclude))
    return rows.withColumn("id", F.concat(F.lit("sha256:"), F.sha2("content", 256))).groupBy("id").agg(F.min("path").alias("path"), F.min("length").alias("length"))


def ingest(records: DataFrame, accepted: str, skipped: str) -> None:
    """Write sound records and, with their ``defects``, the skipped ones as JSON lines to two folders."""
    rows = defects(records)
    rows.filter(F.size("defects") == 0).drop("defects").write.json(accepted)
    rows.filter(F.size("defects") > 0).write.json(skipped)


def demo_library(spark: SparkSession, now_us: int, days: int = 120) -> DataFrame:
    """A made-up library: two outings a week between a home, a park and a far town; fixed by ``now_us``."""
    day = 86_400_000_000
    rows = spark.range(days * 6).select(F.col("id"), F.floor(F.col("id") / 6).alias("d"), (F.col("id") % 6).alias("i")).filter((F.col("d") % 7).isin(2, 5))
    spot = F.when(F.col("d") % 21 == 5, F.struct(F.lit(36.2).alias("lat"), F.lit(136.0).alias("lon"))).when(F.col("d") % 7 == 2, F.struct(F.lit(35.0).alias("lat"), F.lit(135.0).alias("lon"))).otherwise(F.struct(F.lit(35.1).alias("lat"), F.lit(135.0).alias("lon")))
    t = F.lit(now_us) - (F.lit(days) - F.col("d")) * day + F.col("i") * 300_000_000
    return rows.select(F.concat(F.lit("demo-"), "id").alias("photo_id"), F.lit(0).cast("long").alias("owner_id"), t.alias("t"), t.alias("lt"), spot["lat"].alias("lat"), spot["lon"].alias("lon"), F.lit("photo").alias("kind"), F.lit(None).cast("boolean").alias("preference"))


def demo_readings(library: DataFrame) -> DataFrame:
    """Readings (key, labels, at in seconds) of the made-up library: one a day and site, with labels of the site."""
    site = F.when(F.col("lat") > 36, F.array(F.lit("temple"), F.lit("hill"))).when(F.col("lat") > 35.05, F.array(F.lit("park"), F.lit("dog"))).otherwise(F.array(F.lit("kitchen")))
    day = F.floor(F.col("t") / 86_400_000_000)
    return library.groupBy("owner_id", day.alias("day"), "lat", "lon").agg(F.min("t").alias("t")).select(F.concat_ws("-", F.lit("demo"), "owner_id", "day", F.round(F.col("lat") * 10).cast("int")).alias("key"), site.alias("labels"), F.floor(F.col("t") / 1_000_000).alias("at"))


def demo_profiles(readings: DataFrame, every_days: int = 30) -> DataFrame:
    """Kept profiles (seq, topic, score, confidence, refs) of the made-up readings: one after each span of days, over all readings until then."""
    first = readings.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    step = every_days * 86_400
    cuts = first.select(F.explode(F.sequence(F.lit(1), F.greatest(F.ceil((F.col("last") - F.col("first") + 1) / step).cast("int"), F.lit(1)))).alias("seq"), "first")
    rows = readings.join(F.broadcast(cuts), F.col("at") < F.col("first") + F.col("seq") * step)  # a row each span
    g = rows.select("seq", "key", F.explode("labels").alias("topic")).groupBy("seq", "topic").agg(F.countDistinct("key").alias("n"), F.min("key").alias("ref"))
    return g.select("seq", "topic", (F.col("n") / (F.col("n") + 2)).alias("score"), (F.col("n") / (F.col("n") + 4)).alias("confidence"), F.array("ref").alias("refs"))
