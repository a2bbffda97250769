"""Forgetting, retention, re-reading, duplicates, classification, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width to height of device screens, the tolerance, suffixes of lossless images, and the screenshot name pattern.
SCREEN_SHAPES = ((9, 16), (9, 19), (9, 195), (9, 20), (9, 21), (16, 9), (19, 9), (195, 9), (20, 9), (21, 9), (3, 4), (4, 3))
SHAPE_TOLERANCE = 0.02
LOSSLESS = (".png", ".bmp", ".webp")
SCREENSHOT_NAME = r"(?i)^(screenshot|screen[ _-]?shot|scr_|shot_|スクリーンショット|screencapture)"


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``: the read side of an upsert."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after the first of their key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("nth > 1").drop("nth")


def touching(captions: DataFrame, photo_ids: DataFrame) -> DataFrame:
    """Captions that hold one of the photographs."""
    hit = captions.select("key", F.explode("photo_ids").alias("photo_id")).join(photo_ids, "photo_id", "left_semi").select("key").distinct()
    return captions.join(hit, "key", "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def thinnable(profiles: DataFrame, newest: int) -> DataFrame:
    """Snapshots (seq, generated_at) that retention may drop: not among the newest and not the first of their month.

    Time is that of the snapshots; of several at one time the later seq is the newer.
    """
    last = profiles.orderBy(F.desc("generated_at"), F.desc("seq")).limit(newest).agg(F.min(F.struct("generated_at", "seq")).alias("from"))
    older = profiles.join(F.broadcast(last), F.struct("generated_at", "seq") < F.col("from")).select("seq", "generated_at")  # one row
    first = older.groupBy(F.date_format("generated_at", "yyyy-MM").alias("month")).agg(F.min_by("seq", F.struct("generated_at", "seq")).alias("seq"))
    return older.join(first.select("seq"), "seq", "left_anti")


def document_keys(photo_ids: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_key): the documents that speak about photographs (photo_id) and stays (key)."""
    own = photo_ids.select(F.explode(F.array(F.concat(F.lit("single:"), "photo_id"), F.concat(F.lit("screen:"), "photo_id"))).alias("doc_key"))
    return own.unionByName(keys.select(F.concat(F.lit("stay:"), "key").alias("doc_key")))


#: Tables that a deletion reaches, and their keys.
REACHED = {"photos": "photo_id", "captions": "key", "subjects": "key", "singles": "photo_id", "screens": "photo_id", "documents": "doc_key", "embeddings": "doc_key"}


def reached(tables: dict[str, DataFrame], photo_ids: DataFrame) -> dict[str, DataFrame]:
    """The keys in each table of ``REACHED`` that speak about the known ones of these photographs: stays that hold one, what was read from them, and their documents."""
    known = tables["photos"].select("photo_id").join(photo_ids.select("photo_id"), "photo_id", "left_semi").distinct()
    keys = touching(tables["captions"], known).select("key").distinct()
    gone = {"photo_id": known, "key": keys, "doc_key": document_keys(known, keys)}
    return {name: tables[name].join(gone[key], key, "left_semi").select(key).distinct() for name, key in REACHED.items() if name in tables}


def forget(tables: dict[str, DataFrame], photo_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without all that speaks about the photographs."""
    gone = reached(tables, photo_ids)
    return {name: without(df, gone[name], REACHED[name]) if name in gone else df for name, df in tables.items()}


def forget_counts(tables: dict[str, DataFrame], photo_ids: DataFrame) -> DataFrame:
    """(what, gone, left): rows of each table that a deletion takes and leaves. Nothing is deleted."""
    gone, out = reached(tables, photo_ids), None
    for name, key in REACHED.items():
        if name in tables:
            rows = tables[name].join(gone[name].withColumn("gone", F.lit(1)), key, "left")
            one = rows.agg(F.lit(name).alias("what"), F.count("gone").alias("gone"), (F.count("*") - F.count("gone")).alias("left"))
            out = one if out is None else out.unionByName(one)
    return out


def old_refusals(readings: DataFrame, before: Column) -> DataFrame:
    """Refused readings (refused, created_at) made before a moment."""
    return readings.filter(F.col("refused").isNotNull() & (F.col("created_at") < before))


def retention_counts(photos: DataFrame, refusable: dict[str, DataFrame], profiles: DataFrame, photos_before: Column, refusals_before: Column, newest: int) -> DataFrame:
    """(what, n): photographs, refusals and kept profiles that the rules would let go."""
    out = photos.filter(F.col("t") < photos_before).agg(F.lit("photographs").alias("what"), F.count("*").alias("n"))
    refused = None
    for df in refusable.values():
        one = old_refusals(df, refusals_before).select("created_at")
        refused = one if refused is None else refused.unionByName(one)
    out = out.unionByName(refused.agg(F.lit("refusals").alias("what"), F.count("*").alias("n")))
    return out.unionByName(thinnable(profiles, newest).agg(F.lit("profiles").alias("what"), F.count("*").alias("n")))


def retained(tables: dict[str, DataFrame], profiles: DataFrame, photos_before: Column, refusals_before: Column, newest: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and kept profiles after retention: old photographs go with all that speaks about them, old refusals and surplus profiles go alone."""
    left = forget(tables, tables["photos"].filter(F.col("t") < photos_before).select("photo_id"))
    old = lambda df: F.coalesce(F.col("refused").isNotNull() & (F.col("created_at") < refusals_before), F.lit(False))
    left = {name: df.filter(~old(df)) if {"refused", "created_at"} <= set(df.columns) else df for name, df in left.items()}
    return left, without(profiles, thinnable(profiles, newest), "seq")


def cleared(readings: DataFrame, current: str) -> DataFrame:
    """Readings without those that another version answered and those that may be tried again: both are read anew."""
    again = F.coalesce(F.col("refused").startswith("no thumbnail"), F.lit(False))
    old = F.col("refused").isNull() & (F.col("version").isNull() | (F.col("version") != current))
    return readings.filter(~(again | old))


def privacy_counts(photos: DataFrame, captions: DataFrame, singles: DataFrame, screens: DataFrame, subjects: DataFrame, profiles: DataFrame, corrections: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(what, n): the thirteen counts that tell an owner how the library treats them. Readings have ``refused``, screens also ``labels``."""
    counted = [
        (photos, {"photographs": F.lit(True), "located": F.col("lat").isNotNull(), "withheld_from_preference": ~F.coalesce("preference", F.lit(True))}),
        (captions, {"stay_captions": F.lit(True), "stay_refused": F.col("refused").isNotNull()}),
        (singles, {"single_captions": F.lit(True), "single_refused": F.col("refused").isNotNull()}),
        (screens, {"screen_readings": F.lit(True), "screens_label_silent": F.col("refused").isNull() & (F.size("labels") == 0)}),
        (subjects, {"subject_readings": F.lit(True)}), (profiles, {"kept_profiles": F.lit(True)}), (corrections, {"corrections": F.lit(True)}), (exclusions, {"active_exclusions": F.lit(True)}),
    ]
    out = None
    for df, tests in counted:
        one = df.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
        one = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in tests))).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out


def outdated(readings: DataFrame, current: str) -> DataFrame:
    """Answered readings made by no or by another version."""
    return readings.filter(F.col("refused").isNull() & (F.col("version").isNull() | (F.col("version") != current)))


def recoverable(readings: DataFrame) -> DataFrame:
    return readings.filter(F.col("refused").startswith("no thumbnail"))


def content_kind(name: Column, suffix: Column, camera: Column, width: Column, height: Column) -> Column:
    """screenshot, photo or other: by name, then camera metadata, then the shape of a lossless image."""
    ratio = F.when((width > 0) & (height > 0), width / height)
    shape = F.lit(False)
    for a, b in SCREEN_SHAPES:
        shape = shape | (F.abs(ratio - a / b) < SHAPE_TOLERANCE)
    return F.when(F.regexp_like(name, F.lit(SCREENSHOT_NAME)), "screenshot").when(camera, "photo").when(F.lower(suffix).isin(*LOSSLESS) & F.coalesce(shape, F.lit(False)), "screenshot").otherwise("other")


def export(profile: DataFrame) -> DataFrame:
    """Interests without places, dated by month."""
    month = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM")
    return profile.filter(~F.col("topic").startswith("place:")).select("topic", "score", "confidence", month("first_at").alias("first_month"), month("last_at").alias("last_month"))
