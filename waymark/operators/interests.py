"""Interests from subject labels, themes and screens; profiles and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.keys import SENSITIVE, content_key, is_generic, normalised
from waymark.operators.orders import with_rank
from waymark.sources.scratch import kept


def dated(readings: DataFrame, captions: DataFrame, singles: DataFrame, photos: DataFrame) -> DataFrame:
    """(key, labels, at, reference): answered readings with the second of what they read.

    A reading of a stay is dated by its earliest photograph, one of a single photograph by that, unless it was withheld. Readings
    that were refused, that read something unknown or without a time, or a single photograph that may not inform, stay out.
    readings: key, labels, refused; captions: key, photo_ids; singles: photo_id, text; photos: photo_id, t, preference.
    """
    at = photos.select("photo_id", "t", F.coalesce("preference", F.lit(True)).alias("may"))
    stays = captions.select("key", F.explode_outer("photo_ids").alias("photo_id")).join(at, "photo_id", "left").groupBy("key").agg(F.min("t").alias("stay_t"), F.lit(True).alias("stay"))
    one = singles.filter("text is not null").select("photo_id", content_key(F.array("photo_id")).alias("key")).join(at.filter("may"), "photo_id").groupBy("key").agg(F.min_by(F.struct("t", "photo_id"), "photo_id").alias("one"))
    rows = readings.filter("refused is null").select("key", "labels").join(stays, "key", "left").join(one, "key", "left")
    own = F.coalesce("stay", F.lit(False))
    rows = rows.select("key", "labels", F.floor(F.when(own, F.col("stay_t")).otherwise(F.col("one.t")) / 1_000_000).alias("at"), F.when(own, F.concat(F.lit("caption:"), "key")).otherwise(F.concat(F.lit("photo:"), "one.photo_id")).alias("reference"))
    return rows.filter("at is not null")


def sightings(readings: DataFrame) -> DataFrame:
    """(label, key, at, reference): one a label and reading, generic and empty labels left out. Readings: key, labels, at (seconds), and reference (the key without it)."""
    reference = F.col("reference" if "reference" in readings.columns else "key").alias("reference")
    rows = readings.select("key", "at", reference, F.explode("labels").alias("raw")).select(normalised(F.col("raw")).alias("label"), "key", "at", "reference")
    return rows.filter((F.col("label") != "") & ~is_generic(F.col("label"))).distinct()


def ambient(seen: DataFrame, n_readings: int, cfg: Settings = DEFAULT) -> DataFrame:
    """Labels in more than the ambient share of all readings, once there are enough of these."""
    counts = seen.groupBy("label").agg(F.count("*").alias("n"))
    return counts.filter((F.lit(n_readings) >= cfg.ambient_min_readings) & (F.col("n") / F.lit(float(max(1, n_readings))) > cfg.ambient_share))


def absorbed(seen: DataFrame, common: DataFrame, themes: DataFrame, cfg: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(sightings of themes, labels that no longer speak for themselves).

    A theme needs enough members with sightings that are not ambient; a label of the theme's own name joins it. Per reading the
    earliest sighting counts. Themes (pos, theme, member) are a small table.
    """
    members = themes.filter(~is_generic(F.col("theme"))).join(seen.select(F.col("label").alias("member")).distinct(), "member").join(common.select(F.col("label").alias("member")), "member", "left_anti")
    w = Window.partitionBy("theme")
    members = members.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= cfg.min_members).select("theme", "member")
    twins = members.select("theme").distinct().select("theme", F.col("theme").alias("member"))
    twins = twins.join(seen.select(F.col("label").alias("member")).distinct(), "member", "left_semi").select("theme", "member")
    pairs = members.unionByName(twins).distinct()
    rows = seen.join(pairs.withColumnRenamed("member", "label"), "label").groupBy(F.col("theme").alias("label"), "key").agg(F.min("at").alias("at"), F.min("reference").alias("reference"))
    return rows, pairs.select(F.col("member").alias("label")).distinct()


def _ends(rows: DataFrame, by: str, order: list[str], first: int, last: int) -> DataFrame:
    """The ``first`` and the ``last`` rows of each group, cut on either side of the shuffle, so no group is gathered."""
    up, down = (Window.partitionBy(by).orderBy(*(way(c) for c in order)) for way in (F.asc, F.desc))
    cut = lambda w, n: rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).drop("nth")
    return cut(up, first).unionByName(cut(down, last)).distinct() if last else cut(up, first)


def score_sightings(seen: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """topic, score, confidence, n, first and last sighting, and the references of the first and the latest sightings as evidence."""
    g = seen.groupBy("label").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    some = _ends(seen, "label", ["at", "key"], 1, cfg.evidence_cap - 1).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "key", "reference"))).alias("some"))
    days, n = F.floor((F.col("last_at") - F.col("first_at")) / 86400), F.col("n")
    return g.join(some, "label").select(
        F.col("label").alias("topic"), (n / (n + cfg.subject_score_half)).alias("score"), (n / (n + cfg.subject_confidence_half) * (days / (days + cfg.span_half_days))).alias("confidence"),
        "n", "first_at", "last_at", F.transform("some", lambda s: s["reference"]).alias("evidence"),
    )


def subject_interests(readings: DataFrame, themes: DataFrame | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    seen = kept(sightings(readings), "sightings")
    common = ambient(seen, readings.count(), cfg)
    plain = seen.join(common, "label", "left_anti")
    if themes is None:
        return score_sightings(plain, cfg)
    themed, silent = absorbed(seen, common, themes, cfg)
    return score_sightings(plain.join(silent, "label", "left_anti").select("label", "key", "at", "reference").unionByName(themed), cfg)


def screen_interests(readings: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Readings: photo_id, category, labels, at. Sensitive categories never speak; a label repeated in a reading counts again."""
    rows = readings.filter(~F.col("category").isin(*SENSITIVE)).select("photo_id", "at", F.explode("labels").alias("topic")).filter(~is_generic(F.col("topic")))
    g = rows.groupBy("topic").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).filter(F.col("n") >= cfg.screen_min_count)
    some = _ends(rows, "topic", ["at", "photo_id"], cfg.screen_evidence_cap, 0).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("at", "photo_id"))).alias("some"))
    top = g.agg(F.max("n").alias("peak"))
    return g.join(some, "topic").join(F.broadcast(top)).select(  # one row
        "topic", (F.col("n") / F.col("peak")).alias("score"), F.least(F.lit(1.0), F.col("n") / cfg.screen_full).alias("confidence"), "n", "first_at", "last_at",
        F.transform("some", lambda s: F.concat(F.lit("screen:"), s["photo_id"])).alias("evidence"),
    )


PROFILE = ("topic", "score", "confidence", "first_at", "last_at", "evidence", "section", "pos")


def assembled(places: DataFrame, subjects: DataFrame, screens: DataFrame) -> DataFrame:
    """A profile (``PROFILE``): places in their order, then subjects, then screens in topics that are not there yet.

    places: topic, score, confidence, first_at, last_at, evidence and pos, their place among the places; subjects and screens the same without pos.
    """
    part = lambda df, section: df.withColumns({"section": F.lit(section), "pos": F.col("pos") if "pos" in df.columns else F.lit(0).cast("long")}).select(*PROFILE)
    return merge_by_topic(part(places, 0).unionByName(part(subjects, 1)), part(screens, 2))


def merge_by_topic(profile: DataFrame, added: DataFrame) -> DataFrame:
    """The profile plus interests in topics that it has not."""
    return profile.unionByName(added.join(profile.select("topic"), "topic", "left_anti").select(*profile.columns))


def active_exclusions(corrections: DataFrame) -> DataFrame:
    """References whose latest word is an exclusion; of words at one time the later entry counts."""
    last = corrections.groupBy("reference").agg(F.max_by("verdict", F.struct("created_at", "seq")).alias("verdict"))
    return last.filter("verdict = 'excluded'").select("reference")


def corrected(profile: DataFrame, exclusions: DataFrame, topic: Column | None = None) -> DataFrame:
    """Interests without excluded topics and without excluded evidence; one that has no evidence left goes, scores stay."""
    topic = F.concat(F.lit("topic:"), F.col("topic")) if topic is None else topic
    kept = profile.join(exclusions, topic == F.col("reference"), "left_anti")
    rows = kept.select("*", F.posexplode("evidence").alias("ref_pos", "ref")).join(exclusions, F.col("ref") == F.col("reference"), "left_anti")
    left = rows.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("ref_pos", "ref"))), lambda s: s["ref"]).alias("left"))
    return kept.join(left, "topic").withColumn("evidence", F.col("left")).drop("left")


def ranked(profile: DataFrame) -> DataFrame:
    """Interests with ``rank``: strongest first; equals in the order of assembly where there is one, then by topic."""
    order = [F.asc(c) for c in ("section", "pos") if c in profile.columns]
    return with_rank(profile, F.desc("score"), *order, F.asc("topic"))


def unsound(profile: DataFrame) -> DataFrame:
    """Interests with ``defects``: no topic, score or confidence out of bounds, no evidence, an end before the beginning."""
    share = lambda c: ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    found = F.array(
        F.when(F.coalesce("topic", F.lit("")) == "", "topic"), F.when(share("score"), "score"), F.when(share("confidence"), "confidence"),
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "evidence"), F.when(F.col("first_at") > F.col("last_at"), "span"),
    )
    return profile.withColumn("defects", F.array_compact(found)).filter(F.size("defects") > 0)
