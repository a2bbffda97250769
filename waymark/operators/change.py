"""What changed between kept profiles: trend, lifecycle, insights, discovery, comparison, pairs and suggestions.

History: seq, generated_at (date), topic, score, confidence, refs. Snapshots are few; each has one row per topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.operators.orders import with_rank


def through_themes(history: DataFrame, themes: DataFrame) -> DataFrame:
    """History with ``topic`` replaced by its theme; of themes that share a member the later one counts."""
    last = themes.groupBy(F.col("member").alias("topic")).agg(F.max_by("theme", "pos").alias("theme"))
    return history.join(last, "topic", "left").withColumn("topic", F.coalesce("theme", "topic")).drop("theme")


def baseline_pair(history: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One row: latest and baseline snapshot, the last one that is old enough; none while the history is too short."""
    snaps = history.select("seq", "generated_at").distinct()
    latest = snaps.agg(F.max("seq").alias("latest"), F.max_by("generated_at", "seq").alias("latest_at"))
    old = snaps.join(F.broadcast(latest)).filter(F.datediff("latest_at", "generated_at") >= cfg.trend_span_days)
    return old.groupBy("latest", "latest_at").agg(F.max("seq").alias("baseline"), F.max_by("generated_at", "seq").alias("baseline_at"))


def trend(history: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """topic, direction, strength and baseline between the baseline and the latest snapshot. ``history`` is read through themes."""
    pair = F.broadcast(baseline_pair(history, cfg))
    rows = history.join(pair, (F.col("seq") == F.col("latest")) | (F.col("seq") == F.col("baseline"))).withColumn("power", F.col("score") * F.col("confidence"))
    per = rows.groupBy("topic").agg(F.max(F.when(F.col("seq") == F.col("latest"), F.col("power"))).alias("s"), F.max(F.when(F.col("seq") == F.col("baseline"), F.col("power"))).alias("b"))
    d = F.col("s") - F.col("b")
    way = F.when(F.col("b").isNull(), "new").when(F.col("s").isNull(), "faded").when(d > cfg.trend_delta, "rising").when(d < -cfg.trend_delta, "declining").otherwise("steady")
    return per.select("topic", way.alias("direction"), F.coalesce("s", F.lit(0.0)).alias("strength"), F.coalesce("b", F.lit(0.0)).alias("baseline"))


STAGES = {"rising": "growing", "declining": "declining", "steady": "stable", "faded": "dormant"}


def lifecycles(history: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """topic, stage, strength, baseline and the number of snapshots that hold it."""
    pair = F.broadcast(baseline_pair(history, cfg))
    seen = history.join(pair).groupBy("topic").agg(F.countDistinct("seq").alias("seen_profiles"), F.max(F.col("seq") < F.col("baseline")).alias("before"))
    rows = seen.join(trend(history, cfg), "topic", "full_outer")
    stage = F.when(F.col("direction") == "new", F.when(F.coalesce("before", F.lit(False)), "returned").otherwise("new"))
    for way, name in STAGES.items():
        stage = stage.when(F.col("direction") == way, name)
    stage = stage.when(F.col("before"), "dormant")
    return rows.withColumn("stage", stage).filter("stage is not null").select("topic", "stage", F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"), "seen_profiles", F.col("direction").isNotNull().alias("in_trend"))


# Novelty by kind of finding.
NOVELTY = {"new": 1.0, "returned": 0.85, "rising": 0.7, "declining": 0.6, "dormant": 0.4, "enduring": 0.3}


def insights(history: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """topic, kind, magnitude, novelty, confidence, evidence. The evidence comes from the latest snapshot."""
    c = lifecycles(history, cfg)
    kind = (
        F.when(F.col("stage").isin("new", "returned"), F.col("stage")).when(F.col("stage") == "growing", "rising").when(F.col("stage") == "declining", "declining")
        .when((F.col("stage") == "dormant") & F.col("in_trend"), "dormant").when((F.col("stage") == "stable") & (F.col("strength") >= cfg.enduring_strength), "enduring")
    )
    size = F.when(F.col("kind").isin("rising", "declining"), F.abs(F.col("strength") - F.col("baseline"))).when(F.col("kind") == "dormant", F.col("baseline")).otherwise(F.col("strength"))
    novelty: Column = F.lit(None).cast("double")
    for k, v in NOVELTY.items():
        novelty = F.when(F.col("kind") == k, v).otherwise(novelty)
    latest = history.join(F.broadcast(history.agg(F.max("seq").alias("last"))), F.col("seq") == F.col("last"))
    ground = latest.groupBy("topic").agg(F.max("confidence").alias("confidence"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))), 1, cfg.insight_evidence_cap).alias("evidence"))
    rows = c.withColumn("kind", kind).filter("kind is not null").join(ground, "topic", "left")
    return rows.select("topic", "kind", size.alias("magnitude"), novelty.alias("novelty"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


# The order of lifecycle stages and of changes.
STAGE_ORDER = ("new", "returned", "growing", "declining", "dormant", "stable")
CHANGE_ORDER = ("appeared", "gone", "stronger", "weaker", "steady")


def _place_in(value: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in order)), F.col(value)).asc()


def trend_in_order(trend: DataFrame) -> DataFrame:
    """Trends with ``rank``: the largest change first; differences beyond twelve digits are none."""
    return with_rank(trend, F.desc(F.round(F.abs(F.col("strength") - F.col("baseline")), 12)), F.asc("topic"))


def lifecycles_in_order(lifecycles: DataFrame) -> DataFrame:
    return with_rank(lifecycles, _place_in("stage", STAGE_ORDER), F.desc(F.round("strength", 12)), F.asc("topic"))


def comparison_in_order(comparison: DataFrame) -> DataFrame:
    return with_rank(comparison, _place_in("change", CHANGE_ORDER), F.desc(F.round(F.abs(F.col("after") - F.col("before")), 12)), F.asc("topic"))


def discoveries(insights: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The findings of most novelty times importance."""
    importance = F.least(F.lit(1.0), "magnitude") * F.least(F.lit(1.0), F.size("evidence") / cfg.importance_full)
    return insights.withColumn("importance", importance).orderBy(F.desc(F.col("novelty") * F.col("importance")), "topic").limit(cfg.feed_limit)


def compare(history: DataFrame, before: int, after: int, cfg: Settings = DEFAULT) -> DataFrame:
    """topic, change, strengths and evidence counts of two snapshots, with the first references."""
    one = history.filter(F.col("seq").isin(before, after)).withColumn("power", F.col("score") * F.col("confidence"))
    at = lambda s, c: F.when(F.col("seq") == s, F.col(c))
    per = one.withColumn("n", F.size("refs")).groupBy("topic").agg(
        F.max(at(before, "power")).alias("b"), F.max(at(after, "power")).alias("a"), F.coalesce(F.sum(at(before, "n")), F.lit(0)).alias("evidence_before"), F.coalesce(F.sum(at(after, "n")), F.lit(0)).alias("evidence_after"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(at(after, "refs"))))), 1, cfg.compare_refs).alias("refs"),
    )
    d = F.col("a") - F.col("b")
    change = F.when(F.col("b").isNull(), "appeared").when(F.col("a").isNull(), "gone").when(d > cfg.trend_delta, "stronger").when(d < -cfg.trend_delta, "weaker").otherwise("steady")
    return per.select("topic", change.alias("change"), F.coalesce("b", F.lit(0.0)).alias("before"), F.coalesce("a", F.lit(0.0)).alias("after"), "evidence_before", "evidence_after", "refs")


def mixed_pairs(insights: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Held and rising topics of the largest products."""
    held = insights.filter("kind = 'enduring'").select(F.col("topic").alias("held"), F.col("magnitude").alias("m1"))
    up = insights.filter("kind = 'rising'").select(F.col("topic").alias("rising"), F.col("magnitude").alias("m2"))
    rows = held.join(F.broadcast(up.orderBy(F.desc("m2"), "rising").limit(cfg.mixed_limit + 1)), F.col("held") != F.col("rising"))  # the best products need no other rising topics
    return rows.withColumn("product", F.col("m1") * F.col("m2")).orderBy(F.desc(F.round("product", 12)), "held", "rising").limit(cfg.mixed_limit)


def revivals(lifecycles: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Dormant topics that were seen often enough: by former strength."""
    rows = lifecycles.filter((F.col("stage") == "dormant") & (F.col("seen_profiles") >= cfg.min_seen))
    rows = rows.select(F.col("topic").alias("reference"), "seen_profiles", "baseline", F.least(F.lit(1.0), F.col("seen_profiles") / cfg.suggestion_full).alias("confidence"))
    return with_rank(rows, F.desc("baseline"), F.asc("reference"))


def suggestions(revisits: DataFrame, revivals: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(owner_id, rank, kind, reference, confidence): an owner's overdue places, most overdue first, then dormant topics; one cap over both."""
    a = revisits.select("owner_id", F.lit("revisit").alias("kind"), "reference", "confidence", (-F.col("ratio")).alias("order"))
    b = revivals.select("owner_id", F.lit("revive").alias("kind"), "reference", "confidence", F.col("rank").cast("double").alias("order"))
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.when(F.col("kind") == "revisit", 0).otherwise(1), "order", "reference"))
    return a.unionByName(b).withColumn("rank", rank).filter(F.col("rank") <= cfg.suggestion_cap).select("owner_id", "rank", "kind", "reference", "confidence")


def annotate(suggestions: DataFrame, notes: DataFrame) -> DataFrame:
    """Suggestions with the first note on their reference; notes never add a suggestion."""
    w = Window.partitionBy("reference", "source").orderBy("seq")
    first = notes.withColumn("nth", F.row_number().over(w)).filter("nth = 1").groupBy("reference").agg(F.sort_array(F.collect_list("note")).alias("notes"))
    return suggestions.join(first, "reference", "left")
