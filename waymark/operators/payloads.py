"""Results as JSON documents for readers outside: each is one row, as large as the profile, report or answer that it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.keys import blurred, source_of
from waymark.operators.orders import strength

# The name and version of the interest export.
EXPORT_SCHEMA, EXPORT_VERSION = "waymark-interest-export", 1


def _iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def _month(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def _listed(df: DataFrame, order: str, item: Column) -> Column:
    """The items of all rows in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item")))), lambda x: x["item"])


def profile_payload(profile: DataFrame, generated_at: str, blur: bool = False) -> DataFrame:
    """profile: rank, topic, score, confidence, first_at, last_at (seconds), evidence (references)."""
    see = blurred if blur else lambda c: c
    proof = F.transform("evidence", lambda r: F.struct(source_of(r).alias("kind"), see(r).alias("reference")))
    item = F.struct(see(F.col("topic")).alias("topic"), "score", "confidence", _iso(F.col("first_at")).alias("first_seen"), _iso(F.col("last_at")).alias("last_seen"), proof.alias("evidence"))
    return profile.agg(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), _listed(profile, "rank", item).alias("interests"))).alias("payload"))


def trend_payload(trend: DataFrame, baseline_at: str, latest_at: str, blur: bool = False) -> DataFrame:
    """trend: rank, topic, direction, strength, baseline."""
    topic = blurred(F.col("topic")) if blur else F.col("topic")
    item = F.struct(topic.alias("topic"), "direction", "strength", "baseline")
    return trend.agg(F.to_json(F.struct(F.lit(baseline_at).alias("baseline_at"), F.lit(latest_at).alias("latest_at"), _listed(trend, "rank", item).alias("trends"))).alias("payload"))


def answer_payloads(answers: DataFrame) -> DataFrame:
    """(query_id, payload), a document for each answer of ``asking.ask``; without ground the answer is null."""
    moment = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss")
    told = F.when(F.col("n") > 0, F.col("answer")) if "answer" in answers.columns else F.lit(None).cast("string")
    body = F.struct("question", told.alias("answer"), "confidence", moment("first_seen").alias("first_seen"), moment("last_seen").alias("last_seen"), "evidence", F.col("supporting").alias("supporting_insights"))
    return answers.select("query_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def export_document(profile: DataFrame, lifecycles: DataFrame, exported_on: str) -> DataFrame:
    """One row: interests by strength and lifecycle stages, without places and dated by month. profile: topic, score, confidence, first_at, last_at (seconds); lifecycles: rank, topic, stage."""
    no_place = ~F.col("topic").startswith("place:")
    mine = profile.filter(no_place).withColumn("o", F.struct((-strength()).alias("strength"), "topic"))
    item = F.struct("topic", "score", "confidence", _month(F.col("first_at")).alias("first_seen"), _month(F.col("last_at")).alias("last_seen"))
    interests = mine.agg(_listed(mine, "o", item).alias("interests"))
    stages = lifecycles.filter(no_place).agg(_listed(lifecycles, "rank", F.struct("topic", "stage")).alias("lifecycles"))
    head = (F.lit(EXPORT_SCHEMA).alias("schema"), F.lit(EXPORT_VERSION).alias("version"), F.lit(exported_on).alias("exported_on"))
    return interests.join(F.broadcast(stages)).select(F.to_json(F.struct(*head, "interests", "lifecycles")).alias("payload"))  # one row each
