"""Stages that ask a model: what a run looks at and why, the calls in tasks, results committed wave by wave.

A selection has a row for everything a stage looks at, oldest first: key, request, status (``pending``, ``already``, ``unreferenced``,
``withheld``) and nth, its place in the order. A run takes the pending ones in that order, at most ``limit`` of them, and asks wave by wave: a wave is
one Spark job over up to ``wave`` requests, written under a name made of its keys before the next begins. A run of more than ``WAVES`` such waves has
``WAVES`` larger ones, as each costs a few seconds of its own whatever it holds. A run that is killed keeps its waves, the same wave written again replaces itself, and the next run goes on with what has no result. A model that
becomes unavailable ends the run as paused; what was answered in its wave is kept, the rest stays pending. Any other error of the model ends
the run and is raised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.keys import content_key
from waymark.operators.models import CAPTIONED_KINDS, Unavailable, parse_labels, representatives
from waymark.operators.orders import with_rank
from waymark.sources.scratch import kept
from waymark.sources.shipping import ship

#: Photographs of a stay that a model sees, and requests in a wave and in a call.
IMAGES, WAVE, BATCH = 3, 1000, 32
#: Waves of a run, at most: a killed run loses a share of 1 in WAVES, or ``wave`` requests.
WAVES = 32
RESULT = "key string, text string, refused string, version string"


class Report(NamedTuple):
    """What a run did. ``done`` and ``refused`` are this run's; the others are what lies before the last request that it may ask."""

    done: int
    already: int
    refused: int
    unreferenced: int
    withheld: int
    paused: bool


def _may() -> Column:
    return F.coalesce(F.col("preference"), F.lit(True))


def _selection(rows: DataFrame, done: DataFrame, *order: Column) -> DataFrame:
    """key, request, status, nth; rows: key (null where nothing may be asked), request, why (the status of these)."""
    known = done.select(F.col("key").alias("known")).distinct()
    rows = rows.join(known, F.col("key") == F.col("known"), "left")
    status = F.when(F.col("key").isNull(), F.col("why")).when(F.col("known").isNotNull(), "already").otherwise("pending")
    rows = with_rank(rows.withColumn("status", status), *order, name="nth")
    again = (F.col("status") == "pending") & (F.row_number().over(Window.partitionBy("key", "status").orderBy("nth")) > 1)  # the first of a key is the one that asks
    return rows.select("key", "request", F.when(again, "already").otherwise(F.col("status")).alias("status"), "nth")


def stay_selection(stays: DataFrame, photos: DataFrame, done: DataFrame, images: int = IMAGES) -> DataFrame:
    """Stays with the photographs that a model would see; request: their ids, in order, joined by blanks.

    Photographs need a thumbnail and no withheld consent. A stay left with none is withheld if one of its photographs was, else
    unreferenced. photos: photo_id, t, preference, thumbnail.
    """
    told = photos.select("photo_id", F.col("t"), (_may() & F.col("thumbnail").isNotNull()).alias("fit"), (~_may()).alias("held"))
    each = stays.select("stop", "t0", F.explode("photo_ids").alias("photo_id")).join(told, "photo_id")
    each = kept(each, "stage-photos")
    seen = representatives(each.filter("fit").select("stop", "photo_id", "t"), images)
    seen = seen.groupBy("stop").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "photo_id"))), lambda x: x["photo_id"]).alias("ids"))
    rows = each.groupBy("stop", "t0").agg(F.bool_or("held").alias("held")).join(seen, "stop", "left")
    rows = rows.select(F.when(F.col("ids").isNotNull(), content_key(F.col("ids"))).alias("key"), F.array_join("ids", " ").alias("request"), F.when(F.col("held"), "withheld").otherwise("unreferenced").alias("why"), "t0", "stop")
    return _selection(rows, done, F.asc("t0"), F.asc("stop"))


def _photo_selection(rows: DataFrame, done: DataFrame) -> DataFrame:
    why = F.when(~_may(), "withheld").otherwise("unreferenced")
    rows = rows.select(F.when(_may() & F.col("thumbnail").isNotNull(), F.col("photo_id")).alias("key"), F.col("thumbnail").alias("request"), why.alias("why"), "t", "photo_id")
    return _selection(rows, done, F.asc("t"), F.asc("photo_id"))


def screen_selection(photos: DataFrame, done: DataFrame) -> DataFrame:
    """Screenshots: photo_id, t, kind, preference, thumbnail. Withheld ones are counted and never shown to a model."""
    return _photo_selection(photos.filter("kind = 'screenshot'"), done)


def single_selection(photos: DataFrame, stays: DataFrame, done: DataFrame) -> DataFrame:
    """Photographs of a fitting kind outside all stays; withheld ones are no part of it."""
    alone = photos.filter(F.coalesce(F.col("kind").isin(*CAPTIONED_KINDS), F.lit(True)) & _may())
    return _photo_selection(alone.join(stays.select(F.explode("photo_ids").alias("photo_id")).distinct(), "photo_id", "left_anti"), done)


def subject_selection(captions: DataFrame, singles: DataFrame, done: DataFrame) -> DataFrame:
    """Answered captions by their keys, then answered single photographs by the key of the one photograph. captions: key, text; singles: photo_id, text."""
    one = captions.filter("text is not null").select(F.lit(0).alias("part"), "key", F.col("text").alias("request"))
    two = singles.filter("text is not null").select(F.lit(1).alias("part"), content_key(F.array("photo_id")).alias("key"), F.col("text").alias("request"))
    return _selection(one.unionByName(two).withColumn("why", F.lit(None).cast("string")), done, F.asc("part"), F.asc("key"), F.asc("request"))


def within(selection: DataFrame, limit: int | None) -> DataFrame:
    """What a run of ``limit`` requests looks at: everything up to the last one it may ask."""
    if limit is None:
        return selection
    last = selection.filter("status = 'pending'").orderBy("nth").limit(limit).agg(F.max("nth").alias("last"), F.count("*").alias("asked"))
    return selection.join(F.broadcast(last), (F.col("asked") < limit) | (F.col("nth") <= F.col("last"))).drop("last", "asked")  # one row


def run(selection: DataFrame, model: Callable[[list[str]], list[tuple[str | None, str | None]]], store: str, version: str, limit: int | None = None, wave: int = WAVE, batch: int = BATCH) -> Report:
    """Ask ``model`` for the pending requests and write (``RESULT``) below ``store``, a folder a wave.

    ``model`` takes requests and gives (text, refusal) for each; it runs in tasks.
    """
    spark = selection.sparkSession
    ship(spark)
    looked = kept(within(selection, limit), "stage-selection")
    counts = {r["status"]: r["n"] for r in looked.groupBy("status").agg(F.count("*").alias("n")).collect()}
    pending = kept(with_rank(looked.filter("status = 'pending'"), F.asc("nth"), name="turn"), "stage-pending")
    done = refused = 0
    paused = False

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                try:
                    got = model(part["request"].tolist())
                except Unavailable:
                    yield pd.DataFrame({"key": [None], "text": [None], "refused": [None], "version": [None]})
                    return
                yield pd.DataFrame({"key": part["key"].tolist(), "text": [g[0] for g in got], "refused": [g[1] for g in got], "version": version})

    wave = max(wave, -(-counts.get("pending", 0) // WAVES))
    tasks = max(1, min(wave // batch, 4 * spark.sparkContext.defaultParallelism))
    for first in range(0, counts.get("pending", 0), wave):
        some = pending.filter((F.col("turn") > first) & (F.col("turn") <= first + wave))
        name = hashlib.sha256(repr([tuple(r) for r in some.agg(F.min("key"), F.max("key"), F.sum(F.xxhash64("key").cast("decimal(38,0)")), F.count("*")).collect()]).encode()).hexdigest()[:16]
        answers = kept(some.select("key", "request").repartition(tasks, "key").mapInPandas(ask, RESULT), "stage-answers")
        answers.filter("key is not null").write.mode("overwrite").parquet(f"{store.rstrip('/')}/wave={name}")
        here = answers.agg(F.count_if(F.col("key").isNotNull() & F.col("refused").isNull()).alias("done"), F.count_if(F.col("refused").isNotNull()).alias("refused"), F.count_if(F.col("key").isNull()).alias("stopped")).first()
        done, refused = done + here["done"], refused + here["refused"]
        if here["stopped"]:
            paused = True
            break
    return Report(done, counts.get("already", 0), refused, counts.get("unreferenced", 0), counts.get("withheld", 0), paused)


def results(spark, store: str) -> DataFrame:
    """Everything that runs have written; without any run, no row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(store).dropDuplicates(["key"])


def read_subjects(answers: DataFrame) -> DataFrame:
    """key, labels, refused of subject answers; an answer without a readable list is a refusal that quotes its beginning."""
    labels = F.when(F.col("refused").isNull(), F.filter(parse_labels(F.col("text")), lambda x: x.isNotNull()))
    bad = F.col("refused").isNull() & (F.coalesce(F.size(labels), F.lit(0)) <= 0)
    return answers.select("key", F.when(~bad & F.col("refused").isNull(), labels).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(bad, F.concat(F.lit("unparseable answer: "), F.substring("text", 1, 80))).otherwise(F.col("refused")).alias("refused"))
