"""Stages behind model ports: what still has to be read, calls in batches, refusals kept as rows, label clustering.

A model is a function from a list of requests to a list of (text, refusal); it runs in tasks over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.sources.shipping import ship


def unread(requests: DataFrame, done: DataFrame, key: str, limit: int | None = None, order: str = "t") -> DataFrame:
    """Requests without a stored reading, oldest first."""
    rows = requests.join(done.select(key), key, "left_anti")
    return rows.orderBy(order, key).limit(limit) if limit else rows


def representatives(stop_photos: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` photographs of a stop (stop, photo_id, t), evenly spread and with both ends; one is the middle one."""
    w = Window.partitionBy("stop")
    rows = stop_photos.withColumns({"i": F.row_number().over(w.orderBy("t", "photo_id")) - 1, "n": F.count("*").over(w)})
    if most == 1:
        return rows.filter(F.col("i") == F.floor(F.col("n") / 2)).drop("i", "n")
    spots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("n") - 1) / (most - 1)).cast("int"))
    return rows.filter((F.col("n") <= most) | F.array_contains(spots, F.col("i").cast("int"))).drop("i", "n")


def ask_model(requests: DataFrame, model: Callable[[list[str]], list[tuple[str | None, str | None]]], key: str, request: str, version: str, batch: int = 32) -> DataFrame:
    """(key, text, refused, version): an answer or a refusal for each request, ``batch`` requests a call."""
    ship(requests.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                got = model(part["request"].tolist())
                yield pd.DataFrame({"key": part["key"].tolist(), "text": [g[0] for g in got], "refused": [g[1] for g in got], "version": version})

    return requests.select(F.col(key).cast("string").alias("key"), F.col(request).alias("request")).mapInPandas(run, "key string, text string, refused string, version string")


def parse_labels(answer: Column, most: int = 5) -> Column:
    """Labels of an answer that holds a JSON list: lower case, trimmed, distinct, at most ``most``; null when there is none."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<string>")
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != "")), 1, most)


def parse_screen(answer: Column, categories: tuple[str, ...], sensitive: tuple[str, ...], most: int = 6) -> Column:
    """(category, labels): an unknown category is ``other``, a sensitive one has no labels."""
    body = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "category string, labels array<string>")
    kind = F.when(F.lower(F.trim(body["category"])).isin(*categories), F.lower(F.trim(body["category"]))).otherwise("other")
    labels = F.slice(F.filter(F.transform(F.coalesce(body["labels"], F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""), 1, most)
    return F.struct(kind.alias("category"), F.when(kind.isin(*sensitive), F.array().cast("array<string>")).otherwise(labels).alias("labels"))


# Words of a theme's name, at most; kinds of photographs that are captioned one by one.
MOST_NAME_WORDS = 3
CAPTIONED_KINDS = ("photo", "other")


def parse_theme_name(answer: Column) -> Column:
    """One short name of a JSON string, a fenced answer or a bare word or three; null for anything longer or empty."""
    bare = F.trim(F.replace(F.replace(answer, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), F.lit(" \t\r\n"))
    line = F.trim(F.get(F.split(bare, r"\r\n|[\n\r]"), 0), F.lit("\"'`[]{} "))
    words = F.filter(F.split(F.lower(F.trim(line)), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words).between(1, MOST_NAME_WORDS), F.array_join(words, " "))


def lone_photographs(photos: DataFrame, stays: DataFrame) -> DataFrame:
    """Photographs outside all stays that may be captioned one by one: of a fitting kind, not withheld, with a thumbnail."""
    told = F.coalesce(F.col("kind").isin(*CAPTIONED_KINDS), F.lit(True)) & F.coalesce("preference", F.lit(True)) & F.col("thumbnail").isNotNull()
    return photos.filter(told).join(stays.select(F.explode("photo_ids").alias("photo_id")).distinct(), "photo_id", "left_anti")


def usage(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens in and out, failures. calls: refused, input_tokens, output_tokens; a refused call counts without its tokens."""
    fine = F.col("refused").isNull()
    tokens = lambda c: F.coalesce(F.sum(F.when(fine, F.col(c))), F.lit(0))
    return calls.agg(F.count("*").alias("calls"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"), F.count_if(~fine).alias("failures"))


class Unavailable(Exception):
    """The model can't be reached now: the stage pauses. Any other error is a refusal of the whole run and is raised."""


def embed(pending: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, chunk: int = 32) -> DataFrame:
    """(doc_key, model, embedding) of pending documents (doc_key, text), ``chunk`` texts a call.

    A part whose model becomes unavailable gives out what it has and leaves the rest pending, so the next run, over the
    documents without a vector, goes on from there.
    """
    ship(pending.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), chunk):
                part = f.iloc[lo : lo + chunk]
                try:
                    vectors = embedder(part["text"].tolist())
                except Unavailable:
                    return
                yield pd.DataFrame({"doc_key": part["doc_key"].tolist(), "model": model, "embedding": vectors})

    return pending.select("doc_key", "text").mapInPandas(run, "doc_key string, model string, embedding array<double>")


def theme_groups(vectors: np.ndarray, stays: list[set], order: list[int], cfg: Settings = DEFAULT) -> list[list[int]]:
    """Labels in order join the most alike group so far: alike enough, or fairly alike and seen on the same stays; small groups go.

    A group is the running sum of its unit vectors, its length and the union of its stays; all groups are compared in one product.
    """
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    groups: list[list[int]] = []
    seen: list[set] = []
    sums, lengths = np.zeros((64, unit.shape[1])), np.ones(64)
    for i in order:
        n, own = len(groups), stays[i]
        sims = sums[:n] @ unit[i] / lengths[:n]
        at = int(sims.argmax()) if n else -1
        best = float(sims[at]) if n else -1.0
        shared = n and own and len(own & seen[at]) / len(own) >= cfg.theme_shared
        if not (n and (best >= cfg.theme_strong or (best >= cfg.theme_weak and shared))):
            at = n
            groups.append([])
            seen.append(set())
            if n == len(sums):
                sums, lengths = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([lengths, np.ones_like(lengths)])
        groups[at].append(i)
        seen[at] |= own
        sums[at] += unit[i]
        lengths[at] = max(float(np.linalg.norm(sums[at])), 1e-12)
    return [g for g in groups if len(g) >= cfg.min_members]


def cluster_labels(labels: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(owner_id, theme, label) of labels (owner_id, label, vector, stays); an owner's label universe is one group."""
    ship(labels.sparkSession)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=[len(s) for s in pdf["stays"]]).sort_values(["n", "label"], ascending=[False, True]).reset_index(drop=True)
        number = {x: k for k, x in enumerate(sorted({x for s in pdf["stays"] for x in s}))}
        groups = theme_groups(np.stack(pdf["vector"].to_numpy()), [{number[x] for x in s} for s in pdf["stays"]], list(range(len(pdf))), cfg)
        return pd.DataFrame([(pdf["owner_id"].iloc[0], k, pdf["label"].iloc[i]) for k, g in enumerate(groups) for i in g], columns=["owner_id", "theme", "label"])

    return labels.groupBy("owner_id").applyInPandas(fold, "owner_id long, theme int, label string")
