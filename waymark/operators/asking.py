"""Questions against the index: filters before ranks, reach, exclusions, confidence, findings that touch the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.geo import metres
from waymark.operators.orders import with_rank
from waymark.sources.scratch import kept
from waymark.sources.shipping import ship

# Reference prefixes and those of the documents they speak about.
DOCUMENT_PREFIXES = {"caption:": "stay:", "photo:": "single:", "screen:": "screen:"}
#: Findings of a block that is held against the texts, and the bytes of their topics.
TOPIC_BLOCK, TOPIC_BYTES = 50_000, 4_000_000


def document_key(reference: Column) -> Column:
    """The document that a reference speaks about; null for others."""
    out = F.lit(None).cast("string")
    for prefix, kind in DOCUMENT_PREFIXES.items():
        out = F.when(reference.startswith(prefix), F.concat(F.lit(kind), F.substring(reference, len(prefix) + 1, 2**31 - 1))).otherwise(out)
    return out


def retrieve(channels: dict[str, DataFrame], questions: DataFrame, documents: DataFrame, points: DataFrame | None = None, cfg: Settings = DEFAULT, limit: int | None = None) -> DataFrame:
    """(query_id, doc_key, score, channels, nth): fused ranks over what a question's window and reach leave of each channel.

    channels: (query_id, doc_key, score). questions: query_id, since, until (microseconds), near_lat, near_lon, all but the id may be null.
    documents: doc_key, t. points: doc_key, lat, lon. A channel is cut to its depth first, deeper for a question with a place; filters
    come before ranks.
    """
    asked = questions.select("query_id", "since", "until", "near_lat", "near_lon")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key")
    rows = None
    for name, df in channels.items():
        cut = df.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= cfg.filtered_depth).select("query_id", "doc_key", "score", "nth", F.lit(name).alias("channel"))
        rows = cut if rows is None else rows.unionByName(cut)
    rows = rows.join(asked, "query_id").filter((F.col("nth") <= cfg.depth) | F.col("near_lat").isNotNull())
    rows = rows.join(documents.select("doc_key", "t"), "doc_key")
    rows = rows.filter((F.col("since").isNull() | (F.col("t") >= F.col("since"))) & (F.col("until").isNull() | (F.col("t") <= F.col("until"))))
    if points is None:
        rows = rows.filter(F.col("near_lat").isNull())
    else:
        rows = rows.join(points.select("doc_key", "lat", "lon"), "doc_key", "left")
        near = metres(F.col("near_lat"), F.col("near_lon"), F.col("lat"), F.col("lon")) <= cfg.ask_reach_m
        rows = rows.filter(F.col("near_lat").isNull() | F.coalesce(near, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "doc_key"))
    fused = rows.withColumn("rank", rank).groupBy("query_id", "doc_key").agg(F.sum(1.0 / (cfg.rrf_k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return fused.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= (limit or cfg.answer_limit))


def ask(found: DataFrame, questions: DataFrame, documents: DataFrame, exclusions: DataFrame, insights: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """A row for each question: n, confidence, first_seen, last_seen, evidence (doc_keys, best first) and supporting topics.

    ``found`` is what ``retrieve`` gives; it is worked out once and kept, and so is what each question rests on. Excluded documents go after the cut, so an exclusion takes an answer's ground and
    gives it no other. Without ground all is 0, null or empty, and no model is asked. insights: topic, rank.
    """
    banned = exclusions.select(document_key(F.col("reference")).alias("doc_key")).filter("doc_key is not null").distinct()
    ground = kept(found, "found").join(banned, "doc_key", "left_anti").join(documents.select("doc_key", "t", "text"), "doc_key")
    per = ground.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("score").alias("top"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"),
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "doc_key", "text"))).alias("all"),
    )
    coverage = F.col("n") / (F.col("n") + cfg.coverage_half)
    told = F.lower(F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.array_join(F.transform("all", lambda x: x["text"]), " ")))
    rows = questions.select("query_id", "question").join(per, "query_id", "left")
    rows = kept(rows.select("query_id", "n", "top", "first_seen", "last_seen", F.transform("all", lambda x: x["doc_key"]).alias("evidence"), F.when(F.col("n") > 0, told).alias("told")), "told")
    support = supporting(rows.filter("n > 0").select("query_id", "told"), insights, cfg)
    return rows.join(support, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.least(F.lit(1.0), F.col("top") * (cfg.rrf_k + 1) / 2) * coverage, F.lit(0.0)).alias("confidence"), "first_seen", "last_seen",
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("supporting", F.array().cast("array<string>")).alias("supporting"),
    )


def supporting(told: DataFrame, insights: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(query_id, supporting): the first findings whose topic occurs in a question or its evidence. told: query_id, told; insights: topic, rank.

    Findings go over the texts in blocks of their order, ``TOPIC_BLOCK`` of them or ``TOPIC_BYTES`` at most, as one automaton that finds all
    topics in one scan of a text. A question that has its first findings leaves, so later blocks meet few texts or none.
    """
    ship(told.sparkSession)
    kind = told.schema["query_id"].dataType.simpleString()
    left, found = told.select("query_id", "told"), told.sparkSession.createDataFrame([], f"query_id {kind}, rank long, topic string")
    ranked = kept(insights.select(F.col("rank").cast("long").alias("rank"), "topic").filter("topic is not null"), "findings")
    last, many, after = ranked.agg(F.max("rank")).first()[0] or 0, TOPIC_BLOCK, 0
    while after < last:
        block = ranked.filter((F.col("rank") > after) & (F.col("rank") <= after + many))
        if many > 1 and (block.agg(F.sum(F.octet_length("topic"))).first()[0] or 0) > TOPIC_BYTES:
            many //= 2
            continue
        topics = [(r["topic"].lower(), r["rank"], r["topic"]) for r in block.collect()]  # one block, bounded by count and bytes
        if topics:
            hits = kept(left.mapInPandas(_finder(topics, cfg.supporting), f"query_id {kind}, rank long, topic string"), "supporting")
            found = found.unionByName(hits)
            full = found.groupBy("query_id").count().filter(F.col("count") >= cfg.supporting).select("query_id")
            left = kept(left.join(full, "query_id", "left_anti"), "questions-left")
            if left.isEmpty():
                break
        after += many
    per = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "topic"))), 1, cfg.supporting).alias("x"))
    return per.select("query_id", F.transform("x", lambda x: x["topic"]).alias("supporting"))


def _finder(topics: list[tuple[str, int, str]], most: int):
    """Rows (query_id, rank, topic): the first ``most`` of ``topics`` that occur in each text."""

    def run(frames):
        import ahocorasick
        import pandas as pd

        automaton, always = ahocorasick.Automaton(), []
        for low, rank, topic in sorted(topics, key=lambda t: t[1]):
            if not low:
                always.append((rank, topic))
            else:
                automaton.add_word(low, [*automaton.get(low, []), (rank, topic)])
        if len(automaton):
            automaton.make_automaton()
        for f in frames:
            rows = []
            for query_id, text in zip(f["query_id"], f["told"]):
                hits = {h for _, some in automaton.iter(text) for h in some} if len(automaton) and text else set()
                rows += [(query_id, *h) for h in sorted(hits.union(always))[:most]]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "topic"])

    return run


def in_order(insights: DataFrame) -> DataFrame:
    """Insights with ``rank``: the newest kind of finding first, then the largest, then by topic."""
    return with_rank(insights, F.desc("novelty"), F.desc(F.round("magnitude", 12)), F.asc("topic"))
