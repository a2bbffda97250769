"""Search documents, lexical and dense matching, rank fusion, evidence for answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.geo import metres
from waymark.sources.scratch import kept
from waymark.sources.shipping import ship

#: BM25 parameters (Robertson and Zaragoza).
K1, B = 1.2, 0.75
#: Vectors in a block of queries and in a block of rows.
QUERY_BLOCK, ROW_BLOCK = 128, 1024
TOKEN = r"(?U)\w+"
# A citation of numbered facts, and a year.
CITATION = r"\[\s*F\s*\d+(?:\s*,\s*F?\s*\d+)*\s*\]"
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"


def gather(captions: DataFrame, singles: DataFrame, screens: DataFrame, photos: DataFrame) -> DataFrame:
    """(doc_key, kind, text, t): readings as documents, dated by their photographs.

    Refused readings (null text), sensitive screens, withheld single photographs and readings without a dated photograph stay out.
    captions: key, photo_ids, text; singles and screens: photo_id, text (screens also category).
    """
    at = photos.select("photo_id", "t", F.coalesce("preference", F.lit(True)).alias("may"))
    # Texts are shuffled once: photographs meet keys and digests of texts, and what they give meets the texts.
    told = captions.filter("text is not null").select("key", "text", "photo_ids", F.md5("text").alias("digest"))
    first = told.select("key", "digest", F.explode("photo_ids").alias("photo_id")).join(at, "photo_id").groupBy("key", "digest").agg(F.min("t").alias("t"))
    stay = told.select("key", "digest", "text").dropDuplicates(["key", "digest"]).join(first, ["key", "digest"])
    stay = stay.select(F.concat(F.lit("stay:"), "key").alias("doc_key"), F.lit("stay").alias("kind"), "text", "t")
    one = singles.filter("text is not null").join(at.filter("may"), "photo_id").select(F.concat(F.lit("single:"), "photo_id").alias("doc_key"), F.lit("single").alias("kind"), "text", "t")
    screen = screens.filter("text is not null").filter(~F.col("category").isin("chat", "auth", "finance")).join(at, "photo_id")
    screen = screen.select(F.concat(F.lit("screen:"), "photo_id").alias("doc_key"), F.lit("screen").alias("kind"), "text", "t")
    return stay.unionByName(one).unionByName(screen)


def missing_embeddings(documents: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    have = embeddings.filter(F.col("model") == model).select("doc_key")
    return documents.join(have, "doc_key", "left_anti")


def tokens(question: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\w+", question.lower())))


def count_score(text: Column, words: list[str]) -> Column:
    """Occurrences of the words as substrings."""
    low = F.lower(text)
    return sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))


def bm25(documents: DataFrame, words: list[str]) -> DataFrame:
    """(doc_key, score) of documents that hold a word; texts are read once, their frequencies kept, one row of statistics broadcast."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    rows = documents.select("doc_key", found.alias("w"))
    count = lambda word: F.size(F.filter("w", lambda x: x == F.lit(word))).cast("double")
    tf = {f"f{i}": count(word) for i, word in enumerate(words)}
    rows = kept(rows.select("doc_key", F.size("w").cast("double").alias("dl"), *(c.alias(n) for n, c in tf.items())), "frequencies")
    stats = rows.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(n) > 0).alias(f"d{n}") for n in tf))
    score = F.lit(0.0)
    for n in tf:
        idf = F.log(1 + (F.col("docs") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
        score = score + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.join(F.broadcast(stats)).select("doc_key", score.alias("score")).filter("score > 0")


def token_table(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, doc_key, tf, dl) and one row of statistics (docs, avgdl): what an index keeps, so that questions need not read texts.

    Kept partitioned by a hash of the term, a question reads its own terms' parts alone.
    """
    rows = documents.select("doc_key", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("w"))
    stats = rows.agg(F.count("*").alias("docs"), F.avg(F.size("w").cast("double")).alias("avgdl"))
    terms = rows.select("doc_key", F.size("w").cast("double").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc_key", "dl").agg(F.count("*").cast("double").alias("tf"))
    return terms, stats


def bm25_indexed(terms: DataFrame, stats: DataFrame, words: list[str]) -> DataFrame:
    """``bm25`` from a token table."""
    hits = terms.filter(F.col("term").isin(words))
    seen = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(seen), "term").join(F.broadcast(stats))  # a row for each asked word, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("doc_key").agg(F.sum(score).alias("score"))


def dense(embeddings: DataFrame, query: list[float], depth: int) -> DataFrame:
    """(doc_key, score): the best dot products; vectors of another width are skipped."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return embeddings.filter(F.size("embedding") == len(query)).select("doc_key", dot.alias("score")).orderBy(F.desc("score"), "doc_key").limit(depth)


def _packed(vectors: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (cell, key, embedding) as blocks of up to ``most`` vectors of one cell and width: cell, width, keys and the doubles as bytes."""
    ship(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.filter(F.size("embedding") > 0).filter(~F.exists("embedding", lambda x: x.isNull())).select(F.col("cell").cast("int").alias("cell"), key, F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            wide = pc.list_value_length(b.column(2))
            for c, w in sorted(set(zip(b.column(0).to_pylist(), wide.to_pylist()))):
                own = b.filter(pc.and_(pc.equal(b.column(0), c), pc.equal(wide, w)))
                for i in range(0, own.num_rows, most):
                    part = own.slice(i, most)
                    data = np.asarray(part.column(2).flatten(), "<f8").tobytes()
                    keys = pa.array([part.column(1).to_pylist()], pa.list_(part.column(1).type))
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([w], pa.int32()), keys, pa.array([data], pa.binary())], ["cell", "width", "keys", "data"])

    return rows.mapInArrow(pack, f"cell int, width int, keys array<{kind}>, data binary")


def dense_all(embeddings: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc_key, score): the best dot products of every query (query_id, embedding) among all (doc_key, embedding).

    Blocks of queries meet blocks of rows; a task keeps the best ``depth`` of each query of the block at hand, so that few rows per
    query and task are shuffled. Sums run over the dimensions in order, so equal vectors get equal scores in any block.
    A query skips vectors of another width; null vectors and vectors with a null element give no row.
    """
    one = F.lit(0)
    return _best(_packed(queries.withColumn("cell", one), "query_id", QUERY_BLOCK), _packed(embeddings.withColumn("cell", one), "doc_key", ROW_BLOCK), queries, depth, lambda q, rows: q.drop("cell").crossJoin(rows))


def _best(q: DataFrame, rows: DataFrame, queries: DataFrame, depth: int, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The best rows of each query among the blocks that ``meet`` brings together."""
    q = q.select("cell", F.col("width").alias("qw"), F.col("keys").alias("qk"), F.col("data").alias("qd"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def score(batches):
        import numpy as np
        import pyarrow as pa

        def best(scores, keys):
            order = np.where(np.isnan(scores), np.inf, scores)
            if len(order) > depth:
                near = np.flatnonzero(order >= np.partition(order, -depth)[-depth])
                scores, keys, order = scores[near], keys[near], order[near]
            at = sorted(range(len(order)), key=lambda i: (-order[i], keys[i]))[:depth]
            return scores[at], keys[at]

        def out(ids, top):
            n = [len(s) for s, _ in top]
            cols = [pa.array(np.repeat(np.array(ids, object), n).tolist(), kinds[0]), pa.array([k for _, ks in top for k in ks], pa.string()), pa.array(np.concatenate([s for s, _ in top]), pa.float64())]
            return pa.RecordBatch.from_arrays(cols, ["query_id", "doc_key", "score"])

        now, ids, top, kinds = None, None, None, []
        for b in batches:
            for i in range(b.num_rows):
                qw, qd, width, data = (b.column(c)[i].as_py() for c in ("qw", "qd", "width", "data"))
                if qw != width:
                    continue
                mine = b.column("qk")[i].as_py()
                if now is None or mine != ids or qd != now:
                    if top:
                        yield out(ids, top)
                    now, ids, top, kinds = qd, mine, None, [b.column("qk").type.value_type]
                    block = np.frombuffer(qd, "<f8").reshape(-1, qw)
                rows = np.ascontiguousarray(np.frombuffer(data, "<f8").reshape(-1, width).T)
                keys = np.array(b.column("keys")[i].as_py(), object)
                dots = np.zeros((len(block), rows.shape[1]))
                for j in range(width):
                    dots += block[:, j : j + 1] * rows[j]
                found = [best(d, keys) for d in dots]
                top = found if top is None else [best(np.concatenate([s, t]), np.concatenate([k, m])) for (s, k), (t, m) in zip(top, found)]
        if top:
            yield out(ids, top)

    part = meet(q, rows).select("qw", "qk", "qd", "width", "keys", "data").mapInArrow(score, f"query_id {kind}, doc_key string, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key"))
    return part.withColumn("nth", nth).filter(F.col("nth") <= depth).drop("nth")


def fuse_all(channels: dict[str, DataFrame], cfg: Settings = DEFAULT, limit: int | None = None) -> DataFrame:
    """``fuse`` for every question: channels (query_id, doc_key, score) are cut, ranked and fused by query_id."""
    best, ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key"), None
    for name, df in channels.items():
        one = df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= cfg.depth).select("query_id", "doc_key", F.lit(name).alias("channel"), "rank")
        ranked = one if ranked is None else ranked.unionByName(one)
    fused = ranked.groupBy("query_id", "doc_key").agg(F.sum(1.0 / (cfg.rrf_k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return fused.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= (limit or cfg.answer_limit)).drop("nth")


def fuse(channels: dict[str, DataFrame], cfg: Settings = DEFAULT, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (doc_key, score) channels cut to their depth: score, and the channels that found the document."""
    ranked = None
    for name, df in channels.items():
        top = df.orderBy(F.desc("score"), "doc_key").limit(cfg.depth)
        one = top.select("doc_key", F.lit(name).alias("channel"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_key")).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    fused = ranked.groupBy("doc_key").agg(F.sum(1.0 / (cfg.rrf_k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return fused.orderBy(F.desc("score"), "doc_key").limit(limit or cfg.answer_limit)


def within_reach(located: DataFrame, lat: float, lon: float, cfg: Settings = DEFAULT) -> DataFrame:
    return located.filter(metres(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= cfg.ask_reach_m)


def confidence(found: DataFrame, cfg: Settings = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each ``by``: n and the confidence that the best score and the coverage give; 0 without evidence."""
    top = F.least(F.lit(1.0), F.max("score") * (cfg.rrf_k + 1) / 2)
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(top * F.count("*") / (F.count("*") + cfg.coverage_half), F.lit(0.0)).alias("confidence"))


def citation_defects(answers: DataFrame) -> DataFrame:
    """Answers (answer, n_evidence, years) with ``defects``: uncited, unknown citation, unseen year, in this order."""
    groups = F.regexp_extract_all("answer", F.lit(CITATION), F.lit(0))
    cited = F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0)))), lambda x: x.cast("int"))
    named = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(YEAR), F.lit(0)), lambda x: x.cast("int")))
    one = F.when(F.size(cited) == 0, "uncited").when(F.exists(cited, lambda x: (x < 1) | (x > F.col("n_evidence"))), "unknown citation")
    two = F.when(F.size(F.array_except(named, "years")) > 0, "unseen year")
    return answers.withColumn("defects", F.when((F.trim("answer") != "") & (F.col("n_evidence") > 0), F.array_compact(F.array(one, two))).otherwise(F.array().cast("array<string>")))
