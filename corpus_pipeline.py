"""The corpus pipeline: five of the training-data operators, one after the other, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
works on all that its predecessor kept, and ``run`` writes each result to the shared folder before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from waymark.llm.common import clear, column_names, crc_of_id, kept_so_far, stage, table
from waymark.llm.queries import tokenizer_path, tokenizer_pattern

#: Documents whose toxicity reaches this score go.
TOXIC = 0.3
#: Least Jaccard index of near copies, in percent.
ALIKE = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labels outside the held-out fold and keeps the documents that score below ``TOXIC``."""
    labels = table(spark, sf_dir, "labels").filter(F.coalesce(crc_of_id(F.col("doc_id")) % 4, F.lit(2)) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.filter(F.col(scored.columns[-2]) < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line passages out of the texts; n_chars follows. No document goes."""
    done = line_dedup.dedup_lines(docs)
    return done.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, once; a null id comes last, of rows with one id the first."""
    row_id, key = column_names(docs, "row_id", "row_key")
    rows = stage(docs.withColumn(row_id, F.monotonically_increasing_id()), "pipeline-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row_id).alias("row"))  # a row is known by its place, as ids may repeat
    kept = near_dedup.near_dedup(rows.select(order.alias("doc_id"), "text"), ALIKE).filter("kept").select(F.col("doc_id.row").alias(key))
    return rows.join(kept, F.col(row_id) == F.col(key), "left_semi").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them."""
    done = byte_bpe.encode(docs, tokenizer_path(), tokenizer_pattern())
    ids, decoded = done.columns[-2:]
    return done.select(*docs.columns, F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"), F.col(decoded).cast("string").alias("decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_benchmark),
    ("byte_bpe", tokenize),
]
#: Learned models and tokens can't be had from SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), kept_so_far()
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, since=mark, but_last=1)  # what the stage and its predecessor wrote
    return docs
