"""Line dedup over overlapping three-line windows (operator 9), DataFrame functions only.

A text is cut at ``\\n``; each run of three consecutive lines that holds a non-blank line is a window. A window's first
occurrence is the one with the smallest (doc_id, text hash, position). The lines of every later occurrence, in the same or
another document, go; covered positions are merged into spans first.

Windows are keyed by two 64-bit hashes. The first occurrences come from a partial aggregate, so a window that a third of
all documents share costs one row a map task; the join back is an equi-join whose hot keys AQE can split (the aggregated
side has one row a key). What is gathered per document is its own spans.

Cases: null text stays null (0 lines); an empty text is one blank line and stays; texts of fewer than three lines stay
whole; repeated rows (same doc_id and text) are one occurrence and get the same result; with a null doc_id a row sorts
first; an empty table gives an empty result; extra columns pass through and clashing result names get an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import column_names


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(rows: DataFrame) -> DataFrame:
    """(d, h, pos, a, b): the windows of each row; a and b are the two hashes of its lines."""
    lines = rows.select("d", "h", _lines(F.col("t")).alias("w")).filter(F.size("w") >= 3)
    triple = lambda i: F.array(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    every = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(i.alias("pos"), triple(i).alias("x")))
    x = lines.select("d", "h", F.inline(every))
    return x.filter(F.exists("x", lambda s: F.trim(s) != "")).select("d", "h", "pos", F.xxhash64("x").alias("a"), F.xxhash64(F.lit("b"), F.reverse("x")).alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text reduced, then n_lines, n_removed and n_spans."""
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    seen = _windows(rows)
    first = seen.groupBy("a", "b").agg(F.min(F.struct("d", "h", "pos")).alias("one"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "one")
    later = seen.join(first, ["a", "b"]).filter(~F.struct("d", "h", "pos").eqNullSafe(F.col("one"))).select("d", "h", "pos").distinct()
    w = Window.partitionBy("d", "h").orderBy("pos")
    island = later.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) <= 3, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    spans = island.groupBy("d", "h", "run").agg(F.min("pos").alias("from"), (F.max("pos") + 3).alias("to"))
    spans = spans.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("cut"))

    d, h, cut, n_lines, n_removed, n_spans = column_names(docs, "d_key", "h_key", "cut_spans", "n_lines", "n_removed", "n_spans")
    spans = spans.select(F.col("d").alias(d), F.col("h").alias(h), F.col("cut").alias(cut))
    both = docs.join(spans, F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(h)), "left")
    cuts, lines = F.coalesce(F.col(cut), F.array().cast("array<struct<from:int,to:int>>")), _lines(F.col(text_col))
    left = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(cuts)),
            lambda i: F.slice(lines, F.coalesce(F.get(cuts, i - 1)["to"], F.lit(0)) + 1, F.coalesce(F.get(cuts, i)["from"], F.size(lines)) - F.coalesce(F.get(cuts, i - 1)["to"], F.lit(0))),
        )
    )
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    gone = F.aggregate(cuts, F.lit(0), lambda s, x: s + x["to"] - x["from"])
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return both.select(*kept, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines), gone.cast("long").alias(n_removed), F.size(cuts).cast("long").alias(n_spans))
