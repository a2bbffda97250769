r"""Spelling variant grouping (operator 13).

Words are counted over whole texts in one pass with partial aggregates. Two words are near if one code point is inserted, deleted or
replaced. The pairs come from an even-partition pigeonhole join: a word of length l is indexed under its two segments [0, l/2) and
[l/2, l) (rounded down); one edit leaves one of them whole. A word probes, with its own length, the segments at their places, and with the
next shorter length its prefix at place 0 and its suffix shifted by one. Candidates are verified by their edit distance; a pair that came by
both segments is one pair after a ``distinct`` on verified pairs.

A segment that very many words share would make all pairs of its group. What a bucket's words have in common lies outside a span: [l/2, l)
for the first segment, [0, l/2) for the second. A bucket with more than ``PAIRS`` candidates is dealt anew by the halves of its span, as one
edit leaves one of these whole too, until it is small or the span has one place; words that differ at one place are near by definition, so
what such a bucket emits is result. This takes log2(length) rounds at most and loses no pair. Buckets are known by a 64-bit hash of length,
span and what lies outside it; a collision costs a verification only.

Each word points to its form, whose count is five times its own at least, so chains are as long as the logarithm of the largest count; pointer
doubling finds the roots. Steps are written to the shared folder.

Cases: null texts have no words; a null id is written as an empty string; texts and words of any length are taken whole; repeated rows
count again; equal counts go to the smaller word in code-point order; an empty table gives no word; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import lower_az, stage

#: Candidates that one bucket may make before it is dealt anew.
PAIRS = 4096
RUNS = r"[A-Za-zÀ-ÿ]+"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as text), run: each maximal run of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(lower_az(F.coalesce(F.col(text_col), F.lit(""))), F.lit(RUNS), F.lit(0))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def with_slips(found: DataFrame, every: int = 199) -> DataFrame:
    """word: the run, without one of its code points where ``every`` divides the hash of id and run."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    found = found.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """word, n: words of ``least_length`` code points and ``least_n`` occurrences at least."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _key(outside: Column) -> Column:
    return F.xxhash64("l", "a", "b", outside)


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows word, n, longer (0 or 1), l, a, b with the key of their bucket. A longer word has one place more within the span."""
    tail = F.substring(F.col("word"), (F.col("b") + F.col("longer") + 1).cast("int"), F.length("word"))
    return rows.withColumn("key", _key(F.concat(F.substring(F.col("word"), F.lit(1), F.col("a").cast("int")), tail)))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its span; of a span of one place only the insertions before and after it are left."""
    low, high = F.floor((F.col("a") + F.col("b")) / 2).cast("int"), F.ceil((F.col("a") + F.col("b")) / 2).cast("int")
    one = F.col("b") - F.col("a") == 1
    first = F.struct(F.when(one, high).otherwise(low).alias("a"), F.col("b").alias("b"))
    return rows.withColumn("s", F.explode(F.array(first, F.struct(F.col("a").alias("a"), low.alias("b"))))).select("word", "n", "longer", "l", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def _pairs(rows: DataFrame, wanted: Column) -> DataFrame:
    """word, n, other, other_n of the verified pairs in the buckets of ``rows``, one direction each."""
    own = rows.filter("longer = 0").select("key", "word", "n", "l", "a", "b")
    other = rows.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "longer")
    met = own.join(other, "key").filter(((F.col("longer") == 1) | (F.col("word") < F.col("other"))) & wanted)
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, most: int = PAIRS) -> DataFrame:
    """word, n, other, other_n: each pair of ``words`` (word, n; distinct words) that one edit apart, in both directions."""
    size = F.length("word")
    index = words.select("word", "n", F.lit(0).alias("longer"), size.alias("l"), F.lit(0).alias("a"), size.alias("b"))
    probe = words.filter(size > 0).select("word", "n", F.lit(1).alias("longer"), (size - 1).alias("l"), F.lit(0).alias("a"), (size - 1).alias("b"))
    both = index.unionByName(probe)
    rows, found = stage(_bucketed(_halves(both.filter("l > 1")).unionByName(both.filter("l <= 1"))), "spelling-segments"), []
    while True:
        sizes = rows.groupBy("key").agg(F.sum(1 - F.col("longer")).alias("own"), F.count("*").alias("all"))
        crowded = stage(sizes.filter(F.col("own") * F.col("all") > most).select("key"), "spelling-crowded")
        if crowded.isEmpty():
            found.append(stage(_pairs(rows, F.lit(True)), "spelling-pairs"))
            break
        found.append(stage(_pairs(rows.join(crowded, "key", "left_anti"), F.lit(True)), "spelling-pairs"))
        dense = stage(rows.join(crowded, "key", "left_semi"), "spelling-dense")
        found.append(stage(_pairs(dense.filter("b - a = 1"), F.col("longer") == 0), "spelling-pairs"))  # they differ at this place
        found.append(stage(_pairs(dense.filter("b = a"), F.lit(True)), "spelling-pairs"))  # the longer words have one place more here
        rows = stage(_bucketed(_halves(dense.filter("b > a"))), "spelling-segments")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back).repartition("word").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form; both not null): the end of the chain of forms."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def group_variants(words: DataFrame, factor: int = 5, most: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n): the form is the near word of largest n, if that is ``factor`` times the word's n."""
    words = stage(words.select("word", "n"), "spelling-words")
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("top"))
    found = words.join(near, "word", "left")
    holds = -F.col("top.m") >= factor * F.col("n")
    found = stage(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("top.w")).alias("form"), F.when(holds, -F.col("top.m")).alias("form_n")), "spelling-forms")
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
