"""Quality rules as learned decision lists (operator 4), DataFrame functions only.

Text statistics are computed in the row. From the labelled ones, sequential covering learns an ordered list of rules against
bad texts: each rule grows one threshold condition at a time by FOIL gain on two thirds of the labelled rows, is pruned back to
the condition count that does best on the other third, and is kept while its precision there reaches ``MIN_PRECISION``. Rows
it covers are set aside before the next rule. Each growing step is one grouped aggregate (features x bins rows come back).
The list becomes one ordered Spark conditional expression.

Repeated windows: window hashes that are all different settle most texts; texts with an equal pair are examined on the window
strings themselves. Both ways take near-linear time in the row. Nothing is shuffled but statistics of labelled rows.

Cases: null text has no words and fails the base; labels without quality or of unknown documents are left out; a document
with several labels counts as bad if one says so; without labels no rule is learned; repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored unless named in ``keep``, clashing result names get an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import column_names, stage

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Base rule: fewer words than this, or more than this percentage of words in repeated windows, fails.
MIN_WORDS, MAX_REPEAT = 20, 30
#: Thresholds tried per feature, rules and conditions at most, least precision and least bad rows covered of a rule.
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVERED = 32, 6, 3, 0.75, 3
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "words": "double(n_words)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_marks")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _repeat_words(w: Column) -> Column:
    """Words that lie in windows which occur twice or more."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    covered = lambda p: _add(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x)))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False))) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))), lambda x: x["p"]))
    exact = _let(F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("p")))), lambda s: _let(twice(s), covered))
    hashed = _let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW))), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(F.when(hashed, 0).otherwise(exact))


def text_stats(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus ``STATS``, the counts that the rules look at, all long; names that are taken get an underscore."""
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_words = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))
    worded = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    by_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    kept, names = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], column_names(docs.select(*keep), *STATS)
    got = docs.select(
        *kept,
        _let(F.array_remove(F.split(text, SPACE + "+", -1), ""), by_words).alias("a"),
        _let(worded, by_lines).alias("b"),
        less(r"[#*$%&|<>]").alias("n_symbols"),
        less(r"[A-Z]").alias("n_capitals"),
        less(r"[!-/:-@\[-`{-~]").alias("n_marks"),
    )
    where = {"n_dup_lines": "b.n_dup_lines", "n_lines": "b.n_lines"} | {c: f"a.{c}" for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct")}
    return got.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(where.get(c, c)).cast("long").alias(n) for c, n in zip(STATS, names)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.at!r}D"

    def binned(self, cuts: dict[str, list[float]]) -> Column:
        b = cuts[self.feature].index(self.at)
        return F.col(f"b_{self.feature}") > b if self.above else F.col(f"b_{self.feature}") <= b


Rule = tuple[Condition, ...]


def rule_sql(rule: Rule) -> str:
    return " AND ".join(c.sql() for c in rule)


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that holds drops the text, otherwise it is kept."""
    out = None
    for rule in rules:
        hit = F.expr(rule_sql(rule))
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules against quality 0, from statistics with doc_id and labels (doc_id, quality)."""
    bad = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("bad"))
    known = stats.join(bad, "doc_id").filter(~base_failed())
    known = stage(known.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *(F.expr(x).alias(f) for f, x in FEATURES.items())), "rules-known")
    marks = [i / BINS for i in range(1, BINS)] + [0.98, 0.99, 0.995]
    row = known.agg(*(F.percentile_approx(f, marks, 2000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    bin_of = lambda f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0))
    rest = stage(known.select("bad", "grow", *(bin_of(f).cast("int").alias(f"b_{f}") for f in FEATURES)).groupBy("bad", "grow", *(f"b_{f}" for f in FEATURES)).agg(F.count("*").alias("n")), "rules-binned")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _prune(rest, _grow(rest, cuts), cuts)
        if not rule:
            break
        rules.append(rule)
        rest = rest.filter(~_all(rule, cuts))
    return rules


def _all(rule: Rule, cuts: dict[str, list[float]]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.binned(cuts)
    return out


def _grow(rest: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        part = rest.filter(F.col("grow") & _all(rule, cuts))
        pairs = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES))
        rows = part.select("bad", "n", F.inline(pairs)).groupBy("f", "b").agg(F.sum(F.col("n") * F.col("bad")).alias("p"), F.sum("n").alias("n")).collect()
        best, chosen = 0.0, None
        for f in FEATURES:
            mine = {r["b"]: (r["p"], r["n"]) for r in rows if r["f"] == f}
            p_all, n_all = (sum(x[i] for x in mine.values()) for i in (0, 1))
            if not p_all or p_all == n_all:
                continue
            p, n = 0, 0
            for b, at in enumerate(cuts[f]):
                p, n = p + mine.get(b, (0, 0))[0], n + mine.get(b, (0, 0))[1]
                for above, pc, nc in ((False, p, n), (True, p_all - p, n_all - n)):
                    if pc >= MIN_COVERED and nc < n_all and (gain := pc * (log2(pc / nc) - log2(p_all / n_all))) > best + 1e-9:
                        best, chosen = gain, Condition(f, above, at)
        if chosen is None:
            break
        rule += (chosen,)
    return rule


def _prune(rest: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on the rows held back; none if its precision is too low."""
    if not rule:
        return ()
    sums = [F.coalesce(F.sum(F.when(_all(rule[:k], cuts), x)), F.lit(0)) for k in range(1, len(rule) + 1) for x in (F.col("n") * F.col("bad"), F.col("n"))]
    got = rest.filter(~F.col("grow")).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    scored = [((2 * got[2 * k] - got[2 * k + 1]) / got[2 * k + 1] if got[2 * k + 1] else -1.0, -k) for k in range(len(rule))]
    worth, k = max(scored)
    return rule[: 1 - k] if (worth + 1) / 2 >= MIN_PRECISION else ()


def apply(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``keep`` columns, ``STATS``, base_failed and kept of all documents, and the rules behind ``kept``."""
    keep = [id_col] if keep is None else keep
    held = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, held)), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = stage(text_stats(inner, [*held, "doc_id"]), "rules-stats")
    rules = learn(stats, labels)
    done = stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})
    made = (*STATS, "base_failed", "kept")
    return done.select(*(F.col(k).alias(c) for c, k in zip(keep, held)), *(F.col(c).alias(n) for c, n in zip(made, column_names(docs.select(*keep), *made)))), rules
