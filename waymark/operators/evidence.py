"""What answers and narrations rest on: places of documents, numbered facts, checks of a story, the profile in force at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import DEFAULT, Settings
from waymark.functions.geo import metres, nearest_within
from waymark.operators.orders import strength

# A citation of facts, alone, listed or as a range; a number; the shortest number that is checked; the length of a quote;
# the sentences that facts are told in.
CITED = r"\[\s*F\s*(\d+)(?:\s*(?:,|-|--|to)\s*F?\s*(\d+))*\s*\]"
NUMBER = r"\d[\d,._]*"
MIN_DIGITS = 2
QUOTE_LENGTH = 90
SUBJECT_FACT = "Subject '%s' was seen at %d recorded sightings between %s and %s (score %.2f, confidence %.2f)."
PLACE_FACT = "Place '%s' was visited: %d recorded sightings between %s and %s (score %.2f)."
NEARBY_FACT = "Near %s you photographed: %s"
MEASURED_FACT = "%d photographs and %d outings were measured."
PLACES_FACT = "%d distinct places were visited; %s were never returned to."
WEEKEND_FACT = "%s of outings happened on weekends."
INSIGHT_FACT = "Interest '%s' %s (magnitude %.2f, confidence %.2f%s)."
KIND_PHRASES = {
    "new": "appeared for the first time", "returned": "came back after an absence", "rising": "grew", "declining": "shrank",
    "dormant": "went quiet", "enduring": "stayed strong throughout",
}


def _numbers(group: Column) -> Column:
    return F.transform(F.regexp_extract_all(group, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def cited_facts(story: Column, n_facts: Column) -> Column:
    """Numbers of all cited facts in order. A pair with a dash and any group with ``to`` are ranges, written out within the facts there are."""

    def one(group: Column) -> Column:
        found = _numbers(group)
        ranged = ((F.size(found) == 2) & group.contains("-")) | group.contains("to")
        lo, hi = F.greatest(F.array_min(found), F.lit(1)), F.least(F.array_max(found), n_facts.cast("long"))
        return F.when(~ranged, found).when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.regexp_extract_all(story, F.lit(CITED), F.lit(0)), one))


def stated_numbers(text: Column) -> Column:
    """Distinct numbers of two digits and more, separators and leading zeros put aside."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"[^\d]", ""))
    return F.array_distinct(F.transform(F.filter(bare, lambda x: F.length(x) >= MIN_DIGITS), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")))


def narration_defects(stories: DataFrame) -> DataFrame:
    """Stories (story, facts) with ``defects``: uncited, unknown citation, unsupported number, in this order.

    The ends of a range tell whether it leaves the list, so ranges are not written out here.
    """
    ends = F.flatten(F.transform(F.regexp_extract_all("story", F.lit(CITED), F.lit(0)), _numbers))
    n = F.size("facts")
    cites = F.when(F.size(ends) == 0, "uncited").when(F.exists(ends, lambda x: x.isNull() | (x < 1) | (x > n)), "unknown citation")
    stated = stated_numbers(F.regexp_replace("story", CITED, " "))
    bare = F.size(F.array_except(stated, stated_numbers(F.array_join("facts", " ")))) > 0
    none = F.array().cast("array<string>")
    found = F.array_compact(F.array(cites, F.when(bare, "unsupported number")))
    return stories.withColumn("defects", F.when((F.trim("story") != "") & (n > 0), found).otherwise(none))


def profiles_as_of(profiles: DataFrame, moments: DataFrame, by: str) -> DataFrame:
    """(by, at, seq): for each moment (by, at) the last kept profile (by, at, seq) made until then; null before the first.

    One sort by owner and time and a running maximum; no range join.
    """
    rows = profiles.select(by, "at", F.lit(0).alias("asks"), "seq").unionByName(moments.select(by, "at", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("seq")))
    until = Window.partitionBy(by).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seq", F.max("seq").over(until)).filter("asks = 1").select(by, "at", "seq")


def document_points(captions: DataFrame, singles: DataFrame, photos: DataFrame) -> DataFrame:
    """(doc_key, lat, lon): a stay lies at the mean of its photographs, a single photograph where it was taken; screens have no place."""
    at = photos.filter("lat is not null and lon is not null").select("photo_id", "lat", "lon")
    stay = captions.filter("text is not null").select("key", F.explode("photo_ids").alias("photo_id")).join(at, "photo_id")
    stay = stay.groupBy(F.concat(F.lit("stay:"), "key").alias("doc_key")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    one = singles.filter("text is not null").select("photo_id").join(at, "photo_id").select(F.concat(F.lit("single:"), "photo_id").alias("doc_key"), "lat", "lon")
    return stay.unionByName(one)


def clipped(text: Column, most: int = QUOTE_LENGTH) -> Column:
    """White space collapsed, and three dots after ``most`` characters."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("...")))


def numbered_facts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the whole texts of the results (doc_key, score) of ``fuse`` as ``[Fi] (date, kind) text`` lines, best first.

    documents: doc_key, kind, text, t.
    """
    top = documents.join(F.broadcast(found.select("doc_key", "score")), "doc_key")  # a bounded number of results
    line = F.struct((-F.col("score")).alias("o"), "doc_key", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd").alias("day"), "kind", "text")
    rows = top.agg(F.sort_array(F.collect_list(line)).alias("all"))
    told = F.transform("all", lambda x, i: F.concat(F.lit("[F"), i + 1, F.lit("] ("), x["day"], F.lit(", "), x["kind"], F.lit(") "), x["text"]))
    return rows.select(F.size("all").alias("n"), F.array_join(told, "\n").alias("facts"))


def subject_facts(profile: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(topic, nth, fact): sentences on the strongest subjects of a profile (topic, score, confidence, evidence, first_at, last_at)."""
    top = profile.withColumn("strength", strength()).orderBy(F.desc("strength"), "topic").limit(cfg.subject_facts)
    month = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM")
    nth = F.row_number().over(Window.orderBy(F.desc("strength"), "topic")).cast("long")  # a few rows
    return top.select("topic", nth.alias("nth"), F.format_string(SUBJECT_FACT, "topic", F.size("evidence"), month("first_at"), month("last_at"), F.bround("score", 2), F.bround("confidence", 2)).alias("fact"))


def health(photos: DataFrame, readings: DataFrame, profile_at: int) -> DataFrame:
    """One row: photographs newer than the kept profile, photographs without a thumbnail, refused readings that may be tried again."""
    a = photos.agg(F.count_if(F.col("t") > profile_at).alias("newer"), F.count_if(F.col("thumbnail").isNull()).alias("without_thumbnail"))
    b = readings.agg(F.count_if(F.coalesce(F.col("refused").startswith("no thumbnail"), F.lit(False))).alias("recoverable"))
    return a.join(F.broadcast(b))  # one row each


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int"), F.lit("%"))


def measure_facts(measures: DataFrame) -> DataFrame:
    """(owner_id, nth, fact) of measures (owner_id, photographs, outings, places, one_time_rate, weekend_share)."""
    facts = F.array(
        F.format_string(MEASURED_FACT, "photographs", "outings"), F.format_string(PLACES_FACT, F.col("places"), percent(F.col("one_time_rate"))), F.format_string(WEEKEND_FACT, percent(F.col("weekend_share")))
    )
    return measures.select("owner_id", F.posexplode(facts).alias("nth", "fact"))


def topic_points(topics: DataFrame) -> DataFrame:
    """(topic, lat, lon) of place topics; others and unreadable ones go."""
    number = lambda i: F.regexp_extract("topic", r"^place:(-?[0-9.]+),(-?[0-9.]+)$", i).try_cast("double")
    return topics.select("topic").distinct().select("topic", number(1).alias("lat"), number(2).alias("lon")).filter("lat between -90 and 90 and lon between -180 and 180")


def place_names(topics: DataFrame, names: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(topic, label): the nearest name (label, lat, lon) within reach of each place topic; without one a topic goes."""
    points = topic_points(topics).withColumnRenamed("topic", "key")
    return nearest_within(points, names, cfg.name_within_m).filter("label is not null").select(F.col("key").alias("topic"), "label")


def nearby_quotes(points: DataFrame, singles: DataFrame, photos: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(topic, quotes): what the nearest answered single photographs of each point (topic, lat, lon) show, a cell join.

    singles: photo_id, text; photos: photo_id, t, lat, lon. Ties in metres go by time, then text.
    """
    grid = 0.01
    at = photos.filter("lat is not null and lon is not null").select("photo_id", "t", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    told = singles.filter("text is not null").join(at, "photo_id").select("t", "plat", "plon", clipped(F.col("text")).alias("quote"))
    told = told.withColumns({"cy": F.floor(F.col("plat") / grid), "cx": F.floor(F.col("plon") / grid)})
    rows = F.ceil(F.lit(cfg.nearby_m / (grid * 111_000))).cast("int")
    columns = F.ceil(cfg.nearby_m / (grid * 111_000 * F.greatest(F.cos(F.radians(F.abs("lat") + grid)), F.lit(0.01)))).cast("int")  # more of them towards the poles
    near = points.select("topic", "lat", "lon", F.explode(F.sequence(-rows, rows)).alias("dy"), columns.alias("w")).withColumn("dx", F.explode(F.sequence(-F.col("w"), F.col("w"))))
    near = near.withColumns({"cy": F.floor(F.col("lat") / grid) + F.col("dy"), "cx": F.floor(F.col("lon") / grid) + F.col("dx")})
    d = F.round(metres(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 3)
    hits = near.join(told, ["cy", "cx"]).withColumn("d", d).filter(F.col("d") <= cfg.nearby_m)
    best = Window.partitionBy("topic").orderBy("d", "t", "quote")
    first = hits.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= cfg.nearby_quotes)
    return first.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "quote"))), lambda x: x["quote"]).alias("quotes"))


def place_facts(profile: DataFrame, names: DataFrame, quotes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(owner_id, nth, fact): the strongest named places of a profile (owner_id, topic, score, confidence, evidence, first_at, last_at) and what was seen near them."""
    power = F.round(F.col("score") * F.col("confidence"), 12)
    own = Window.partitionBy("owner_id").orderBy(F.desc(power), "topic")
    top = profile.join(names, "topic").withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= cfg.place_facts).join(quotes, "topic", "left")
    month = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM")
    one = F.format_string(PLACE_FACT, F.col("label"), F.size("evidence"), month("first_at"), month("last_at"), F.bround("score", 2))
    two = F.when(F.size("quotes") > 0, F.format_string(NEARBY_FACT, F.col("label"), F.array_join("quotes", " / ")))
    return top.select("owner_id", "nth", F.explode(F.array_compact(F.array(one, two))).alias("fact"))


def insight_facts(insights: DataFrame, names: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """(nth, fact): the first findings (topic, kind, magnitude, confidence, rank, and perhaps first_seen, last_seen as dates); unnamed places go."""
    rows = insights.join(names, "topic", "left").filter(~F.col("topic").startswith("place:") | F.col("label").isNotNull()).orderBy("rank").limit(cfg.insight_facts)
    phrase = F.lit(None).cast("string")
    for kind, words in KIND_PHRASES.items():
        phrase = F.when(F.col("kind") == kind, words).otherwise(phrase)
    month = lambda c: F.date_format(c, "yyyy-MM")
    known = {"first_seen", "last_seen"} <= set(insights.columns)
    period = F.coalesce(F.concat(F.lit(", seen "), month("first_seen"), F.lit(" to "), month("last_seen")), F.lit("")) if known else F.lit("")
    fact = F.format_string(INSIGHT_FACT, F.coalesce("label", "topic"), phrase, F.bround("magnitude", 2), F.bround("confidence", 2), period)
    return rows.select(F.row_number().over(Window.orderBy("rank")).alias("nth"), fact.alias("fact"))  # at most as many rows as a story has facts
