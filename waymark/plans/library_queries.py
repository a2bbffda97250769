"""Queries over a whole library: dated readings, profiles and reports, facts, ranks, deletion, retention, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.geo import metres_sql
from waymark.functions.keys import content_key, read_from
from waymark.operators import asking as A
from waymark.operators import change as C
from waymark.operators import evidence as E
from waymark.operators import interests as I
from waymark.operators import journeys as J
from waymark.operators import measures as M
from waymark.operators import models as L
from waymark.operators import payloads as Y
from waymark.operators import places as P
from waymark.operators import retrieval as R
from waymark.operators import stewardship as S
from waymark.operators.orders import with_rank
from waymark.plans import journey_queries as V
from waymark.plans import reading_queries as Q
from waymark.plans.asking_queries import INSIGHTS_RANKED_SQL, LIBRARY_CORRECTIONS_SQL, library_corrections
from waymark.sources.bindings import HISTORY_SQL, PHOTOS_SQL, SUBJECTS_SQL, THEMES_SQL, YEARS_CUTS, photos, subjects, table, themes

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _r(c, n=9):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# Readings of subjects: two in three read a stay or a single photograph, a third something unknown; every tenth was refused.
DATED_SQL = f"""{Q.CAPTIONS_SQL}, {SUBJECTS_SQL.replace("subjects as", "labelled as")},
readings as (select case doc_id % 3 when 0 then cast(doc_id as varchar) when 1 then substr(sha256('photo-' || (doc_id % n)), 1, 16) else 'unknown' || doc_id end as key, labels from documents join labelled on labelled.key = doc_id, n_events where doc_id % 10 <> 3),
stay_t as (select cast(c.key as varchar) as key, min(p.t) as t from (select key, unnest(photo_ids) as photo_id from captions) c left join photos p on p.photo_id = c.photo_id group by c.key),
subjects as (
  select r.key, labels, s.t // 1000000 as seen_at, 'caption:' || r.key as reference from readings r join stay_t s on s.key = r.key where s.t is not null
  union all select r.key, labels, p.t // 1000000, 'photo:' || s.photo_id from readings r join singles s on s.text is not null and substr(sha256(s.photo_id), 1, 16) = r.key join photos p on p.photo_id = s.photo_id
  where coalesce(p.preference, true) and r.key not in (select key from stay_t)
)"""
_REFERRED = Q.SEEN_SQL.replace(SUBJECTS_SQL, DATED_SQL).replace("select key, seen_at, trim(", "select key, seen_at, reference, trim(").replace("select distinct label, key, seen_at from raw", "select distinct label, key, seen_at, reference from raw")
DATED_SEEN_SQL = _REFERRED.replace("s.key, min(s.seen_at) as seen_at from seen s", "s.key, min(s.seen_at) as seen_at, min(s.reference) as reference from seen s").replace("spoken as (select label, key, seen_at from plain", "spoken as (select label, key, seen_at, reference from plain")
_DATED_SCORE = Q._SCORE.replace("list(key order by", "list(reference order by")


def _subject_readings(spark, d):
    captions, singles, _ = Q._readings(spark, d)
    n, i = table(spark, d, "events").count(), F.col("doc_id")
    key = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, content_key(F.array(F.concat(F.lit("photo-"), i % n)))).otherwise(F.concat(F.lit("unknown"), i))
    labelled = subjects(spark, d).select(F.col("key").alias("doc_id"), "labels")
    return labelled.select(key.alias("key"), "labels", F.when(i % 10 == 3, "model refused").alias("refused")), captions, singles


def _dated(spark, d):
    readings, captions, singles = _subject_readings(spark, d)
    return I.dated(readings, captions, singles, photos(spark, d))


@query(f"with {DATED_SQL} select key, seen_at as at, reference, array_to_string(labels, ',') as labels from subjects")
def subject_readings_dated(spark, d):
    return _dated(spark, d).select("key", "at", "reference", F.array_join("labels", ",").alias("labels"))


@query(f"with {DATED_SEEN_SQL} {_DATED_SCORE.format('spoken')}")
def subject_interest_dated(spark, d):
    return Q._flat(I.subject_interests(_dated(spark, d), themes(spark)))


def _pooled(spark, d):
    """Stays of the years as those of one owner."""
    return V._year_stays(spark, d).withColumn("owner_id", F.lit(0).cast("long"))


def _pool(sql: str) -> str:
    return V.on_years(sql).replace("stays as (select * from groups", "stays as (select * replace (0::bigint as owner_id) from groups", 1)


def _years_history(spark, d):
    """Kept profiles of the places of all stays before each cut: seq, generated_at, topic, score, confidence, refs."""
    cuts = F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(x).cast("date").alias("day")) for i, x in enumerate(YEARS_CUTS))))
    rows = P.placed(_pooled(spark, d), 500.0).withColumn("c", cuts).filter(F.col("t0") < F.unix_micros(F.col("c.day").cast("timestamp")))
    per = P.place_interests(P.visit_days(rows.withColumn("owner_id", F.col("c.seq").cast("long"))))
    day = F.element_at(F.array(*(F.lit(x).cast("date") for x in YEARS_CUTS)), (F.col("owner_id") + 1).cast("int"))
    return per.select(F.col("owner_id").cast("int").alias("seq"), day.alias("generated_at"), "topic", "score", "confidence", F.array("topic").alias("refs"))


YEARS_HISTORY_SQL = f"""history as (
  with {_pool(V.STOPS_SQL)}, cuts(seq, day) as (values {", ".join(f"({i}, date '{x}')" for i, x in enumerate(YEARS_CUTS))}),
  cut as (select seq, day, place, printf('place:%.5f,%.5f', avg(lat), avg(lon)) as topic, count(distinct lt0 // 86400000000) as v, max(lt0 // 86400000000) - min(lt0 // 86400000000) as span from stays, cuts where t0 < epoch_us(day) group by seq, day, place)
  select seq, day as generated_at, topic, v / (v + 1.0::double) as score, v / (v + 3.0::double) * (span / (span + 30.0::double)) as confidence, [topic] as refs from cut where v > 1)"""
YEARS_THEMED_SQL = Q.THEMED_SQL.replace(HISTORY_SQL, YEARS_HISTORY_SQL, 1)
_SCREENS_REST = Q.SCREENS_SQL.replace(PHOTOS_SQL, "", 1).lstrip(", \n")


@query(
    f"""with {DATED_SEEN_SQL}, {_SCREENS_REST}, {LIBRARY_CORRECTIONS_SQL},
    outside as (with {_pool(V.ANCHORS_SQL)}, founded as (select owner_id, place, min(t0) as t0 from stays group by all) select v.*, printf('place:%.5f,%.5f', lat, lon) as topic, row_number() over (partition by v.owner_id order by visit_days desc, n_photos desc, t0) as pos from visits v join founded f on f.owner_id = v.owner_id and f.place = v.place where visit_days > 1 and not exists (select 1 from anchors a where a.owner_id = v.owner_id and {metres_sql("a.lat", "a.lon", "v.lat", "v.lon")} <= 500)),
    base as (
      select topic, round(visit_days / (visit_days + 1.0), 9) as score, [topic, topic] as evidence, 0 as section, pos from outside
      union all select topic, score, string_split(evidence, ','), 1, 0 from ({_DATED_SCORE.format("spoken")})
      union all select topic, score, string_split(evidence, ','), 2, 0 from screen_interests where topic not in (select label from spoken)),
    told as (select topic, score, section, pos, unnest(evidence) as ref, unnest(generate_series(1, len(evidence))) as nth from base where 'topic:' || topic not in (select reference from barred)),
    left_over as (select topic, score, section, pos, string_agg(ref, ',' order by nth) as evidence from told where ref not in (select reference from barred) group by topic, score, section, pos)
    select topic, score, evidence, row_number() over (order by score desc, section, pos, topic) as rank from left_over"""
)
def profile_assembled(spark, d):
    s = _pooled(spark, d)
    places = P.place_profile(P.outside_anchors(P.visit_days(P.placed(s, 500.0)), P.anchors(s)))
    shown = Q.screens(spark, d).withColumn("at", F.floor(F.col("at") / 1_000_000))
    rows = I.assembled(places, I.subject_interests(_dated(spark, d), themes(spark)), I.screen_interests(shown)).withColumn("score", _r("score"))
    rows = I.corrected(rows, I.active_exclusions(library_corrections(spark, d)))
    return I.ranked(rows).select("topic", "score", F.array_join("evidence", ",").alias("evidence"), "rank")


@query(
    f"""with {V.ANCHORS_SQL}, ph as (select owner_id, count(*) as photographs from photos group by owner_id), an as (select owner_id, count(*) as anchors from anchors group by owner_id),
    pl as (select owner_id, count(*) as places, round(avg((visit_days = 1)::int), 9) as one_time_rate from visits group by owner_id),
    og as (select owner_id, count(*) as outings, round(median(km), 6) as median_km, round(avg(((lt0 // 86400000000 + 3) % 7 >= 5)::int), 9) as weekend_share from outings group by owner_id)
    select ph.owner_id, photographs, coalesce(anchors, 0) as anchors, coalesce(places, 0) as places, one_time_rate, coalesce(outings, 0) as outings, median_km, weekend_share
    from ph left join an on an.owner_id = ph.owner_id left join pl on pl.owner_id = ph.owner_id left join og on og.owner_id = ph.owner_id"""
)
def library_report(spark, d):
    return _report(spark, d, V._stays(spark, d))


def _report(spark, d, s):
    o = J.outings(J.numbered_stops(s))
    visits = P.visit_days(P.placed(s, 500.0))
    parts = [
        P.anchors(s).groupBy("owner_id").agg(F.count("*").alias("anchors")),
        visits.groupBy("owner_id").agg(F.count("*").alias("places"), _r(F.avg((F.col("visit_days") == 1).cast("int"))).alias("one_time_rate")),
        o.groupBy("owner_id").agg(F.count("*").alias("outings"), _r(F.median("km"), 6).alias("median_km"), _r(F.avg((M.wall_weekday(F.col("lt0")) >= 5).cast("int"))).alias("weekend_share")),
    ]
    out = photos(spark, d).groupBy("owner_id").agg(F.count("*").alias("photographs"))
    for part in parts:
        out = out.join(part, "owner_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("owner_id", "photographs", none("anchors"), none("places"), "one_time_rate", none("outings"), "median_km", "weekend_share")


_LEFT_SQL = f"""{Q.CAPTIONS_SQL.replace(PHOTOS_SQL, V.STOPS_SQL, 1)}, {V.NAMES_SQL}"""
_NEAR_NAME = f"""topics as (select owner_id, printf('place:%.5f,%.5f', lat, lon) as topic, visit_days, first_day, last_day from visits where visit_days > 1),
sited as (select *, split_part(substr(topic, 7), ',', 1)::double as y, split_part(substr(topic, 7), ',', 2)::double as x from topics),
hit as (select topic, names.label, {metres_sql("y", "x", "names.lat", "names.lon")} as m from sited, names),
named as (select topic, label from (select *, row_number() over (partition by topic order by m, label) as k from (select distinct * from hit) where m <= 25000) where k = 1)"""


@query(f"with {V.STOPS_SQL}, {V.NAMES_SQL}, {_NEAR_NAME} select topic, label from named")
def place_names(spark, d):
    return E.place_names(P.place_profile(P.visit_days(P.placed(V._stays(spark, d), 500.0))), V._names(spark, d))


@query(
    f"""with {_LEFT_SQL}, {_NEAR_NAME},
    strong as (select a.*, label, row_number() over (partition by owner_id order by round(visit_days / (visit_days + 1.0) * (visit_days / (visit_days + 3.0) * ((last_day - first_day) / (last_day - first_day + 30.0))), 12) desc, a.topic) as nth from sited a join named n on n.topic = a.topic),
    flat as (select s.photo_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as f from singles s where text is not null),
    near as (select st.topic, round({metres_sql("st.y", "st.x", "p.lat", "p.lon")}, 3) as m, p.t, case when length(f) <= 90 then f else f[1:90] || '...' end as quote from (select distinct topic, y, x from strong where nth <= 3) st, flat join photos p on p.photo_id = flat.photo_id where p.lat is not null),
    two as (select topic, string_agg(quote, ' / ' order by k) as quotes from (select *, row_number() over (partition by topic order by m, t, quote) as k from near where m <= 500) where k <= 2 group by topic)
    select owner_id, cast(nth as int) as nth, printf('Place ''%s'' was visited: 2 recorded sightings between %s and %s (score %.2f).', label, strftime(make_timestamp(first_day * 86400000000), '%Y-%m'), strftime(make_timestamp(last_day * 86400000000), '%Y-%m'), round_even(visit_days / (visit_days + 1.0), 2)) as fact from strong where nth <= 3
    union all select owner_id, cast(nth as int), printf('Near %s you photographed: %s', label, quotes) from strong s join two on two.topic = s.topic where nth <= 3"""
)
def place_facts(spark, d):
    profile = P.place_profile(P.visit_days(P.placed(V._stays(spark, d), 500.0)))
    _, singles, _ = Q._readings(spark, d)
    names = E.place_names(profile, V._names(spark, d))
    quotes = E.nearby_quotes(E.topic_points(profile), singles, photos(spark, d))
    return E.place_facts(profile, names, quotes).select("owner_id", "nth", "fact")


@query(
    f"""with {SQL["library_report"].removeprefix("with ").rsplit("select ph.owner_id", 1)[0]} , rep as (select ph.owner_id{SQL["library_report"].rsplit("select ph.owner_id", 1)[1]})
    select owner_id, 0 as nth, printf('%d photographs and %d outings were measured.', photographs, outings) as fact from rep
    union all select owner_id, 1, printf('%d distinct places were visited; %d%% were never returned to.', places, round_even(one_time_rate * 100, 0)::int) from rep
    union all select owner_id, 2, printf('%d%% of outings happened on weekends.', round_even(weekend_share * 100, 0)::int) from rep"""
)
def measure_facts(spark, d):
    return E.measure_facts(_report(spark, d, V._stays(spark, d)))


_PHRASES = " ".join(f"when '{k}' then '{v}'" for k, v in E.KIND_PHRASES.items())


_TOLD_NAMES_SQL = f"""sited_topics as (select topic, split_part(substr(topic, 7), ',', 1)::double as y, split_part(substr(topic, 7), ',', 2)::double as x from told where topic like 'place:%'),
called as (select topic, label from (select topic, label, row_number() over (partition by topic order by m, label) as k from (select topic, label, {metres_sql("y", "x", "names.lat", "names.lon")} as m from sited_topics, names) where m <= 25000) where k = 1),
tellable as (select told.*, row_number() over (order by rank) as nth, coalesce(label, told.topic) as shown from told left join called on called.topic = told.topic where label is not null or told.topic not like 'place:%')"""


@query(f"with {YEARS_THEMED_SQL}, {INSIGHTS_RANKED_SQL}, {V.NAMES_SQL}, {_TOLD_NAMES_SQL} select cast(nth as int) as nth, printf('Interest ''%s'' %s (magnitude %.2f, confidence %.2f).', shown, case kind {_PHRASES} end, round_even(magnitude, 2), round_even(confidence, 2)) as fact from tellable where nth <= 8")
def insight_facts(spark, d):
    ranked = A.in_order(C.insights(_years_history(spark, d)))
    return E.insight_facts(ranked, E.place_names(ranked.select("topic"), V._names(spark, d)))


@query(
    f"""with {YEARS_THEMED_SQL} select a.topic as held, b.topic as rising, round(a.magnitude * b.magnitude, 9) as product from ins a, ins b
    where a.kind = 'enduring' and b.kind = 'rising' and a.topic <> b.topic order by round(a.magnitude * b.magnitude, 12) desc, held, rising limit 3"""
)
def mixed_pairs(spark, d):
    return C.mixed_pairs(C.insights(_years_history(spark, d))).select("held", "rising", _r("product").alias("product"))


@query(f"with {Q.THEMED_SQL} select topic, direction, round(strength, 9) as strength, row_number() over (order by round(abs(strength - baseline), 12) desc, topic) as rank from trend")
def trend_ranked(spark, d):
    return C.trend_in_order(C.trend(Q._history(spark, d))).select("topic", "direction", _r("strength").alias("strength"), "rank")


@query(f"with {Q.THEMED_SQL} select topic, stage, row_number() over (order by list_position(['new', 'returned', 'growing', 'declining', 'dormant', 'stable'], stage), round(strength, 12) desc, topic) as rank from lif")
def lifecycle_ranked(spark, d):
    return C.lifecycles_in_order(C.lifecycles(Q._history(spark, d))).select("topic", "stage", "rank")


@query(f"with {Q.THEMED_SQL}, {INSIGHTS_RANKED_SQL} select topic, kind, rank from told")
def insights_ranked(spark, d):
    return A.in_order(C.insights(Q._history(spark, d))).select("topic", "kind", "rank")


@query(
    f"""with {Q.THEMED_SQL}, p as (select topic, max(power) filter (seq = 1) as b, max(power) filter (seq = 3) as a from h where seq in (1, 3) group by topic),
    c as (select topic, case when b is null then 'appeared' when a is null then 'gone' when a - b > 0.05 then 'stronger' when a - b < -0.05 then 'weaker' else 'steady' end as change, abs(coalesce(a, 0) - coalesce(b, 0)) as d from p)
    select topic, change, row_number() over (order by list_position(['appeared', 'gone', 'stronger', 'weaker', 'steady'], change), round(d, 12) desc, topic) as rank from c"""
)
def comparison_ranked(spark, d):
    return C.comparison_in_order(C.compare(Q._history(spark, d), 1, 3)).select("topic", "change", "rank")


@query(f"with {Q.SCREENS_SQL} select topic, score, row_number() over (order by score desc, topic) as rank from screen_interests")
def screen_ranked(spark, d):
    return with_rank(I.screen_interests(Q.screens(spark, d)).withColumn("score", _r("score")), F.desc("score"), F.asc("topic")).select("topic", "score", "rank")


@query(f"with {V.ANCHORS_SQL} select {V._PLACE_COLS}, visit_days, cast(row_number() over (partition by owner_id order by visit_days desc, t0) as int) as rank from anchors")
def anchors_ranked(spark, d):
    return P.anchors_in_order(P.anchors(V._stays(spark, d))).select(*V._at(), "visit_days", "rank")


@query(f"with {V.STOPS_SQL} select * from (select {V._PLACE_COLS}, visits, cast(row_number() over (partition by owner_id order by visits desc, lat, lon) as int) as rank from profiles) where rank <= 15")
def place_profiles_ranked(spark, d):
    return P.profiles_in_order(P.place_profiles(P.placed(V._stays(spark, d), 150.0)), 15).select(*V._at(), "visits", "rank")


@query(f"with {V.TRIPS_SQL} select * from (select owner_id, t0, nights, cast(row_number() over (partition by owner_id order by t0 desc) as int) as rank from trips) where rank <= 15")
def trips_newest(spark, d):
    return J.trips_newest_first(V._trips(spark, d)[0]).select("owner_id", "t0", "nights", "rank")


@query(f"with {V.STOPS_SQL} select p.photo_id from photos p where coalesce(kind, 'photo') in ('photo', 'other') and coalesce(preference, true) and k % 10 <> 0 and photo_id not in (select unnest(ids) from stays)")
def lone_photographs(spark, d):
    p = photos(spark, d).withColumn("thumbnail", F.when(F.col("k") % 10 != 0, F.col("photo_id")))
    return L.lone_photographs(p, V._stays(spark, d)).select("photo_id")


@query(
    f"""with {V.STOPS_SQL}, s as (select owner_id, outing, ids, row_number() over (partition by owner_id, outing order by t0, t1) as nth from numbered)
    select o.owner_id, outing_id, cast(nth as int) as nth, unnest(ids) as photo_id from s join outings o on o.owner_id = s.owner_id and o.outing = s.outing"""
)
def outing_photographs(spark, d):
    return J.outing_photographs(J.numbered_stops(V._stays(spark, d)))


_REFUSABLE_SQL = f"""{Q.CAPTIONS_SQL},
all_readings as (select 'captions' as kind, doc_id, text is null or doc_id % 9 = 0 as refused from documents where doc_id % 3 = 0 union all select 'singles', doc_id, doc_id % 10 = 1 from documents where doc_id % 3 = 1
  union all select 'screens', doc_id, doc_id % 8 = 2 from documents where doc_id % 3 = 2 union all select 'subjects', doc_id, doc_id % 10 = 3 from documents)"""


def _tables(spark, d):
    """All tables of a library that a deletion or a retention rule reaches."""
    n, i, docs = table(spark, d, "events").count(), F.col("doc_id"), table(spark, d, "documents")
    captions, singles, shots = Q._readings(spark, d)
    index = R.gather(captions, singles, shots, photos(spark, d))
    at = i.alias("created_at")
    photo = F.concat(F.lit("photo-"), i % n).alias("photo_id")
    refused = lambda test: F.when(test, "model refused").alias("refused")
    word = F.array(F.lit("word"))
    return {
        "photos": photos(spark, d),
        "captions": docs.filter(i % 3 == 0).select(i.cast("string").alias("key"), F.array(F.concat(F.lit("photo-"), i % n), F.concat(F.lit("photo-"), (i * 7 + 1) % n)).alias("photo_ids"), refused(F.col("text").isNull() | (i % 9 == 0)), at),
        "singles": docs.filter(i % 3 == 1).select(photo, refused(i % 10 == 1), at),
        "screens": docs.filter(i % 3 == 2).select(photo, refused(i % 8 == 2), F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(word).alias("labels"), at),
        "subjects": docs.select(F.when(i % 3 == 0, i.cast("string")).otherwise(F.concat(F.lit("other"), i)).alias("key"), refused(i % 10 == 3), at),
        "documents": index.select("doc_key"),
        "embeddings": table(spark, d, "embeddings").select(F.concat(F.lit("stay:"), "vec_id").alias("doc_key")),
    }


# What speaks about a set of photographs ``gone``: rows of each table by name, and whether they go.
_CASCADE_SQL = """hit as (select distinct key from (select key, unnest(photo_ids) as photo_id from captions) where photo_id in (select photo_id from gone)),
gone_docs as (select 'single:' || photo_id as doc_key from gone union all select 'screen:' || photo_id from gone union all select 'stay:' || key from hit),
fate as (
  select 'photos' as what, photo_id in (select photo_id from gone) as goes, null::boolean as refused, null::bigint as made_at from photos
  union all select 'captions', key in (select key from hit), text is null, key::bigint from captions
  union all select 'subjects', doc_id % 3 = 0 and doc_id in (select key from hit), doc_id % 10 = 3, doc_id from documents
  union all select 'singles', photo_id in (select photo_id from gone), doc_id % 10 = 1, doc_id from (select doc_id, 'photo-' || (doc_id % n) as photo_id from documents, n_events where doc_id % 3 = 1)
  union all select 'screens', photo_id in (select photo_id from gone), doc_id % 8 = 2, doc_id from (select doc_id, 'photo-' || (doc_id % n) as photo_id from documents, n_events where doc_id % 3 = 2)
  union all select 'documents', doc_key in (select doc_key from gone_docs), null, null from docs
  union all select 'embeddings', 'stay:' || vec_id in (select doc_key from gone_docs), null, null from embeddings)"""


@query(f"with {Q.CAPTIONS_SQL}, gone as (select photo_id from photos where owner_id = 1 and k % 5 = 0), {_CASCADE_SQL} select what, count(*) filter (goes) as gone, count(*) filter (not goes) as \"left\" from fate group by what")
def forget_cascade(spark, d):
    t = _tables(spark, d)
    return S.forget_counts(t, t["photos"].filter("owner_id = 1 and k % 5 = 0").select("photo_id"))


CUT_US, CUT_REFUSED = (1704067200 + 10 * 86400) * 1_000_000, 500


@query(
    f"""with {_REFUSABLE_SQL}, {Q.PROFILES_SQL}, r as (select *, row_number() over (order by generated_at desc, seq desc) as recent from profs), o as (select *, row_number() over (partition by strftime(generated_at, '%Y-%m') order by generated_at, seq) as first from r where recent > 12)
    select 'photographs' as what, count(*) as n from photos where t < {CUT_US} union all select 'refusals', count(*) from all_readings where refused and doc_id < {CUT_REFUSED} union all select 'profiles', count(*) from o where first > 1"""
)
def retention_plan(spark, d):
    t = _tables(spark, d)
    refusable = {k: t[k] for k in ("captions", "subjects", "screens", "singles")}
    return S.retention_counts(t["photos"], refusable, _profiles(spark, d), F.lit(CUT_US), F.lit(CUT_REFUSED), 12)


def _profiles(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("generated_at"))


@query(
    f"""with {Q.CAPTIONS_SQL}, gone as (select photo_id from photos where t < {CUT_US}), {_CASCADE_SQL},
    {Q.PROFILES_SQL}, r as (select *, row_number() over (order by generated_at desc, seq desc) as recent from profs), o as (select *, row_number() over (partition by strftime(generated_at, '%Y-%m') order by generated_at, seq) as first from r where recent > 12)
    select what, count(*) filter (not goes and not coalesce(refused and made_at < {CUT_REFUSED}, false)) as n from fate group by what
    union all select 'profiles', (select count(*) from profs) - (select count(*) from o where first > 1)"""
)
def retention_applied(spark, d):
    left, kept_profiles = S.retained(_tables(spark, d), _profiles(spark, d), F.lit(CUT_US), F.lit(CUT_REFUSED), 12)
    out = kept_profiles.agg(F.lit("profiles").alias("what"), F.count("*").alias("n"))
    for name, df in left.items():
        out = out.unionByName(df.agg(F.lit(name).alias("what"), F.count("*").alias("n")))
    return out


@query("select version, count(*) as n from (select doc_id, case when doc_id % 4 = 2 then 'v1' when doc_id % 4 <> 0 then 'v2' end as version, case when doc_id % 6 = 0 then 'no thumbnail: gone' when doc_id % 6 = 1 then 'model refused' end as refused from documents) where not (coalesce(starts_with(refused, 'no thumbnail'), false) or (refused is null and (version is null or version <> 'v2'))) group by version")
def readings_cleared(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(i % 6 == 0, "no thumbnail: gone").when(i % 6 == 1, "model refused").alias("refused"), F.when(i % 4 == 2, "v1").when(i % 4 != 0, "v2").alias("version"))
    return S.cleared(rows, "v2").groupBy("version").agg(F.count("*").alias("n"))


@query(
    f"""with {_REFUSABLE_SQL}, {LIBRARY_CORRECTIONS_SQL}
    select 'photographs' as what, count(*) as n from photos union all select 'located', count(lat) from photos union all select 'withheld_from_preference', count(*) from photos where preference = false
    union all select 'stay_captions', count(*) from all_readings where kind = 'captions' union all select 'stay_refused', count(*) from all_readings where kind = 'captions' and refused
    union all select 'single_captions', count(*) from all_readings where kind = 'singles' union all select 'single_refused', count(*) from all_readings where kind = 'singles' and refused
    union all select 'screen_readings', count(*) from all_readings where kind = 'screens' union all select 'screens_label_silent', count(*) from all_readings where kind = 'screens' and not refused and doc_id % 4 = 0
    union all select 'subject_readings', count(*) from documents union all select 'kept_profiles', count(*) from orders union all select 'corrections', count(*) from labels union all select 'active_exclusions', count(*) from barred"""
)
def privacy_report(spark, d):
    t, said = _tables(spark, d), library_corrections(spark, d)
    return S.privacy_counts(t["photos"], t["captions"], t["singles"], t["screens"], t["subjects"], _profiles(spark, d), said, I.active_exclusions(said))


_HISTORY_REST = Q.THEMED_SQL.replace(PHOTOS_SQL, "", 1).replace(f"{THEMES_SQL},", "", 1).replace("seen as (select topic, count(distinct seq)", "held as (select topic, count(distinct seq)").replace("coalesce(seen.topic, trend.topic)", "coalesce(held.topic, trend.topic)").replace("from seen full join trend on seen.topic", "from held full join trend on held.topic").lstrip(", \n")
_TIMELINES = {"photographs": ("orders", "o_orderdate", "true"), "outings": ("lineitem", "l_shipdate", "l_linestatus = 'O'"), "screens": ("lineitem", "l_shipdate", "l_returnflag = 'R'")}
TIMELINES_SQL = f"""moments as ({" union all ".join(f"select '{n}' as series, cast(date_trunc('month', {at}) as date) as month from {t} where {test}" for n, (t, at, test) in _TIMELINES.items())}),
counts as (select series, month, count(*) as n from moments group by all), span as (select series, min(month) as a, max(month) as b from counts group by series),
months as (select series, cast(unnest(generate_series(a, b, interval 1 month)) as date) as month from span),
monthly as (select m.series, m.month, coalesce(n, 0) as n from months m left join counts c on c.series = m.series and c.month = m.month)"""


def _timelines(spark, d):
    out = None
    for name, (t, at, test) in _TIMELINES.items():
        one = table(spark, d, t).filter(test).select(F.lit(name).alias("series"), F.col(at).alias("at"))
        out = one if out is None else out.unionByName(one)
    return M.monthly(out, F.col("series"), F.col("at"))


@query(V.SQL["alignment_pearson"].replace(V.ORDERS_SQL, TIMELINES_SQL))
def timelines_aligned(spark, d):
    return M.alignment(_timelines(spark, d)).select("left", "right", "months", "relation", _r("alignment", 6).alias("alignment"))


@query(V.SQL["drift_stage"].replace(V.LINES_SQL, TIMELINES_SQL))
def timelines_drift(spark, d):
    return M.drift(_timelines(spark, d)).withColumn("baseline", _r("baseline", 6))


@query(
    f"""with {DATED_SEEN_SQL}, p as ({_DATED_SCORE.format("spoken")}), {_HISTORY_REST}
    select 'interests' as part, cast(row_number() over (order by round(score * confidence, 9) desc, topic) as int) as nth, topic, strftime(to_timestamp(first_at), '%Y-%m') as a, strftime(to_timestamp(last_at), '%Y-%m') as b from p
    union all select 'lifecycles', cast(row_number() over (order by list_position(['new', 'returned', 'growing', 'declining', 'dormant', 'stable'], stage), round(strength, 12) desc, topic) as int), topic, stage, null from lif"""
)
def export_read_back(spark, d):
    """The exported JSON document, read again."""
    profile = I.subject_interests(_dated(spark, d), themes(spark)).withColumns({"score": _r("score"), "confidence": _r("confidence")})
    stages = C.lifecycles_in_order(C.lifecycles(Q._history(spark, d)))
    shape = "schema string, version int, interests array<struct<topic:string,score:double,confidence:double,first_seen:string,last_seen:string>>, lifecycles array<struct<topic:string,stage:string>>"
    doc = Y.export_document(profile, stages, "2024-02-01").select(F.from_json("payload", shape).alias("x")).filter(f"x.schema = '{Y.EXPORT_SCHEMA}' and x.version = {Y.EXPORT_VERSION}")
    one = doc.select(F.lit("interests").alias("part"), F.posexplode("x.interests").alias("nth", "i")).select("part", "nth", "i.topic", F.col("i.first_seen").alias("a"), F.col("i.last_seen").alias("b"))
    two = doc.select(F.lit("lifecycles").alias("part"), F.posexplode("x.lifecycles").alias("nth", "i")).select("part", "nth", "i.topic", F.col("i.stage").alias("a"), F.lit(None).cast("string").alias("b"))
    return one.unionByName(two).withColumn("nth", F.col("nth") + 1)


@query(
    """with r as (select p_partkey, p_partkey % 5 > 0 as j, p_partkey % 3 = 1 as c, p_partkey % 7 = 2 as s, p_partkey % 11 = 3 as p from part),
    l as (select p_partkey, list_filter([case when p then 'photograph' end, case when j then 'journey' end, case when c then 'stay caption' end, case when s then 'screen reading' end], lambda x: x is not null) as l from r)
    select p_partkey, case len(l) when 0 then '' when 1 then 'read from ' || l[1] else 'read from ' || array_to_string(l[:-2], ', ') || ' and ' || l[-1] end as told from l"""
)
def sources_told(spark, d):
    k = F.col("p_partkey")
    refs = F.array_compact(F.array(F.when(k % 7 == 2, "screen:1"), F.when(k % 5 > 0, "place:1,2"), F.when(k % 5 > 0, "place:3,4"), F.when(k % 3 == 1, "stay:x"), F.when(k % 11 == 3, "plain")))
    return table(spark, d, "part").select("p_partkey", read_from(refs).alias("told"))
