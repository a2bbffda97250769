"""Queries over evidence: places of documents, facts, checks of stories, profiles in force, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.globs import excluded
from waymark.operators import change as C
from waymark.operators import evidence as E
from waymark.operators import interests as I
from waymark.operators import retrieval as R
from waymark.plans import journey_queries, reading_queries
from waymark.plans.asking_queries import DOCS_BM25_SQL
from waymark.plans.reading_queries import _SCORE, CAPTIONS_SQL, SEEN_SQL, _readings
from waymark.sources.bindings import PHOTOS_SQL, photos, subjects, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


STORIES_SQL = """stories as (select doc_id, case doc_id % 5 when 0 then '' when 1 then 'Walked 120 km [F1-F3].' when 2 then 'Saw 45 places and 0120 parks [F1][F' || (doc_id % 7) || '].'
  when 3 then 'Nothing here in 2024.' else 'Then 82 per cent [F2 to F' || (doc_id % 4 + 1) || '] and 1,200 steps.' end as story,
  (['120 km were walked.', '45 places; 82% never seen again.', '1200 steps on 7 days.'])[1:doc_id % 4] as facts from documents)"""


def _stories(spark, d):
    i = F.col("doc_id")
    story = (
        F.when(i % 5 == 0, "").when(i % 5 == 1, "Walked 120 km [F1-F3].").when(i % 5 == 2, F.concat(F.lit("Saw 45 places and 0120 parks [F1][F"), i % 7, F.lit("].")))
        .when(i % 5 == 3, "Nothing here in 2024.").otherwise(F.concat(F.lit("Then 82 per cent [F2 to F"), i % 4 + 1, F.lit("] and 1,200 steps.")))
    )
    facts = F.slice(F.array(F.lit("120 km were walked."), F.lit("45 places; 82% never seen again."), F.lit("1200 steps on 7 days.")), F.lit(1), (i % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", story.alias("story"), facts.alias("facts"))


_DIGITS = r"list_transform(list_filter(list_transform(regexp_extract_all({0}, '\d[\d,._]*'), lambda x: regexp_replace(x, '[^\d]', '', 'g')), lambda x: length(x) >= 2), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end)"
_CITED = r"\[\s*F\s*(\d+)(?:\s*(?:,|-|--|to)\s*F?\s*(\d+))*\s*\]"
_STATED, _SUPPORTED = _DIGITS.format(f"regexp_replace(story, '{_CITED}', ' ', 'g')"), _DIGITS.format("array_to_string(facts, ' ')")


@query(
    rf"""with {STORIES_SQL}, g as (select *, regexp_extract_all(story, '{_CITED}') as groups from stories),
    c as (select doc_id, story, facts, flatten(list_transform(groups, lambda x: list_transform(regexp_extract_all(x, '\d+'), lambda y: y::bigint))) as ends, {_STATED} as stated, {_SUPPORTED} as supported from g)
    select doc_id, case when story = '' or len(facts) = 0 then '' else concat_ws('+', case when len(ends) = 0 then 'uncited' when len(list_filter(ends, lambda x: x < 1 or x > len(facts))) > 0 then 'unknown citation' end,
      case when len(list_filter(stated, lambda x: not list_contains(supported, x))) > 0 then 'unsupported number' end) end as defects from c"""
)
def narration_defects(spark, d):
    return E.narration_defects(_stories(spark, d)).select("doc_id", F.array_join("defects", "+").alias("defects"))


@query(
    rf"""with {STORIES_SQL}, g as (select doc_id, unnest(regexp_extract_all(story, '{_CITED}')) as x from stories),
    n as (select doc_id, x, list_transform(regexp_extract_all(x, '\d+'), lambda y: y::bigint) as f from g),
    r as (select doc_id, unnest(case when (len(f) = 2 and contains(x, '-')) or contains(x, 'to') then generate_series(list_min(f), list_max(f)) else f end) as fact from n)
    select doc_id, fact, count(*) as n from r group by all"""
)
def cited_fact_ranges(spark, d):
    return _stories(spark, d).select("doc_id", F.explode(E.cited_facts(F.col("story"), F.lit(100))).alias("fact")).groupBy("doc_id", "fact").agg(F.count("*").alias("n"))


@query(
    """with m as (select c_custkey as owner_id, unnest([date '1996-06-01', date '1999-01-01']) as at from customer)
    select m.owner_id, strftime(m.at, '%Y-%m-%d') as at, max(o_orderkey) as seq from m left join orders o on o.o_custkey = m.owner_id and cast(o.o_orderdate as date) <= m.at group by all"""
)
def profile_as_of(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.to_date("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    days = F.array(*(F.lit(x).cast("date") for x in ("1996-06-01", "1999-01-01")))
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.explode(days).alias("at"))
    return E.profiles_as_of(p, m, "owner_id").withColumn("at", F.date_format("at", "yyyy-MM-dd"))


@query(
    f"""with {CAPTIONS_SQL}, pts as (
      select 'stay:' || key as doc_key, avg(lat) as lat, avg(lon) as lon from (select key, unnest(photo_ids) as photo_id from captions where text is not null) c join photos p on p.photo_id = c.photo_id where lat is not null group by key
      union all select 'single:' || s.photo_id, lat, lon from singles s join photos p on p.photo_id = s.photo_id where text is not null and lat is not null)
    select doc_key, round(lat + 3.3e-8::double, 6) as lat, round(lon + 3.3e-8::double, 6) as lon from pts"""
)
def document_points(spark, d):
    captions, singles, _ = _readings(spark, d)
    p = E.document_points(captions, singles, photos(spark, d))
    return p.select("doc_key", *(F.round(F.col(c) + 3.3e-8, 6).alias(c) for c in ("lat", "lon")))


@query(
    f"""with {CAPTIONS_SQL}, {DOCS_BM25_SQL},
    vec as (select 'stay:' || vec_id as doc_key, list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as score from embeddings where 'stay:' || vec_id in (select doc_key from docs) order by score desc, doc_key limit 30),
    rk as (select doc_key, row_number() over (order by score desc, doc_key) as r from bm where score > 0 qualify r <= 30 union all select doc_key, row_number() over (order by score desc, doc_key) from vec),
    best as (select doc_key, sum(1.0::double / (60 + r)) as score from rk group by doc_key order by score desc, doc_key limit 8),
    told as (select docs.*, row_number() over (order by score desc, docs.doc_key) as k from best join docs on docs.doc_key = best.doc_key)
    select count(*)::int as n, string_agg('[F' || k || '] (' || strftime(make_timestamp(t), '%Y-%m-%d') || ', ' || kind || ') ' || text, chr(10) order by k) as facts from told"""
)
def numbered_facts(spark, d):
    docs = R.gather(*_readings(spark, d), photos(spark, d))
    vectors, question = reading_queries._vectors(spark, d)
    words = R.bm25(docs, reading_queries.WORDS)
    meaning = R.dense(vectors.join(docs.select("doc_key").distinct(), "doc_key", "left_semi"), question, 30)
    return E.numbered_facts(docs, R.fuse({"words": words, "meaning": meaning}))


@query(r"select doc_id, case when length(f) <= 90 then f else f[1:90] || '...' end as quote from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as f from documents)")
def clipped_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", E.clipped(F.col("text")).alias("quote"))


@query(
    f"""with {SEEN_SQL}, p as ({_SCORE.format('plain')}), k as (select *, row_number() over (order by round(score * confidence, 9) desc, topic) as nth from p)
    select topic, nth, printf('Subject ''%s'' was seen at %d recorded sightings between %s and %s (score %.2f, confidence %.2f).', topic, len(string_split(evidence, ',')), strftime(to_timestamp(first_at), '%Y-%m'), strftime(to_timestamp(last_at), '%Y-%m'),
      round_even(score, 2), round_even(confidence, 2)) as fact from k where nth <= 8"""
)
def subject_facts(spark, d):
    return E.subject_facts(I.subject_interests(subjects(spark, d)))


@query(
    f"""with {PHOTOS_SQL} select count(*) filter (t > {(1704067200 + 20 * 86400) * 1_000_000}) as newer, count(*) filter (k % 10 = 0) as without_thumbnail,
    (select count(*) from documents where doc_id % 6 = 0) as recoverable from photos"""
)
def health(spark, d):
    p = photos(spark, d).withColumn("thumbnail", F.when(F.col("k") % 10 != 0, F.col("photo_id")))
    r = table(spark, d, "documents").select(F.when(F.col("doc_id") % 6 == 0, "no thumbnail: gone").when(F.col("doc_id") % 6 == 1, "model refused").alias("refused"))
    return E.health(p, r, (1704067200 + 20 * 86400) * 1_000_000)


@query(
    """with f as (select p_partkey, ['backup/a/', 'trip/', ''][p_partkey % 3 + 1] || 'img' || p_partkey || ['.png', '.jpg', '.jpeg'][p_partkey % 4 % 3 + 1] as path from part)
    select p_partkey from f where not (path glob 'backup/*' or path glob '*.png' or path glob 'img?.jp*' or regexp_extract(path, '[^/]*$') glob 'img?.jp*')"""
)
def included_files(spark, d):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (i + 1).cast("int"))
    path = F.concat(pick(["backup/a/", "trip/", ""], k % 3), F.lit("img"), k, pick([".png", ".jpg", ".jpeg"], k % 4 % 3))
    return table(spark, d, "part").select("p_partkey", path.alias("path")).filter(~excluded(F.col("path"), ["backup/*", "*.png", "img?.jp*"])).select("p_partkey")


@query(
    f"""with a as (select owner_id, 'revisit' as kind, reference, confidence, -ratio as o from ({journey_queries.SQL["suggest_revisit"]})),
    b as (select unnest([0, 1, 2, 3, 4, 5, 6]) as owner_id, 'revive' as kind, reference, confidence, rank as o from ({reading_queries.SQL["suggest_revive"]})),
    r as (select *, (row_number() over (partition by owner_id order by kind = 'revive', o, reference))::int as rank from (select * from a union all select * from b))
    select owner_id, rank, kind, reference, confidence from r where rank <= 5"""
)
def suggestions(spark, d):
    return suggested(spark, d, journey_queries.suggest_revisit(spark, d))


def suggested(spark, d, revisits):
    topics = reading_queries.suggest_revive(spark, d).withColumn("owner_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(7)))))
    return C.suggestions(revisits, topics)
