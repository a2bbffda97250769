"""Queries of the model stages: what a run looks at, what it reports, and what its answers become."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from waymark.operators import stages as G
from waymark.plans import journey_queries as V
from waymark.plans import reading_queries as Q
from waymark.sources.bindings import DAY_US, photos
from waymark.sources.scratch import kept, shared_folder

QUERIES, SQL = {}, {}
#: Before this instant everything was asked in an earlier run.
ASKED_US, LIMIT = (1704067200 * 1_000_000) + 9 * DAY_US, 40


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _referenced(spark, d):
    """Photographs with thumbnails, but for every tenth."""
    return photos(spark, d).withColumn("thumbnail", F.when(F.col("k") % 10 != 0, F.concat(F.lit("thumbs/"), "photo_id")))


# ``looked`` has key, request, status and nth of a stage.
_FIT = "k % 10 <> 0 and coalesce(preference, true)"
STAY_LOOKED_SQL = f"""{V.STOPS_SQL}, each as (select s.owner_id, s.t0, list_min(s.ids) as any_id, p.photo_id, p.t, coalesce({_FIT.replace("k %", "p.k %").replace("preference", "p.preference")}, false) as fit, not coalesce(p.preference, true) as held
    from (select *, unnest(ids) as id from stays) s join photos p on p.photo_id = s.id),
firsts as (select any_id, min_by(photo_id, (t, photo_id)) as stop from each group by any_id),
numbered_fit as (select *, row_number() over (partition by any_id order by t, photo_id) - 1 as i, count(*) over (partition by any_id) as n from each where fit),
seen as (select any_id, array_to_string(list(photo_id order by t, photo_id), ' ') as request, substr(sha256(array_to_string(list_sort(list(photo_id)), '|')), 1, 16) as key from numbered_fit
  where n <= 3 or i in (0, n - 1, cast(round_even((n - 1) / 2, 0) as bigint)) group by any_id),
rows as (select e.any_id, min(e.t0) as t0, bool_or(held) as held from each e group by e.any_id),
looked as (select key, request, case when key is null then case when held then 'withheld' else 'unreferenced' end when t0 < {ASKED_US} then 'already' else 'pending' end as status, row_number() over (order by t0, stop) as nth
  from rows left join seen using (any_id) join firsts using (any_id))"""


def _stays_looked(spark, d):
    s, p = V._stays(spark, d), _referenced(spark, d)
    none = spark.createDataFrame([], "key string")
    done = G.stay_selection(s.filter(F.col("t0") < ASKED_US), p, none).filter("status = 'pending'")
    return G.stay_selection(s, p, done)


@query(f"with {STAY_LOOKED_SQL} select key, coalesce(request, '') as request, status, nth from looked")
def stay_selection(spark, d):
    return _stays_looked(spark, d).withColumn("request", F.coalesce("request", F.lit("")))


def _photo_looked_sql(rows: str) -> str:
    return f"""select case when {_FIT} then photo_id end as key, case when k % 10 <> 0 then 'thumbs/' || photo_id end as request,
      case when not coalesce(preference, true) then 'withheld' when k % 10 = 0 then 'unreferenced' when t < {ASKED_US} then 'already' else 'pending' end as status, row_number() over (order by t, photo_id) as nth from {rows}"""


@query(f"with {Q.PHOTOS_SQL} {_photo_looked_sql('photos')} where kind = 'screenshot'")
def screen_selection(spark, d):
    p = _referenced(spark, d)
    return G.screen_selection(p, p.filter(F.col("t") < ASKED_US).select(F.col("photo_id").alias("key")))


@query(f"with {V.STOPS_SQL}, alone as (select * from photos where coalesce(kind, 'photo') in ('photo', 'other') and coalesce(preference, true) and photo_id not in (select unnest(ids) from stays)) {_photo_looked_sql('alone')}")
def single_selection(spark, d):
    p = _referenced(spark, d)
    return G.single_selection(p, V._stays(spark, d), p.filter(F.col("t") < ASKED_US).select(F.col("photo_id").alias("key")))


def caption_model(requests: list[str]) -> list[tuple[str | None, str | None]]:
    """Stands for a captioner: a sentence about the photographs, and a refusal of some."""
    return [(None, "model refused") if int(r.rsplit("-", 1)[1]) % 5 == 0 else (f"seen: {r}", None) for r in requests]


@query(
    f"""with {STAY_LOOKED_SQL}, cut as (select max(nth) as last, count(*) as asked from (select nth from looked where status = 'pending' order by nth limit {LIMIT})),
    run as (select l.*, status = 'pending' and cast(regexp_extract(request, '(\\d+)$', 1) as bigint) % 5 = 0 as no from looked l, cut where asked < {LIMIT} or nth <= last)
    select count(*) filter (status = 'pending' and not no) as captioned, count(*) filter (status = 'already') as already, count(*) filter (no) as refused,
      count(*) filter (status = 'unreferenced') as unreferenced, count(*) filter (status = 'withheld') as withheld, false as paused from run"""
)
def caption_report(spark, d):
    store = f"{shared_folder(spark)}/captions-{uuid.uuid4().hex}"
    got = G.run(_stays_looked(spark, d), caption_model, store, "v1", limit=LIMIT, wave=16, batch=4)
    return spark.createDataFrame([got], "captioned long, already long, refused long, unreferenced long, withheld long, paused boolean")


def subject_model(requests: list[str]) -> list[tuple[str | None, str | None]]:
    """Stands for a language model: the first three words as a list, prose for some texts, a refusal of others."""
    out: list[tuple[str | None, str | None]] = []
    for r in requests:
        if len(r) % 11 == 0:
            out.append((None, "model refused"))
        elif len(r) % 7 == 0:
            out.append((f"about {r}", None))
        else:
            out.append(("Labels:\n" + json.dumps(r.split(" ")[:3]), None))
    return out


@query(
    f"""with {Q.CAPTIONS_SQL}, req as (select cast(key as varchar) as key, 0 as part, text from captions where text is not null
      union all select substr(sha256(photo_id), 1, 16), 1, text from singles where text is not null),
    one as (select key, text from (select *, row_number() over (partition by key order by part, text) as n from req) where n = 1),
    ans as (select *, case when length(text) % 11 = 0 then 'model refused' when length(text) % 7 = 0 then 'unparseable answer: ' || left('about ' || text, 80) end as why,
      list_distinct(list_filter(list_transform(string_split(text, ' ')[1:3], lambda x: trim(lower(x), ' ')), lambda x: x <> '')) as ls from one)
    select key, case when why is null and len(ls) > 0 then array_to_string(list_sort(ls), '|') else '' end as labels, coalesce(why, case when len(ls) = 0 then 'empty' end) as refused from ans"""
)
def subject_outcomes(spark, d):
    captions, singles, _ = Q._readings(spark, d)
    none = spark.createDataFrame([], "key string")
    store = f"{shared_folder(spark)}/subjects-{uuid.uuid4().hex}"
    G.run(G.subject_selection(captions, singles, none), subject_model, store, "v1", wave=500)
    got = kept(G.read_subjects(G.results(spark, store)), "subjects")
    return got.select("key", F.array_join(F.array_sort("labels"), "|").alias("labels"), "refused")


# Labels of ten owners, a vector each: near one of seven directions, more or less; and the stays that they were seen on.
LABELS_SQL = """labels as (
  select (e.vec_id // 7 % 10) as owner_id, 'label ' || e.vec_id as label, list_transform(list_zip(b.embedding::double[], e.embedding::double[]), lambda x: x[1] + x[2] * (0.4 + e.vec_id % 5 * 0.2::double)) as v,
    [e.vec_id % 3, 10 + e.vec_id % 5, 20 + e.vec_id // 10 % 4][1:1 + e.vec_id % 3] as stays from embeddings e join embeddings b on b.vec_id = e.vec_id % 7),
ranked as (select owner_id, label, stays, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u, row_number() over (partition by owner_id order by len(stays) desc, label) as i from labels)"""


def _labels(spark, d):
    from waymark.sources.bindings import table

    e, b = table(spark, d, "embeddings"), table(spark, d, "embeddings").select(F.col("vec_id").alias("base"), F.col("embedding").alias("towards"))
    i = F.col("vec_id")
    rows = e.join(F.broadcast(b.filter("base < 7")), i % 7 == F.col("base"))  # seven rows
    v = F.zip_with("towards", "embedding", lambda x, y: x.cast("double") + y.cast("double") * (F.lit(0.4) + i % 5 * 0.2))
    stays = F.slice(F.array(i % 3, 10 + i % 5, 20 + F.floor(i / 10) % 4), F.lit(1), (1 + i % 3).cast("int"))
    return rows.select((F.floor(i / 7) % 10).alias("owner_id"), F.concat(F.lit("label "), i).alias("label"), v.alias("vector"), stays.alias("stays"))


@query(
    f"""with recursive {LABELS_SQL}, fold as (
      select owner_id, i, [{{'s': u, 'st': stays}}] as gs, [1] as put from ranked where i = 1
      union all
      select owner_id, i, case when hit is null then list_append(gs, {{'s': u, 'st': stays}}) else list_transform(gs, lambda g, j: case when j = hit then {{'s': list_transform(list_zip(g.s, u), lambda x: x[1] + x[2]), 'st': list_distinct(list_concat(g.st, stays))}} else g end) end,
        list_append(put, cast(coalesce(hit, len(gs) + 1) as int))
      from (select *, case when sims[top] >= 0.75 or (sims[top] >= 0.6 and len(list_intersect(stays, gs[top].st)) / len(stays) >= 0.5) then top end as hit
        from (select *, list_position(sims, list_max(sims)) as top from (select r.*, f.gs, f.put, list_transform(f.gs, lambda g: list_inner_product(g.s, r.u) / sqrt(list_inner_product(g.s, g.s))) as sims from fold f join ranked r on r.owner_id = f.owner_id and r.i = f.i + 1)))),
    ended as (select owner_id, put from fold where (owner_id, i) in (select owner_id, max(i) from ranked group by owner_id)),
    member as (select owner_id, unnest(put) as g, unnest(generate_series(1, len(put))) as i from ended),
    big as (select owner_id, g, row_number() over (partition by owner_id order by g) - 1 as theme from member group by owner_id, g having count(*) >= 2)
    select m.owner_id, cast(theme as int) as theme, label from member m join big using (owner_id, g) join ranked r on r.owner_id = m.owner_id and r.i = m.i"""
)
def theme_clusters(spark, d):
    from waymark.operators.models import cluster_labels

    return cluster_labels(_labels(spark, d))


def story_model(instruction: str, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Stands for a language model: by the length of the list it cites it well, cites nothing, cites beyond it, or counts on its own."""
    out: list[tuple[str | None, str | None]] = []
    for p in prompts:
        n = p.count("\n") + 1
        said = {0: f"You went out [F1-F{n}].", 1: "You went out.", 2: f"You went out [F{n + 1}].", 3: "You went out 7654321 times [F1]."}[len(p) % 4]
        out.append((said, None))
    return out


def _told_sql() -> str:
    from waymark.plans import evidence_queries as X
    from waymark.plans import library_queries as Y

    return f"""all_facts as (
      select owner_id, 0 as part, nth, fact from ({Y.SQL["measure_facts"]}) union all select owner_id, 1, nth, fact from ({Y.SQL["place_facts"]})
      union all select owner_id, 2, nth, fact from ({X.SQL["subject_facts"]}), (select distinct user_id % 4 as owner_id from events)),
    listed as (select owner_id, list(fact order by part, nth, fact) as facts from all_facts group by owner_id),
    prompted as (select owner_id, facts, len(facts) as n, array_to_string(list_transform(facts, lambda f, i: '[F' || i || '] ' || f), chr(10)) as prompt from listed),
    narrated as (select *, case length(prompt) % 4 when 0 then 'You went out [F1-F' || n || '].' when 1 then 'You went out.' when 2 then 'You went out [F' || (n + 1) || '].' else 'You went out 7654321 times [F1].' end as story,
      ['', 'uncited', 'unknown citation', 'unsupported number'][length(prompt) % 4 + 1] as defects from prompted)"""


@query(f"with {_told_sql()} select owner_id, prompt, story, defects from narrated")
def profile_told(spark, d):
    from waymark.operators import telling as T
    from waymark.plans import library_queries as Y
    from waymark.plans.evidence_queries import subject_facts

    measures = kept(Y.measure_facts(spark, d), "facts")
    listed = kept(T.facts_in_order(measures.select("owner_id").distinct(), [measures, Y.place_facts(spark, d), subject_facts(spark, d).select("nth", "fact")]), "listed")
    told = T.tell(listed, story_model, T.system(T.PROFILE_SYSTEM, "ja"))
    return told.join(listed.select("owner_id", T.prompt(F.col("facts")).alias("prompt")), "owner_id").select("owner_id", "prompt", "story", F.array_join("defects", "+").alias("defects"))


def screen_model(requests: list[str]) -> list[tuple[str | None, str | None]]:
    """Stands for a reader of screenshots: an object about the reference, prose for some, a refusal of others."""
    out: list[tuple[str | None, str | None]] = []
    for r in requests:
        k = int(r.rsplit("-", 1)[1])
        category = ("map", "Chat ", "unheard", "finance")[k % 4]
        out.append((None, "model refused") if k % 9 == 0 else ("no object", None) if k % 7 == 0 else (json.dumps({"category": category, "labels": [f" Label {k % 5}", "", "Two"]}), None))
    return out


@query(
    f"""with {Q.PHOTOS_SQL}, looked as ({_photo_looked_sql("photos")} where kind = 'screenshot'), asked as (select key, cast(regexp_extract(key, '(\\d+)$', 1) as bigint) as n from looked where status = 'pending'),
    kinds as (select *, case when n % 9 <> 0 and n % 7 <> 0 then case n % 4 when 0 then 'map' when 1 then 'chat' when 2 then 'other' else 'finance' end else 'other' end as category from asked)
    select key, case when n % 9 = 0 then 'model refused' end as refused, category, case when n % 9 = 0 or n % 7 = 0 or category in ('chat', 'finance') then '' else 'label ' || (n % 5) || '|two' end as labels from kinds"""
)
def screen_outcomes(spark, d):
    from waymark.operators.models import parse_screen

    p = _referenced(spark, d)
    looked = G.screen_selection(p, p.filter(F.col("t") < ASKED_US).select(F.col("photo_id").alias("key")))
    store = f"{shared_folder(spark)}/screens-{uuid.uuid4().hex}"
    G.run(looked, screen_model, store, "v1", wave=700)
    read = parse_screen(F.col("text"), ("map", "chat", "auth", "finance"), ("chat", "auth", "finance"))
    return G.results(spark, store).select("key", "refused", read.alias("r")).select("key", "refused", F.col("r.category").alias("category"), F.array_join("r.labels", "|").alias("labels"))


@query(
    """with base as (select o_orderkey as k, o_orderpriority as v from orders where o_orderkey % 2 = 0),
    up as (select coalesce(b.k, o.o_orderkey) as k, case when o.o_orderkey is not null then 'changed' else b.v end as v from base b full join (select o_orderkey from orders where o_orderkey % 3 = 0) o on o.o_orderkey = b.k),
    absent as (select * from up union all select o_orderkey, 'absent' from orders where o_orderkey % 5 = 0 and o_orderkey not in (select k from up))
    select k, v from absent where k % 7 <> 0"""
)
def catalog_kept(spark, d):
    """A table of the catalog after an upsert over an upsert, an insert of what is absent, and a deletion."""
    from waymark.sources.bindings import table
    from waymark.sources.catalog import Catalog

    o, c = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v")), Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    c.upsert("t", o.filter("k % 2 = 0"), ["k"])
    c.upsert("t", o.filter("k % 3 = 0").withColumn("v", F.lit("changed")), ["k"])
    c.insert_absent("t", o.filter("k % 5 = 0").withColumn("v", F.lit("absent")), ["k"])
    c.delete("t", o.filter("k % 7 = 0"), ["k"])
    return c.read("t")


def _annotated_sql() -> str:
    from waymark.plans import evidence_queries as X

    return f"""with s as ({X.SQL["suggestions"]}), notes as (select 'src ' || (doc_id % 13) as reference, doc_id % 3 as source, doc_id as seq, 'note ' || doc_id as note from documents
      union all select reference, 3 + owner_id % 2, owner_id, 'unseen for ' || days_since || ' days' from ({V.SQL["suggest_revisit"]})),
    firsts as (select reference, source, min_by(note, seq) as note from notes group by all), per as (select reference, string_agg(note, '|' order by note) as notes from firsts group by reference)
    select s.owner_id, s.rank, s.reference, coalesce(notes, '') as notes from s left join per using (reference)"""


@query(_annotated_sql())
def suggestions_annotated(spark, d):
    from waymark.operators.change import annotate
    from waymark.plans.evidence_queries import suggested
    from waymark.sources.bindings import table

    i = F.col("doc_id")
    notes = table(spark, d, "documents").select(F.concat(F.lit("src "), i % 13).alias("reference"), (i % 3).alias("source"), i.alias("seq"), F.concat(F.lit("note "), i).alias("note"))
    revisits = kept(V.suggest_revisit(spark, d), "revisits")
    late = revisits.select("reference", (3 + F.col("owner_id") % 2).alias("source"), F.col("owner_id").alias("seq"), F.concat(F.lit("unseen for "), "days_since", F.lit(" days")).alias("note"))
    got = annotate(suggested(spark, d, revisits), notes.unionByName(late))
    return got.select("owner_id", "rank", "reference", F.coalesce(F.array_join("notes", "|"), F.lit("")).alias("notes"))
