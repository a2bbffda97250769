"""Logical tables of the engine, bound to the star-schema test tables; each with the same derivation as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Centres (cell, latitude, longitude); cell 5 lies more than 50 km away from the rest.
CELLS = ((0, 35.0000000371, 135.0000000371), (1, 35.1000000371, 135.0000000371), (2, 35.0000000371, 135.1500000371), (3, 35.3000000371, 135.0500000371), (4, 34.6500000371, 135.2000000371), (5, 36.2000000371, 136.0000000371))
#: Hours of offset by owner: wall clock against instant.
OFFSETS = (0, 9, -5, 1)
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, owner_id, t (instant, microseconds), lt (wall clock, microseconds), lat, lon, kind, preference, k."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("owner_id"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    t = F.unix_micros("ts")
    away = F.pmod(F.floor(t / DAY_US) + F.col("owner_id"), F.lit(7)) >= 5
    e = e.withColumn("cell", F.when(away, 5).otherwise(F.pmod(F.floor(t / (3 * HOUR_US)) * 7 + F.col("owner_id"), F.lit(5))).cast("int"))
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in CELLS)), F.col("cell") + 1)
    day = F.hour("ts") >= 9
    return e.select(
        F.concat(F.lit("photo-"), F.col("event_id")).alias("photo_id"),
        "owner_id",
        t.alias("t"),
        (t + F.element_at(F.array(*(F.lit(o) for o in OFFSETS)), (F.col("owner_id") + 1).cast("int")).cast("long") * HOUR_US).alias("lt"),
        F.when(day, pick(1) + (F.col("k") - 50) * 1e-6).alias("lat"),
        F.when(day, pick(2) + (F.pmod(F.col("k") * 7, F.lit(100)) - 50) * 1e-6).alias("lon"),
        F.when(F.col("event_type") == "error", "screenshot").when(F.col("event_type") != "view", "photo").alias("kind"),
        F.when(F.col("event_type") == "signup", False).when(F.col("event_type") == "click", True).alias("preference"),
        "k",
        "event_id",
    )


PHOTOS_SQL = f"""
cells(cell, clat, clon) as (values {", ".join(f"({c}, {a}::double, {b}::double)" for c, a, b in CELLS)}),
photos as (
  select 'photo-' || event_id as photo_id, e.user_id % 4 as owner_id, epoch_us(ts) as t,
         epoch_us(ts) + cast({list(OFFSETS)}[e.user_id % 4 + 1] as bigint) * {HOUR_US} as lt,
         case when hour(ts) >= 9 then clat + (k - 50) * 1e-6::double end as lat,
         case when hour(ts) >= 9 then clon + ((k * 7) % 100 - 50) * 1e-6::double end as lon,
         case when event_type = 'error' then 'screenshot' when event_type <> 'view' then 'photo' end as kind,
         case when event_type = 'signup' then false when event_type = 'click' then true end as preference, k, e.cell, event_id
  from (select *, cast(json_extract_string(props, '$.k') as int) as k,
               case when (epoch_us(ts) // {DAY_US} + user_id % 4) % 7 >= 5 then 5
                    else ((epoch_us(ts) // {3 * HOUR_US}) * 7 + user_id % 4) % 5 end as cell from events) e
  join cells on cells.cell = e.cell
)"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: key, photo_id, labels, observed (day of the photograph, microseconds)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("key"),
        F.array(F.concat(F.lit("src_"), F.pmod("doc_id", F.lit(13))), F.concat(F.lit(" "), F.col("lang")), F.when(F.col("doc_id") % 5 == 0, F.lit("image")).otherwise(F.concat(F.lit("tag"), F.col("doc_id") % 7))).alias("labels"),
        (F.lit(1704067200) + (F.col("doc_id") * 7919) % 8_000_000).alias("at"),
    )


SUBJECTS_SQL = """
subjects as (
  select doc_id as key, ['src_' || (doc_id % 13), ' ' || lang, case when doc_id % 5 = 0 then 'image' else 'tag' || (doc_id % 7) end] as labels,
         1704067200 + (doc_id * 7919) % 8000000 as seen_at from documents
)"""

# Themes of the fixture, in order; a later theme wins a shared member.
THEMES = (("errands", ("src 1", "src 2", "src 3")), ("outdoors", ("src 3", "src 4", "nothing")), ("lonely", ("src 5",)), ("tag1", ("tag2", "tag3")))


def themes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, m) for i, (name, members) in enumerate(THEMES) for m in members], "pos int, theme string, member string")


THEMES_SQL = f"themes(pos, theme, member) as (values {', '.join(f"({i}, '{n}', '{m}')" for i, (n, ms) in enumerate(THEMES) for m in ms)})"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept profiles: seq, generated_at (date), topic, score, confidence, refs."""
    p = photos(spark, sf_dir).select("photo_id", "t", "k")
    cut = F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(d).alias("day")) for i, d in enumerate((8, 15, 22, 30)))))
    rows = p.withColumn("c", cut).select("photo_id", "k", F.col("c.seq").alias("seq"), F.col("c.day").alias("day"), (F.floor((F.col("t") - 1704067200 * 1_000_000) / DAY_US)).alias("d"))
    rows = rows.filter((F.col("d") < F.col("day")) & (F.col("d") >= F.col("day") - 8) & (F.pmod(F.col("k") % 12 + F.col("seq") * F.col("seq") * 2, F.lit(5)) < 3))
    rows = rows.withColumn("topic", F.concat(F.lit("src "), F.col("k") % 12))
    first = F.row_number().over(Window.partitionBy("seq", "topic").orderBy("photo_id"))
    some = rows.withColumn("nth", first).filter("nth <= 9").groupBy("seq", "topic").agg(F.sort_array(F.collect_list("photo_id")).alias("refs"))
    g = rows.groupBy("seq", "day", "topic").agg(F.count("*").alias("n")).join(some, ["seq", "topic"])
    share = F.lit(0.2) + F.pmod(F.regexp_extract("topic", r"\d+", 0).cast("int") * 5 + F.col("seq") * 3, F.lit(7)) / 10.0
    return g.select("seq", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")).alias("generated_at"), "topic", (F.col("n") / (F.col("n") + 2)).alias("score"), share.alias("confidence"), "refs")


HISTORY_SQL = (
    PHOTOS_SQL
    + f""",
cuts(seq, day) as (values (0, 8), (1, 15), (2, 22), (3, 30)),
history as (
  select seq, date '2024-01-01' + day::int as generated_at, 'src ' || (k % 12) as topic, count(*) / (count(*) + 2.0::double) as score,
         0.2::double + ((any_value(k) % 12) * 5 + seq * 3) % 7 / 10.0::double as confidence, list_slice(list_sort(list(distinct photo_id)), 1, 9) as refs
  from (select *, (t - 1704067200000000) // {DAY_US} as d from photos), cuts
  where d < day and d >= day - 8 and (k % 12 + seq * seq * 2) % 5 < 3 group by seq, day, k % 12
)"""
)


# A second library, over the years of the orders: each order is an arrival of one of seven owners. Half go home, a third to a few
# regular places (each open from some year on), the rest to places that hardly anyone sees again; every third order goes on elsewhere.
YEARS_OWNERS, YEARS_REGULAR, YEARS_FIRST = 7, 20, 1995
#: The day that years are looked back from, and the ends of the kept profiles.
YEARS_TODAY = 1_014_940_800 * 1_000_000  # 2002-03-01
YEARS_CUTS = ("1996-01-01", "1998-01-01", "2000-01-01", "2001-01-01", "2001-09-01")


def _site(k, custkey, year, second: bool):
    home, regular = custkey % YEARS_OWNERS, YEARS_OWNERS + F.floor(k / 10) % YEARS_REGULAR
    regular = F.when(year < YEARS_FIRST + regular % 7, home).otherwise(regular)
    if second:
        return F.when(k % 10 < 5, regular).otherwise(home)
    return F.when(k % 10 < 5, home).when(k % 10 < 8, regular).otherwise(YEARS_OWNERS + YEARS_REGULAR + F.floor(k / 37))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs like ``photos``: three of each arrival, six minutes apart."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("timestamp").alias("at"))
    k, c, year = F.col("k"), F.col("c"), F.year("at")
    stop = F.explode(F.array(F.struct(_site(k, c, year, False).alias("site"), F.lit(0).alias("hours")), F.when(k % 3 == 0, F.struct(_site(k, c, year, True).alias("site"), F.lit(3).alias("hours")))))
    rows = o.withColumn("s", stop).filter("s is not null").withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    t = F.unix_micros("at") + (6 + F.floor(c / YEARS_OWNERS) % 4 * 3 + F.col("s.hours")) * HOUR_US + F.col("i") * 360_000_000
    site = F.col("s.site")
    rows = rows.select(F.concat_ws("-", F.lit("year"), k, F.col("s.hours"), "i").alias("photo_id"), (c % YEARS_OWNERS).alias("owner_id"), t.alias("t"), site.alias("site"), k.alias("k"))
    lat, lon = F.lit(35.0000000371) + 0.021 * (F.col("site") % 50), F.lit(135.0000000371) + 0.026 * F.floor(F.col("site") / 50)
    return rows.select("photo_id", "owner_id", "t", F.col("t").alias("lt"), lat.alias("lat"), lon.alias("lon"), F.lit("photo").alias("kind"), F.lit(None).cast("boolean").alias("preference"), "k")


_REGULAR = f"case when year(day) < {YEARS_FIRST} + ({YEARS_OWNERS} + k // 10 % {YEARS_REGULAR}) % 7 then c % {YEARS_OWNERS} else {YEARS_OWNERS} + k // 10 % {YEARS_REGULAR} end"
YEARS_SQL = f"""
arrivals as (select o_orderkey as k, o_custkey as c, o_orderdate as day from orders),
sited as (
  select *, 0 as hours, case when k % 10 < 5 then c % {YEARS_OWNERS} when k % 10 < 8 then {_REGULAR} else {YEARS_OWNERS + YEARS_REGULAR} + k // 37 end as cell from arrivals
  union all select *, 3, case when k % 10 < 5 then {_REGULAR} else c % {YEARS_OWNERS} end from arrivals where k % 3 = 0),
photos as (
  select concat_ws('-', 'year', k, hours, i) as photo_id, c % {YEARS_OWNERS} as owner_id, epoch_us(day) + (6 + c // {YEARS_OWNERS} % 4 * 3 + hours) * {HOUR_US} + i * 360000000 as t,
    epoch_us(day) + (6 + c // {YEARS_OWNERS} % 4 * 3 + hours) * {HOUR_US} + i * 360000000 as lt, 35.0000000371::double + 0.021::double * (cell % 50) as lat, 135.0000000371::double + 0.026::double * (cell // 50) as lon,
    'photo' as kind, null::boolean as preference, k, cell from sited, (select unnest([0, 1, 2]) as i))"""
