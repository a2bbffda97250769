"""Catalog, globs, dated readings, deletion, model stages, places and ranks on small made-up tables."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions.globs import glob_pattern
from waymark.functions.keys import content_key
from waymark.operators import evidence as E
from waymark.operators import interests as I
from waymark.operators import models as L
from waymark.operators import places as P
from waymark.operators import stewardship as S
from waymark.operators.orders import with_rank
from waymark.sources.catalog import Catalog
from waymark.sources.records import image_files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_takes_the_last_by_order_and_is_fixed_without_one(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "lib"))
    c.replace("t", spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k long, at long, v string"))
    fresh = spark.range(200).select((F.col("id") % 2 + 2).alias("k"), F.col("id").alias("at"), F.concat(F.lit("v"), F.lit(1000) - F.col("id")).alias("v")).repartition(7)
    assert rows(c.upsert("t", fresh, ["k"], ["at"]), "k", "at") == [(1, 0), (2, 198), (3, 199)]
    assert rows(c.upsert("t", fresh.select("k", F.lit(5).cast("long").alias("at"), "v"), ["k"]), "k", "v") == [(1, "a"), (2, "v998"), (3, "v999")]


def test_append_leaves_stored_parts_alone(spark, tmp_path):
    c, root = Catalog(spark, str(tmp_path / "lib")), tmp_path / "lib" / "t"
    one = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    c.insert_absent("t", one, ["k"])
    before = {f: os.stat(f).st_mtime_ns for f in root.glob("v-*/*")}
    c.append("t", spark.createDataFrame([(2, "c")], "k long, v string"))
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    assert rows(c.insert_absent("t", one, ["k"]), "k", "v") == [(1, "a"), (2, "c")]
    assert rows(c.get("t", k=2), "v") == [("c",)] and rows(c.between("t", "k", 1, 1), "k") == [(1,)]
    c.replace("t", one)
    assert c.vacuum("t") == 3 and c.read("t").count() == 2


def test_two_writers_of_one_version_do_not_lose_a_write(spark, tmp_path):
    c, df = Catalog(spark, str(tmp_path / "lib")), spark.range(1)
    c.replace("t", df)
    with pytest.raises(Exception, match="exist"):
        c._point("t", ["elsewhere"], None)


@pytest.mark.parametrize("glob,yes,no", [("trip/*", "trip/b.jpg", "a/trip/b.jpg"), ("*.png", "a/b.png", "a.png.jpg"), ("img?.jpg", "img1.jpg", "img12.jpg"), ("i[0-3]x", "i2x", "i5x"), ("i[!0-3]x", "i5x", "i2x"), ("a[b", "a[b", "ab"), ("a.b", "a.b", "axb")])
def test_globs(spark, glob, yes, no):
    got = spark.createDataFrame([(yes,), (no,)], "p string").select(F.regexp_like("p", F.lit(glob_pattern(glob))).alias("m")).collect()
    assert [r.m for r in got] == [True, False]


def test_image_globs_match_from_the_root_or_by_name(spark, tmp_path):
    for i, name in enumerate(("trip/b.jpg", "a/trip/c.jpg", "a/d.png", "e.jpg")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes([i]))
    got = [r.path.rsplit("/", 1)[1] for r in image_files(spark, str(tmp_path), ["trip/*", "*.png"]).collect()]
    assert sorted(got) == ["c.jpg", "e.jpg"]


def test_a_cited_range_beyond_all_facts_stays_small(spark):
    df = spark.createDataFrame([("x [F1-F999999999] [F2 to F4] [F7]",)], "story string")
    assert df.select(E.cited_facts(F.col("story"), F.lit(3)).alias("f")).first().f == [1, 2, 3, 2, 3, 7]


def test_dating_of_readings(spark):
    photos = spark.createDataFrame([("a", 5_000_000, None), ("b", 3_000_000, False), ("c", 9_000_000, True), ("d", None, True)], "photo_id string, t long, preference boolean")
    captions = spark.createDataFrame([("stay", ["a", "b"]), ("gone", ["x"]), ("none", [])], "key string, photo_ids array<string>")
    singles = spark.createDataFrame([("c", "seen"), ("b", "withheld"), ("a", None), ("d", "no time")], "photo_id string, text string")
    key = {r.photo_id: r.k for r in photos.select("photo_id", content_key(F.array("photo_id")).alias("k")).collect()}
    readings = spark.createDataFrame([("stay", ["x"], None), ("gone", ["x"], None), ("none", ["x"], None), ("unknown", ["x"], None), ("stay", ["y"], "refused"), *((key[p], ["z"], None) for p in "abcd")], "key string, labels array<string>, refused string")
    assert rows(I.dated(readings, captions, singles, photos), "at", "reference") == [(3, "caption:stay"), (9, "photo:c")]


def test_forgetting_reaches_all_that_speaks_about_a_photograph(spark):
    make = spark.createDataFrame
    t = {
        "photos": make([("a",), ("b",)], "photo_id string"), "captions": make([("k", ["a", "b"]), ("m", ["b"])], "key string, photo_ids array<string>"), "subjects": make([("k",), ("m",)], "key string"),
        "singles": make([("a",), ("b",)], "photo_id string"), "screens": make([("a",)], "photo_id string"), "documents": make([("stay:k",), ("stay:m",), ("single:a",), ("screen:a",)], "doc_key string"), "embeddings": make([("stay:k",)], "doc_key string"),
    }
    gone = make([("a",), ("unknown",)], "photo_id string")
    left = S.forget(t, gone)
    assert {n: [tuple(r)[0] for r in df.collect()] for n, df in left.items()} == {"photos": ["b"], "captions": ["m"], "subjects": ["m"], "singles": ["b"], "screens": [], "documents": ["stay:m"], "embeddings": []}
    assert rows(S.forget_counts(t, gone), "what", "gone", "left") == sorted((n, t[n].count() - df.count(), df.count()) for n, df in left.items())
    assert all(r.gone == 0 for r in S.forget_counts(t, gone.filter("photo_id = 'unknown'")).collect())


def test_surplus_profiles_by_time_not_by_number(spark):
    made = [(9, "2024-01-01"), (1, "2024-01-05"), (2, "2024-01-09"), (3, "2024-02-01"), (4, "2023-12-31")]
    df = spark.createDataFrame(made, "seq long, generated_at string").withColumn("generated_at", F.to_date("generated_at"))
    assert rows(S.thinnable(df, 1), "seq") == [(1,), (2,)]
    assert S.thinnable(df, 9).count() == 0 and S.thinnable(df.limit(0), 1).count() == 0


def test_embedding_pauses_and_goes_on(spark, tmp_path):
    docs = spark.range(10).select(F.concat(F.lit("d"), "id").alias("doc_key"), F.col("id").cast("string").alias("text")).coalesce(1)

    def broken(texts):
        if "4" in texts:
            raise L.Unavailable
        return [[float(t)] for t in texts]

    got = L.embed(docs, broken, "m", chunk=2)
    assert rows(got, "doc_key") == [(f"d{i}",) for i in range(4)]
    rest = docs.join(got.select("doc_key"), "doc_key", "left_anti")
    assert rows(L.embed(rest, lambda ts: [[0.0] for _ in ts], "m"), "doc_key") == [(f"d{i}",) for i in range(4, 10)]
    with pytest.raises(Exception, match="refused"):
        L.embed(docs, lambda ts: (_ for _ in ()).throw(ValueError("refused")), "m").collect()


def plain_first_near(lat, lon, radius):
    out, sums = [], []
    for y, x in zip(lat, lon):
        for i, (n, a, b) in enumerate(sums):
            if P.point_metres(a / n, b / n, y, x) <= radius:
                break
        else:
            i = len(sums)
            sums.append((0, 0.0, 0.0))
        n, a, b = sums[i]
        sums[i] = (n + 1, a + y, b + x)
        out.append(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-12, 12), st.integers(-12, 12)), min_size=1, max_size=40), st.sampled_from([0.0, 35.0, 70.0, -88.9]), st.sampled_from([135.0, 179.999, -180.0]))
def test_places_through_cells_equal_a_plain_search(steps, lat, lon):
    y, x = np.array([lat + a * 0.0007 for a, _ in steps]), np.array([lon + b * 0.0007 for _, b in steps])
    assert P.first_near(y, x, 150.0).tolist() == plain_first_near(y.tolist(), x.tolist(), 150.0)


def test_ranks_over_many_parts(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(6)
    want = sorted(((i * 37 % 101, i) for i in range(500)), key=lambda p: (-p[0], p[1]))
    assert rows(with_rank(df, F.desc("v"), F.asc("id")), "rank", "v", "id") == [(k + 1, *p) for k, p in enumerate(want)]
    assert with_rank(df.limit(0), F.asc("id")).count() == 0


def exif_jpeg() -> bytes:
    """A JPEG head with camera metadata, little-endian, written by hand."""
    import struct

    def part(entries, at):
        """Directory at ``at``: entries (tag, type, count, bytes); long values follow it."""
        body, tail, where = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, count, data in entries:
            if len(data) <= 4:
                body += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
            else:
                body += struct.pack("<HHII", tag, kind, count, where + len(tail))
                tail += data
        return body + struct.pack("<I", 0) + tail

    dms = lambda *v: b"".join(struct.pack("<II", a, b) for a, b in v)
    exif = [(0x9003, 2, 20, b"2024:05:03 23:30:00\0"), (0x9011, 2, 7, b"+09:00\0")]
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, dms((35, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, dms((135, 1), (0, 1), (1800, 100)))]
    make = b"Maker\0"
    base = lambda e, g: [(0x010F, 2, len(make), make), (0x8769, 4, 1, struct.pack("<I", e)), (0x8825, 4, 1, struct.pack("<I", g))]
    size = len(part(base(0, 0), 8))
    e_at, g_at = 8 + size, 8 + size + len(part(exif, 8 + size))
    tiff = b"II*\0" + struct.pack("<I", 8) + part(base(e_at, g_at), 8) + part(exif, e_at) + part(gps, g_at)
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\0" * 4 + b"\xff\xda"


def test_camera_metadata_of_files(spark):
    from waymark.sources import images

    files = spark.createDataFrame([("a", exif_jpeg()), ("b", b"not an image"), ("c", None), ("d", exif_jpeg()[:60])], "path string, content binary")
    got = {r.path: r for r in images.taken(images.camera_tags(files), 0).collect()}
    assert (got["a"].lat, round(got["a"].lon, 6), got["a"].camera, got["a"].width, got["a"].height) == (-35.5, 135.005, True, 640, 480)
    assert got["a"].lt - got["a"].t == 9 * 3600 * 1_000_000
    assert all(got[p].t is None and got[p].lat is None for p in "bcd")


def test_thumbnails_never_leave_their_folder(spark, tmp_path):
    from waymark.sources import images

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "t.jpg").write_bytes(b"tiny")
    (tmp_path / "secret").write_bytes(b"no")
    made = [("a", "x/t.jpg"), ("b", "y/../x/./t.jpg"), ("c", "../secret"), ("d", "/etc/passwd"), ("e", "x/none.jpg"), ("f", None), ("g", "x/../../secret"), ("h", "file:///etc/passwd")]
    rows = {r.photo_id: (None if r.content is None else bytes(r.content), r.refused) for r in images.thumbnails(spark, spark.createDataFrame(made, "photo_id string, thumbnail string"), str(tmp_path / "in")).collect()}
    assert rows["a"] == rows["b"] == (b"tiny", None)
    assert {k: v[1] for k, v in rows.items() if k in "cdgh"} == dict.fromkeys("cdgh", "no thumbnail: outside the folder")
    assert rows["e"][1] == "no thumbnail: not found" and rows["f"][1] == "no thumbnail: none given"


def test_payloads(spark):
    import json

    from waymark.operators import payloads

    profile = spark.createDataFrame([(2, "tea", 0.5, 0.25, 0, 86400, ["photo:a"]), (1, "place:35.12345,135.98765", 0.75, 0.5, 0, 0, ["place:35.12345,135.98765"])], "rank long, topic string, score double, confidence double, first_at long, last_at long, evidence array<string>")
    got = json.loads(payloads.profile_payload(profile, "2024-01-01", blur=True).first().payload)
    assert [i["topic"] for i in got["interests"]] == ["place:35.12,135.99", "tea"] and got["interests"][0]["evidence"] == [{"kind": "journey", "reference": "place:35.12,135.99"}]
    assert json.loads(payloads.profile_payload(profile.limit(0), "x").first().payload)["interests"] == []
    trend = spark.createDataFrame([(1, "tea", "new", 0.5, 0.0)], "rank long, topic string, direction string, strength double, baseline double")
    assert json.loads(payloads.trend_payload(trend, "a", "b").first().payload)["trends"] == [{"topic": "tea", "direction": "new", "strength": 0.5, "baseline": 0.0}]


def test_ingest_writes_both_outputs(spark, tmp_path):
    from tests.test_sources import record
    from waymark.sources import records

    df = spark.read.schema(records.RECORD).json(spark.sparkContext.parallelize([__import__("json").dumps(r) for r in (record(), record(id="x"))]))
    records.ingest(df, str(tmp_path / "ok"), str(tmp_path / "skipped"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1
    assert [list(r.defects) for r in spark.read.json(str(tmp_path / "skipped")).collect()] == [["identifier"]]


def test_unsound_interests_and_demo_profiles(spark):
    from waymark.sources import records

    rows = [("a", 0.5, 0.5, 0, 1, ["x"]), ("", 2.0, None, 2, 1, []), ("c", 0.5, 0.5, 0, 0, None)]
    df = spark.createDataFrame(rows, "topic string, score double, confidence double, first_at long, last_at long, evidence array<string>")
    assert sorted(list(r.defects) for r in I.unsound(df).collect()) == [["evidence"], ["topic", "score", "confidence", "evidence", "span"]]
    readings = records.demo_readings(records.demo_library(spark, 1_700_000_000_000_000))
    got = records.demo_profiles(readings)
    assert got.filter("topic = 'kitchen'").count() >= 4 and got.filter("score <= 0 or score >= 1").count() == 0
