"""Producers' files, the catalog, model stages and the stream."""

import json

from pyspark.sql import functions as F

from waymark.operators import models, stewardship
from waymark.operators.journeys import numbered_stops, outings, stays
from waymark.sources import records
from waymark.sources.catalog import Catalog
from waymark.streaming import bronze

GOOD = "sha256:" + "a" * 64


def record(**more):
    return {"id": GOOD, "captured_at": "2025-05-03T23:30:00+09:00", "location": {"lat": 35.0, "lon": 135.0}, "kind": None, "thumbnail": "t.jpg", "consent": {"use_for_story": True, "use_for_preferences": None}} | more


def test_photo_records(spark, tmp_path):
    rows = [record(), record(id="x", captured_at="2025-05-03 23:30"), record(), record(id="sha256:" + "b" * 64, location={"lat": 95.0, "lon": 1.0}), record(id="sha256:" + "c" * 64, consent={"use_for_story": False})]
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1", "owner": "o", "records": rows}), encoding="utf-8-sig")
    df = records.photo_records(spark, str(tmp_path / "a.json"))
    got = records.observations(df).filter(F.col("photo_id") == GOOD).first()
    assert got.lt - got.t == 9 * 3600 * 1_000_000 and got.lat == 35.0
    assert records.observations(df).count() == 4
    bad = sorted(tuple(r.defects) for r in records.defects(df).collect())
    assert bad == [(), (), ("identifier", "timestamp"), ("location",), ("repeated identifier",)]


def test_daily_activity(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"day": "2025-01-01", "steps": 10, "more": 1}, {"day": "2025-01-02", "steps": 200001}, {"day": "nope", "steps": 1}, {"day": "2025-01-03", "steps": 0, "distance_m": -1}]))
    assert [str(r.day) for r in records.daily_activity(spark, str(tmp_path / "d.json")).collect()] == ["2025-01-01"]


def test_gazetteer(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1\tŌsaka\tOsaka\t\t34.7\t135.5\t\t\tJP\n2\tKōbe\t \t\t34.69\t135.19\t\t\tJP\nshort\trow\n3\tX\tX\t\tbad\t1\t\t\tJP\n")
    assert sorted(r.label for r in records.gazetteer(spark, str(tmp_path / "g.tsv")).collect()) == ["Kōbe", "Osaka"]


def test_image_files(spark, tmp_path):
    for name, data in (("a.jpg", b"1"), ("b.PNG", b"2"), ("c.jpg", b"1"), ("e.HEIF", b"5"), ("d.txt", b"3"), ("skip.jpg", b"4")):
        (tmp_path / name).write_bytes(data)
    got = sorted(r.path.rsplit("/", 1)[1] for r in records.image_files(spark, str(tmp_path), ["skip*"]).collect())
    assert got == ["a.jpg", "b.PNG", "e.HEIF"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "lib"))
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    assert not c.exists("t")
    c.upsert("t", make((1, "a"), (2, "b")), ["k"])
    c.upsert("t", make((2, "c"), (3, "d")), ["k"])
    c.insert_absent("t", make((3, "x"), (4, "e")), ["k"])
    c.delete("t", make((1, "")), ["k"])
    assert sorted(tuple(r) for r in c.append("t", make((9, "z"))).collect()) == [(2, "c"), (3, "d"), (4, "e"), (9, "z")]


def test_models(spark):
    photos = spark.createDataFrame([("s", f"p{i}", i) for i in range(7)] + [("u", "q", 0)], "stop string, photo_id string, t long")
    assert sorted(r.photo_id for r in models.representatives(photos, 3).collect()) == ["p0", "p3", "p6", "q"]
    answers = models.ask_model(photos, lambda xs: [(None, "no") if x == "q" else (x.upper(), None) for x in xs], "photo_id", "photo_id", "v1")
    got = {r.key: (r.text, r.refused) for r in answers.collect()}
    assert got["p1"] == ("P1", None) and got["q"] == (None, "no")
    df = spark.createDataFrame([('x ["A", " b", "a"] y', '{"category": "Chat", "labels": ["z"]}'), ("none", '{"category": "odd", "labels": ["Z"]}')], "a string, s string")
    rows = df.select(models.parse_labels(F.col("a")).alias("l"), models.parse_screen(F.col("s"), ("chat", "map"), ("chat",)).alias("c")).collect()
    assert rows[0].l == ["a", "b"] and rows[0].c.category == "chat" and rows[0].c.labels == [] and rows[1].c.category == "other" and rows[1].c.labels == ["z"]
    labels = spark.createDataFrame([(1, "a", [1.0, 0.0], ["s1", "s2"]), (1, "b", [0.95, 0.2], ["s1"]), (1, "c", [0.0, 1.0], ["s9"])], "owner_id long, label string, vector array<double>, stays array<string>")
    assert sorted(r.label for r in models.cluster_labels(labels).collect()) == ["a", "b"]


def test_latest_rows_and_kinds(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, o long, v string")
    assert sorted(r.v for r in stewardship.latest_rows(df, ["k"], ["o"]).collect()) == ["b", "c"]


def test_stream_equals_rebuild(spark, tmp_path):
    demo = records.demo_library(spark, 1_700_000_000_000_000).cache()
    parts, source = demo.randomSplit([0.5, 0.5], 3), str(tmp_path / "in")
    c = Catalog(spark, str(tmp_path / "lib"))
    for part in parts:
        part.write.mode("append").parquet(source)
        bronze.keep_journeys(bronze.photo_stream(spark, source), c, str(tmp_path / "cp")).awaitTermination()
    cols = ["outing_id", "t0", "t1", "n_stops", "n_photos"]
    want = outings(numbered_stops(stays(demo))).select(*cols)
    assert sorted(map(tuple, c.read("outings").select(*cols).collect())) == sorted(map(tuple, want.collect())) != []


def jpeg(tiff: bytes) -> bytes:
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xc0\0\x0b\x08\0\x10\0\x20\x01\x01\x11\0\xff\xda"


def directory(*entries: tuple[int, int, int, bytes], at: int = 8) -> bytes:
    """One little-endian directory; values of more than four bytes follow it."""
    import struct

    head, rest = struct.pack("<H", len(entries)), b""
    end = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, data in entries:
        value = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", end + len(rest))
        rest += data if len(data) > 4 else b""
        head += struct.pack("<HHI", tag, kind, count) + value
    return head + b"\0\0\0\0" + rest


def test_damaged_images_stop_nothing():
    import random

    from waymark.sources.images import read_tags

    whole = jpeg(b"II*\0\x08\0\0\0" + directory((0x010F, 2, 6, b"Maker\0"), (0x8825, 2, 8, b"nowhere\0"), (0x8769, 5, 1, b"\1\0\0\0\2\0\0\0")))
    assert read_tags(whole)[0] == "Maker" and read_tags(whole)[-2:] == (32, 16)
    rng = random.Random(3)
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(2, len(data))] = rng.randrange(256)
        assert len(read_tags(bytes(data[: rng.randint(0, len(data))]))) == 10
    assert read_tags(None) == (None,) * 10 == read_tags(b"")


def test_the_package_reaches_workers_of_a_driver_started_elsewhere(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from waymark.sources.bindings import photos
from waymark.operators import journeys, places
s = journeys.stays(photos(spark, "/root/testdata/sf0.001"))
print("rows", places.placed(s, 150.0).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0
