"""Image files: camera metadata out of JPEG bytes, and thumbnails by their references."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import exif
from waymark.sources.shipping import ship

# Tags of the public EXIF and TIFF formats, and the bytes of a value of each type.
MAKE, MODEL, EXIF_PART, GPS_PART, TAKEN, OFFSET = 0x010F, 0x0110, 0x8769, 0x8825, 0x9003, 0x9011
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
VALUE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TAGS = "make string, model string, taken string, zone string, lat string, lat_ref string, lon string, lon_ref string, width int, height int"


def _entries(tiff: bytes, order: str, at: int) -> dict[int, str | int]:
    """Tags of one directory: texts, numbers, and rationals as ``a/b,c/d``."""
    out: dict[int, str | int] = {}
    (many,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(many):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
        size = VALUE_BYTES.get(kind, 0) * count
        if not size or size > len(tiff):
            continue
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * i)[0]
        data = tiff[where : where + size]
        if kind == 2:
            out[tag] = data.decode("utf-8", "replace").strip().strip("\0").strip()
        elif kind in (5, 10):
            parts = struct.unpack_from(order + ("I" if kind == 5 else "i") * 2 * count, data)
            out[tag] = ",".join(f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2]))
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data)[0]
    return out


def read_tags(data: bytes | None) -> tuple:
    """The values of ``TAGS`` of a JPEG file; null for what is missing or damaged, and for other files."""
    tags: dict[int, str | int] = {}
    gps: dict[int, str | int] = {}
    width = height = None
    at = 2
    try:
        while data and data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if marker == 0xE1 and body[:6] == b"Exif\0\0":
                tiff = body[6:]
                order = "<" if tiff[:2] == b"II" else ">"
                tags = _entries(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
                gps, detail = (_entries(tiff, order, tags[p]) if isinstance(tags.get(p), int) else {} for p in (GPS_PART, EXIF_PART))
                tags |= detail
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", body, 1)
            at += 2 + size
    except (struct.error, IndexError, ValueError):  # damaged files give what was read before the damage
        pass
    text = lambda part, tag: part.get(tag) or None if isinstance(part.get(tag), str) else None
    return (*(text(tags, t) for t in (MAKE, MODEL, TAKEN, OFFSET)), *(text(gps, t) for t in (LAT, LAT_REF, LON, LON_REF)), width, height)


def camera_tags(files: DataFrame) -> DataFrame:
    """Files (path, content) with ``TAGS`` in place of the content."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in TAGS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *read_tags(c)) for p, c in zip(f["path"], f["content"])]
            made = pd.DataFrame(rows, columns=["path", *names])
            yield made.astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, " + TAGS)


def taken(tagged: DataFrame, fallback_seconds: int) -> DataFrame:
    """Tagged files with t, lt, lat and lon; a camera without an offset is taken to be at the fallback."""
    at = exif.captured_at(F.col("taken"), F.col("zone"), F.lit(fallback_seconds))
    where = exif.location(F.col("lat"), F.col("lat_ref"), F.col("lon"), F.col("lon_ref"))
    camera = F.coalesce(F.col("make"), F.col("model")).isNotNull()
    return tagged.select("path", at["t"].alias("t"), at["lt"].alias("lt"), where["lat"].alias("lat"), where["lon"].alias("lon"), camera.alias("camera"), "width", "height")


def inner_path(reference: Column) -> Column:
    """A relative reference with ``.`` and ``..`` resolved; null for absolute ones and for those that leave their folder."""
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, part: Column) -> Column:
        up = part == ".."
        parts = F.when(part.isin("", "."), s["parts"]).when(up, F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0)))).otherwise(F.concat(s["parts"], F.array(part)))
        return F.struct((s["ok"] & ~(up & (F.size(s["parts"]) == 0))).alias("ok"), parts.alias("parts"))

    done = F.aggregate(F.split(reference, "/"), start, step)
    return F.when(~reference.startswith("/") & ~reference.contains("://") & done["ok"] & (F.size(done["parts"]) > 0), F.array_join(done["parts"], "/"))


def thumbnails(spark: SparkSession, photos: DataFrame, root: str) -> DataFrame:
    """Photographs (photo_id, thumbnail) with ``content``, or with ``refused``: a reference that leaves the folder is never opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring("path", len(base) + 2, 2**31 - 1).alias("inner"), "content")
    rows = photos.withColumn("inner", inner_path(F.col("thumbnail"))).join(files, "inner", "left")
    why = F.when(F.col("thumbnail").isNull(), "no thumbnail: none given").when(F.col("inner").isNull(), "no thumbnail: outside the folder").when(F.col("content").isNull(), "no thumbnail: not found")
    return rows.select("photo_id", "content", why.alias("refused"))
