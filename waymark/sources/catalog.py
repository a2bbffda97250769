"""Tables of a library as Parquet folders: versions with a pointer, so that a write is seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets of tables that are replaced in part.
BUCKETS = 64


class Catalog:
    """``root/name/v-*`` holds written parts; ``root/name/current/NUMBER`` lists the parts of a version, the highest number counts.

    A pointer is created only where none is, so of two writers that begin from one version the slower gets an error and no
    write is lost. Old parts stay for readers that still use them; ``vacuum`` removes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self, name: str) -> tuple[int, list[str]] | None:
        folder, fs = self._at(f"{self.root}/{name}/current")
        if not fs.exists(folder):
            return None
        for number in sorted((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), reverse=True):
            stream = fs.open(self._at(f"{self.root}/{name}/current/{number:012d}")[0])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("]"):  # a pointer cut short is none
                return number, json.loads(text)
        return None

    def _point(self, name: str, parts: list[str], after: int | None) -> None:
        at, fs = self._at(f"{self.root}/{name}/current/{0 if after is None else after + 1:012d}")
        stream = fs.create(at, False)
        stream.write(json.dumps(parts).encode())
        stream.close()

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def exists(self, name: str) -> bool:
        return self._version(name) is not None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*self._version(name)[1])

    def get(self, name: str, **keys) -> DataFrame:
        """The rows with these key values; the filter reaches the scan."""
        rows = self.read(name)
        for column, value in keys.items():
            rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def between(self, name: str, column: str, first, last) -> DataFrame:
        """The rows from ``first`` to ``last``, both included."""
        return self.read(name).filter(F.col(column).between(first, last))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version, then point to it."""
        now = self._version(name)
        self._point(name, [self._write(name, df)], now and now[0])
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add a part; what is stored stays where it is."""
        now = self._version(name)
        self._point(name, [*(now[1] if now else []), self._write(name, df)], now and now[0])
        return self.read(name)

    def upsert(self, name: str, df: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
        """The rows of ``df`` take the place of stored rows with their keys.

        Of several rows of ``df`` with one key the last by ``order`` counts; among equals, and without an order, the greatest by
        all columns, so the result never depends on how rows are dealt out.
        """
        rows = df.withColumn("_order", F.struct(F.lit(1).alias("new"), *(order or []), *df.columns))
        fresh = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "_order").alias("_row")).select("_row.*")
        if not self.exists(name):
            return self.replace(name, fresh)
        return self.replace(name, self.read(name).join(df.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True))

    def insert_absent(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """Adds the rows whose keys are not stored yet, one a key."""
        one = df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("_row")).select("_row.*")
        return self.append(name, one.join(self.read(name).select(*keys), keys, "left_anti")) if self.exists(name) else self.replace(name, one)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> DataFrame:
        return self.replace(name, self.read(name).join(gone.select(*keys), keys, "left_anti"))

    def replace_buckets(self, name: str, df: DataFrame, column: str, touched: list[int]) -> None:
        """Put ``df`` in the place of all rows of the touched buckets of ``column``; parts of other buckets stay as they are."""
        path, now = f"{self.root}/{name}/v-{uuid.uuid4().hex}", self._version(name)
        df.withColumn("_bucket", self.bucket(F.col(column))).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        folder, fs = self._at(path)
        fresh = [f"{path}/{f.getPath().getName()}" for f in fs.listStatus(folder) if f.getPath().getName().startswith("_bucket=")]
        self._point(name, [p for p in (now[1] if now else []) if int(p.rsplit("=", 1)[1]) not in touched] + fresh, now and now[0])

    def read_buckets(self, name: str, touched: list[int]) -> DataFrame | None:
        """The rows of these buckets; none if there are no parts."""
        now = self._version(name)
        parts = [p for p in now[1] if int(p.rsplit("=", 1)[1]) in touched] if now else []
        return self.spark.read.option("mergeSchema", True).parquet(*parts) if parts else None

    @staticmethod
    def bucket(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")

    def vacuum(self, name: str) -> int:
        """Remove parts that the current version does not list; their number."""
        folder, fs = self._at(f"{self.root}/{name}")
        listed = {p[len(f"{self.root}/{name}/") :].split("/")[0] for p in self._version(name)[1]}
        old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in listed]
        for path in old:
            fs.delete(path, True)
        return len(old)
