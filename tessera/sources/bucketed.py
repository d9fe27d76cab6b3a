"""A stored table in hash buckets of its key, changed by merges.

Rows are dealt to ``buckets`` by a hash of the key. A version of the table is a
manifest, a small JSON file that names the folder of each bucket. A merge reads and
rewrites only the buckets that its rows fall into; the others keep their files. It
ends by renaming its manifest into place, which fails if another merge made the same
version meanwhile, so a version is there whole or not at all, and readers of an older
one are not disturbed. What a failed merge wrote is in no manifest.

The driver handles bucket numbers and paths alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class Conflict(RuntimeError):
    """Another merge committed first; merge again."""


@dataclass
class BucketTable:
    spark: SparkSession
    path: str

    # --- files

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        """Write a file under another name and rename it; it must not be there yet."""
        temporary, fs = self._file(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._file(path)
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise Conflict(path)

    def versions(self) -> list[int]:
        p, fs = self._file(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        p, fs = self._file(f"{self.path}/versions/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # --- reading

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64, order: Column | None = None) -> "BucketTable":
        """A table of the rows, one of each key: the last by ``order``, else by content. Null keys are keys too."""
        table = cls(rows.sparkSession, path)
        table._put(f"{path}/versions/0.json", json.dumps({"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": {}}))
        table.upsert(rows, order)
        return table

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; of some buckets only, if they are named."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets."""
        m = self.manifest()
        return self.read(buckets=self._buckets(keys, m)).join(keys.select(m["key"]).distinct(), m["key"], "left_semi")

    @staticmethod
    def bucket(key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def _buckets(self, rows: DataFrame, m: dict) -> list[int]:
        return sorted(r["b"] for r in rows.select(self.bucket(m["key"], m["buckets"]).alias("b")).distinct().collect())  # at most ``buckets`` numbers

    # --- changing

    def _merge(self, new: DataFrame, columns: dict[str, Column] | None, order: Column | None = None) -> int:
        """Rewrite the buckets of ``new``, of which one row of each key counts; the new version's number.

        ``columns``: what becomes of the table's columns, from the structs ``_old`` and
        ``_new``, of which one may be null; None: rows with a new side go.
        """
        version = self.versions()[-1]
        m = self.manifest(version)
        key, schema = m["key"], T.StructType.fromJson(m["schema"])
        one = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*new.columns), order if order is not None else F.to_json(F.struct(*new.columns))).alias("_new"))
        touched = self._buckets(one.withColumnRenamed("_key", key), m)
        old = self.read(version, touched).select(F.col(key).alias("_old_key"), F.struct(*schema.names).alias("_old"))
        met = old.join(one, F.col("_old_key").eqNullSafe(F.col("_key")), "full")
        if columns is None:
            rows = met.where(F.col("_new").isNull()).select("_old.*")
        else:
            rows = met.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema])
        folder = f"data/{version + 1}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket(key, m["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        p, fs = self._file(f"{self.path}/{folder}")
        written = sorted(int(x.split("=")[1]) for x in (s.getPath().getName() for s in fs.listStatus(p)) if x.startswith("_bucket="))
        folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in written}
        self._put(f"{self.path}/versions/{version + 1}.json", json.dumps(m | {"folders": folders}))
        return version + 1

    def upsert(self, new: DataFrame, order: Column | None = None) -> int:
        """New rows in place of old ones of the same key; nothing is deleted. Columns that ``new`` hasn't become null."""
        names = T.StructType.fromJson(self.manifest()["schema"]).names
        value = lambda c: F.col(f"_new.`{c}`") if c in new.columns else F.lit(None)
        return self._merge(new, {c: F.when(F.col("_new").isNotNull(), value(c)).otherwise(F.col(f"_old.`{c}`")) for c in names}, order)

    def merge_owned(self, own: DataFrame, owned: list[str], order: Column | None = None) -> int:
        """Update only the owned columns of rows that are there, append rows that aren't, delete none."""
        m = self.manifest()
        names, key = T.StructType.fromJson(m["schema"]).names, m["key"]
        there = {c: F.col(f"_new.`{c}`") if c in own.columns else F.lit(None) for c in names}
        return self._merge(own, {c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c not in owned)), F.col(f"_old.`{c}`")).otherwise(there[c]) if c != key else F.when(F.col("_old").isNotNull(), F.col(f"_old.`{c}`")).otherwise(there[c]) for c in names}, order)

    def delete(self, keys: DataFrame) -> int:
        """Take rows away by their keys."""
        return self._merge(keys.select(self.manifest()["key"]), None)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all versions but the last ``keep``, and folders that none of those names."""
        versions = self.versions()
        for v in versions[:-keep]:
            p, fs = self._file(f"{self.path}/versions/{v}.json")
            fs.delete(p, False)
        used = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        p, fs = self._file(f"{self.path}/data")
        for merge in fs.listStatus(p):
            for bucket in fs.listStatus(merge.getPath()):
                name = f"data/{merge.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in used:
                    fs.delete(bucket.getPath(), True)
            if not any(f.startswith(f"data/{merge.getPath().getName()}/") for f in used):
                fs.delete(merge.getPath(), True)
