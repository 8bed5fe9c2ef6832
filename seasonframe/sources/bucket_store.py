"""Keyed tables in hash buckets: a batch reads and rewrites the buckets it touches, and one manifest commits it.

Data lies in <path>/data/<table>/v=<batch>/_bucket=<n>, and <path>/manifest/v=<batch> names the version of every bucket
of every table. A manifest counts when Spark has finished writing it, so readers see a batch whole or not at
all. A batch that is tried again starts from the manifest before it and overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import assert_unique, last_by

BUCKETS = 64

# Manifests that readers may still be using.
KEEP = 8

Entries = dict[tuple[str, int], int]


class BucketStore:
    """Tables of one store, all bucketed by the same key columns, so that rows of one key lie in buckets of one number.

    `buckets` is fixed with the first batch: choose it so that a bucket is some hundred MB at the size to come.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, T.StructType], keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schemas, self.keys, self.buckets = spark, path.rstrip("/"), dict(schemas), keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, *parts: str) -> tuple[object, object]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list[str]:
        folder, files = self._folder(*parts)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def batches(self) -> list[int]:
        """Committed batches, oldest first, from folder names."""
        found = [int(n[2:]) for n in self._listed("manifest") if n.startswith("v=")]
        return sorted(b for b in found if "_SUCCESS" in self._listed("manifest", _version(b)))

    def manifest(self, batch: int) -> Entries:
        """Version of every (table, bucket) with rows: as many entries as there are buckets of tables."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{_version(batch)}").collect()
        return {(r["table"], r["bucket"]): r["version"] for r in rows}

    def newest(self, before: int | None = None) -> Entries:
        usable = [b for b in self.batches() if before is None or b < before]
        return self.manifest(usable[-1]) if usable else {}

    def read(self, table: str, entries: Entries | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table as a manifest has it (the newest by default), whole or some of its buckets: no other file is read."""
        entries = self.newest() if entries is None else entries
        paths = [f"{self.path}/data/{t}/{_version(v)}/_bucket={b}" for (t, b), v in sorted(entries.items())
                 if t == table and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, from their buckets alone."""
        wanted = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self.read(table, buckets=wanted).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def commit(self, batch: int, touched: DataFrame, change: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]]) -> set[int]:
        """Replace the buckets of the keys in `touched` by what `change` makes of their tables; returns their numbers.

        `change` gets each table cut to these buckets and returns their new content; rows of other buckets in it are
        an error, since they would be lost or doubled. A bucket without rows leaves the manifest.
        """
        numbers = {r[0] for r in touched.select(self.bucket()).distinct().collect()}
        entries = self.newest(before=batch)
        after = change({t: self.read(t, entries, numbers) for t in self.schemas})
        kept = {k: v for k, v in entries.items() if k[1] not in numbers}
        inside = F.lit(sorted(numbers)) if numbers else F.array().cast("array<int>")
        for name, df in after.items():
            rows = df.select(*[f.name for f in self.schemas[name]]).withColumn("_bucket", self.bucket())
            checked = F.when(F.array_contains(inside, F.col("_bucket")), F.col("_bucket")).otherwise(
                F.raise_error(F.lit(f"{name}: a row of a bucket that the batch does not touch")).cast("int"))
            rows.withColumn("_bucket", checked).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(
                f"{self.path}/data/{name}/{_version(batch)}")
            kept |= {(name, int(n[8:])): batch for n in self._listed("data", name, _version(batch)) if n.startswith("_bucket=")}
        rows = [(t, b, v) for (t, b), v in sorted(kept.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{_version(batch)}")
        return numbers

    def upsert(self, table: str, batch: int, incoming: DataFrame, order: list[Column] | None = None) -> set[int]:
        """Rows replace stored rows of their key. With an `order` the last row of a key stays, stored or incoming, so a
        row that comes late does not undo a newer one; without, a key that repeats in the batch is an error."""
        names = [f.name for f in self.schemas[table]]

        def change(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
            stored, new = old[table], incoming.select(*names)
            if order:
                return {table: last_by(stored.unionByName(new), self.keys, order)}
            new = assert_unique(new, self.keys, "upsert")
            return {table: stored.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)}

        return self.commit(batch, incoming, change)

    def vacuum(self, keep: int = KEEP) -> int:
        """Delete manifests but the newest `keep`, and buckets that none of these names; returns how many folders went.

        Readers and retries that began within the last `keep` batches lose nothing. What a failed batch left behind
        goes when a later one is committed."""
        batches = self.batches()
        if not batches:
            return 0
        used = {(t, b, v) for batch in batches[-keep:] for (t, b), v in self.manifest(batch).items()}
        gone = [("manifest", _version(b)) for b in batches[:-keep]]
        for table in self.schemas:
            for version in self._listed("data", table):
                number = int(version[2:])
                named = [int(n[8:]) for n in self._listed("data", table, version) if n.startswith("_bucket=")]
                gone += [("data", table, version, f"_bucket={b}") for b in named if number <= batches[-1] and (table, b, number) not in used]
        for parts in gone:
            folder, files = self._folder(*parts)
            files.delete(folder, True)
        return len(gone)


MANIFEST = T.StructType([T.StructField("table", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])


def _version(batch: int) -> str:
    return f"v={batch:012d}"
