"""Small helpers of the training-data operators: reading, lineage cuts, word rules, hashing of byte ranges."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonframe.common import work_dir

# Words between ASCII white space, as a regular expression; the same words as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: later stages never recompute it."""
    path = work_dir(df.sparkSession)
    df.write.parquet(f"{path}/t")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/t")


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table into the shared folder in buckets of a key, one per shuffle partition: joins on the key
    read it where it lies, without a shuffle of their own."""
    name = unused("bucketed").strip("_")
    df.write.bucketBy(partitions(df), key).sortBy(key).option("path", f"{work_dir(df.sparkSession)}/t").saveAsTable(name)
    return df.sparkSession.table(name)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def first_by_hash(df: DataFrame, key: str, sample: int, *ties: str) -> DataFrame:
    """At most `sample` rows, those first in the order of a hash of the key: a bounded sample to fit a model on.

    The rows are counted first, and only a share of the hash range that holds about four times the sample is
    sorted: what all tasks together hand on does not grow with their number.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    share = min(1.0, 4 * sample / max(1, df.count()))
    near = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < share * (1 << 32)
    return df.where(near).orderBy(digest, key, *ties).limit(sample)


def partitions(df: DataFrame) -> int:
    """Shuffle width of the session: the one setting by which a cluster sizes its stages."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(name: str) -> str:
    """A column name that no table has, for helper columns beside a user's own."""
    return f"_{name}_{uuid.uuid4().hex}"


def extended(df: DataFrame, added: str, without: tuple[str, ...] = ()) -> T.StructType:
    """The schema of a frame, less some columns, with more columns behind."""
    return T.StructType([f for f in df.schema.fields if f.name not in without] + T.StructType.fromDDL(added).fields)


def texts_of(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of every row, a null as an empty text, some rows at a time."""
    values = batch.column(column).cast(pa.binary())
    for s in range(0, len(values), rows):
        for text in values.slice(s, rows).to_pylist():
            yield text or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class ByteHasher:
    """64-bit hashes of any ranges of one byte buffer, from prefix sums of a polynomial over 2**64.

    The multiplier is odd, so it has an inverse and a range's hash does not depend on where it lies.
    Hashes only order and group; whoever needs equality compares the bytes.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        base = np.uint64(self.BASE)
        inverse = np.uint64(pow(self.BASE, -1, 1 << 64))
        self._inverse = _powers(inverse, n)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(base, n)[:-1]
        self._sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(terms, out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._inverse[start])


_POWERS: dict[int, np.ndarray] = {}


def tidy() -> None:
    """Give back what a finished task leaves in its worker: Spark uses the process again for other stages."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept per process up to the longest buffer seen."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            step = np.uint64(pow(int(base), len(out), 1 << 64))
            out = np.concatenate([out, out * step])
        have = _POWERS[int(base)] = out
    return have[:n]
