"""Helpers shared by the operators: key checks, prefix counts, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, *cols: str) -> None:
    """Fail at plan time when a named column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available {df.columns}")


def all_of(conditions: list[Column]) -> Column:
    """AND of the conditions; true when there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """OR of the conditions; false when there are none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, new for every call.

    It lies in the shared folder the cluster names in spark.checkpoint.dir. A session that names none
    gets a folder of its own only where driver and executors are one process, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


# Value buckets per doubling of the absolute value: coarse ones are ordered in one window per group (some
# sixteen thousand at most), fine ones inside their coarse one.
COARSE, FINE = 8, 1 << 19


def value_buckets(value: Column) -> tuple[Column, Column]:
    """A coarse and a fine bucket number that never fall while the value rises.

    They follow the logarithm of the value, so they need no look at the data; NaN sorts last, as Spark has it.
    """
    v = value.cast("double")
    size = F.least(F.log2(1 + F.abs(v) * (1 << 20)), F.lit(2048.0))
    place = F.when(F.isnan(v), F.lit(2049.0)).when(v < 0, -size).otherwise(size)
    return F.floor(place * COARSE), F.floor(place * FINE)


def counts_below(df: DataFrame, value: str, by: list[str], desc: bool) -> DataFrame:
    """One row per (by, value): `n_before` = rows of the group that sort strictly before the value.

    Ties collapse in the map-side count; then three windows, each over a bounded part of a group: values inside
    a fine bucket, fine buckets inside a coarse one, coarse buckets. All three read the same counts.
    """
    coarse, fine = value_buckets(F.col(value))
    per_value = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_coarse": coarse, "_fine": fine})
    per_fine = per_value.groupBy(*by, "_coarse", "_fine").agg(F.sum("_n").alias("_n"))
    per_coarse = per_fine.groupBy(*by, "_coarse").agg(F.sum("_n").alias("_n"))

    def before(partition: list[str], order: str) -> Column:
        key = F.col(order).desc() if desc else F.col(order).asc()
        window = Window.partitionBy(*by, *partition).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    def joined(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
        same = all_of([F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys])
        return left.alias("l").join(right.alias("r"), same).select("l.*", f"r.{name}")

    offsets = joined(
        per_fine.withColumn("_in_coarse", before(["_coarse"], "_fine")),
        per_coarse.withColumn("_in_group", before([], "_coarse")), [*by, "_coarse"], "_in_group")
    offsets = offsets.withColumn("_offset", F.col("_in_coarse") + F.col("_in_group"))
    placed = joined(per_value.withColumn("_in_fine", before(["_coarse", "_fine"], value)), offsets,
                    [*by, "_coarse", "_fine"], "_offset")
    return placed.select(*by, value, (F.col("_in_fine") + F.col("_offset")).alias("n_before"))


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same rows; reading them fails when a key repeats.

    The check is one aggregate on the keys: no second read, and no shuffle when the frame is
    already partitioned by them.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    message = F.concat(F.lit(f"{name}: repeated key "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return grouped.filter(checked).select(*keys, "_row.*").select(df.columns)


# A key is heavy when it holds more than this share of what a shuffle partition would hold on average.
HEAVY_SHARE = 4


def left_join_spread(left: DataFrame, right: DataFrame, key: str, heavy: bool = False) -> DataFrame:
    """`left.join(right, key, "left")` in which rows without a key, and rows of heavy keys, go to all tasks.

    `right` has one row per key. Rows with a null key match nothing, so they are dealt by a running number instead of
    meeting in one partition. With `heavy`, keys are counted first (combined before the shuffle), and those with more
    than a quarter of an average partition, at most four times as many as there are partitions and so small enough to
    broadcast, are dealt too; their right rows are copied to every place. Without it, adaptive execution splits them.
    """
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # More places than partitions, so that their hashes fill partitions evenly.
    place = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n * width))
    right = right.where(F.col(key).isNotNull())
    if not heavy:
        dealt = left.withColumn("_place", F.when(F.col(key).isNull(), place(64)).otherwise(0))
        # Exploded, since a plain constant would be taken out of the join's keys.
        at_zero = right.withColumn("_place", F.explode(F.array(F.lit(0).cast("long"))))
        return dealt.join(at_zero, [key, "_place"], "left").drop("_place")
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    hot = F.broadcast(counts.where(F.col("_n") * (HEAVY_SHARE * width) > total).select(key, F.lit(True).alias("_hot")))
    dealt = left.join(hot, key, "left").withColumn("_place", F.when(F.col(key).isNull(), place(64)).when(F.col("_hot"), place(4)).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(4 * width - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copied = right.join(hot, key, "left").withColumn("_place", F.explode(every)).drop("_hot")
    return dealt.join(copied, [key, "_place"], "left").drop("_place")


# Whole-number types: their decimal places as Spark has them, and their smallest value.
_WHOLE = {"boolean": (3, -1), "tinyint": (3, -(1 << 7)), "smallint": (5, -(1 << 15)), "int": (10, -(1 << 31)),
          "date": (10, -(1 << 31)), "bigint": (20, -(1 << 63)), "timestamp": (20, -(1 << 63))}


def packed_order(df: DataFrame, order: list[Column]) -> Column | None:
    """The order columns as one number that sorts as the struct of them does, nulls first.

    A column becomes a digit whose base is one more than the number of values of its type (null is the one below them).
    Spark keeps a number of 38 places in its buffer, so its minimum and maximum are hash aggregates, where a struct's
    are sorted; a number of up to 63 bits is a bigint. None when a column is no whole number, date, time or decimal, or
    when the digits need more than 38 places.
    """
    digits, room = [], 1
    for field, column in zip(df.select(*order).schema.fields, order, strict=True):
        kind, name = field.dataType, field.dataType.simpleString()
        if isinstance(kind, T.DecimalType):
            places, low = kind.precision + 1, -(10 ** kind.precision) + 1
            value = column if kind.scale == 0 else column * F.lit(10 ** kind.scale)
        elif name in _WHOLE:
            places, low = _WHOLE[name]
            numbers = {"date": F.unix_date, "timestamp": F.unix_micros, "boolean": lambda c: c.cast("int")}
            value = numbers[name](column) if name in numbers else column
        else:
            return None
        base = 2 - 2 * low
        room *= base
        digits.append((value, places, low - 1, base))
    if room >= 10 ** 38:
        return None
    packed = None
    for value, places, missing, base in digits:
        kind = T.LongType() if room < 1 << 63 else T.DecimalType(min(places, 38), 0)
        constant = lambda n: F.lit(str(n)).cast(T.LongType() if room < 1 << 63 else T.DecimalType(len(str(n)), 0))
        digit = F.coalesce(value.cast(kind), constant(missing))
        packed = digit if packed is None else packed * constant(base) + digit
    return packed


def _in_place(df: DataFrame, names: list[str]) -> bool:
    """Whether an aggregate can hold these columns in a buffer of fixed width."""
    fixed = (*_WHOLE, "float", "double")
    return all(df.schema[c].dataType.simpleString() in fixed or isinstance(df.schema[c].dataType, T.DecimalType) for c in names)


def _pick_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None, pick) -> DataFrame:
    """One row per key. When order and kept columns have a fixed width each column is picked by the same packed
    number, so all come from one row and the aggregate hashes; else the row is picked as a struct."""
    keep = keep or [c for c in df.columns if c not in keys]
    at = packed_order(df, order) if _in_place(df, keep) else None
    if at is None:
        return df.groupBy(*keys).agg(pick(F.struct(*keep), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return df.withColumn("_at", at).groupBy(*keys).agg(*[pick(F.col(c), F.col("_at")).alias(c) for c in keep])


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """First row per key by a total order, as a map-side combinable aggregate (no window)."""
    return _pick_by(df, keys, order, keep, F.min_by)


def last_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Last row per key by a total order, as a map-side combinable aggregate."""
    return _pick_by(df, keys, order, keep, F.max_by)


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of a frame that an earlier `limit` has already made short."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
