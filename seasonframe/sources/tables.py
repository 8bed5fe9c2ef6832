"""Readers and writers: files by suffix, dated snapshots, upserts, season partitions, profiles."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import assert_unique, first_by, last_by


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read csv, json, jsonl/ndjson or parquet by suffix; pass a schema to skip inference."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    if suffix in (".jsonl", ".ndjson"):
        return reader.json(path)
    if suffix == ".parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported table format {suffix!r}")


def latest_snapshot(df: DataFrame, date_col: str, by: list[str] | None = None, dated: bool = False) -> DataFrame:
    """All rows of the newest dated snapshot, overall or per group.

    Overall, the newest date is a scalar subquery, which prunes a date-partitioned table; per group `dated` says that
    the table is one, and only folders of days that are some group's newest are read whole.
    """
    if by:
        newest = df.groupBy(*by).agg(F.max(date_col).alias(date_col))
        if dated:
            # Groups without a name match nothing below, so their days are not wanted.
            df = df.filter(F.array_contains(newest.dropna(subset=by).agg(F.collect_set(date_col).alias("d")).scalar(), F.col(date_col)))
        return df.join(newest, [*by, date_col])
    return df.filter(F.col(date_col) == df.agg(F.max(date_col).alias("d")).scalar())


def pinned_or_latest(df: DataFrame, date_col: str, pointer: str | None) -> DataFrame:
    """The snapshot a pointer names when it exists, else the newest one."""
    if pointer is None:
        return latest_snapshot(df, date_col)
    wanted = F.lit(pointer).cast(df.schema[date_col].dataType)
    dates = df.agg(F.max(F.when(F.col(date_col) == wanted, F.col(date_col))).alias("p"),
                   F.max(date_col).alias("d")).select(F.coalesce("p", "d")).scalar()
    return df.filter(F.col(date_col) == dates)


def write_snapshot(df: DataFrame, path: str, date_col: str, historical: bool = False, by: list[str] | None = None) -> None:
    """Write dated partitions; a rerun replaces only its own days.

    A historical snapshot never overwrites: it fails when one of its days is stored already. With `by`, few-valued
    columns such as a page or format, the days lie in folders of their own per group, and a rerun replaces the days of
    its own groups.
    """
    if historical and _path_exists(df.sparkSession, path):
        names = [*(by or []), date_col]
        key = F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias("_d")
        stored = df.sparkSession.read.parquet(path).select(key).distinct()
        if not df.select(key).distinct().join(stored, "_d", "left_semi").isEmpty():
            raise FileExistsError(f"{path} already holds a day of this snapshot")
    mode = "append" if historical else "overwrite"
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*(by or []), date_col).parquet(path))


def _path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except Exception as error:  # an absent path or a folder without data
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Incoming rows replace stored rows of the same key; new keys are added.

    Of incoming rows that repeat a key the last by `order` stays; without an order a repeat is an error
    when the result is read. An anti-join keeps the untouched rows, so a stored row moves once.
    """
    incoming = last_by(incoming, keys, order) if order else assert_unique(incoming, keys, "upsert")
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def replace_partition(df: DataFrame, path: str, col: str) -> object:
    """Replace one season of a partitioned table; the input must hold exactly one non-null season."""
    row = df.agg(F.count_distinct(col).alias("n"), F.count_if(F.col(col).isNull()).alias("nulls"),
                 F.min(col).alias("value")).first()
    if row["n"] != 1 or row["nulls"]:
        raise ValueError(f"expected one {col}, found {row['n']} and {row['nulls']} nulls")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path)
    return row["value"]


def profile(frames: Mapping[str, DataFrame], dropped: Mapping[str, DataFrame] | None = None, at: Column | None = None) -> DataFrame:
    """One row per table: rows, columns, column names, dropped rows and the time of processing, each frame read once."""
    at = F.current_timestamp() if at is None else at
    out = None
    for name, df in frames.items():
        gone = (dropped or {}).get(name)
        n_dropped = F.lit(0).cast("bigint") if gone is None else gone.agg(F.count(F.lit(1)).alias("n")).scalar()
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit(",".join(df.columns)).alias("columns"), n_dropped.alias("n_dropped"), at.alias("processed_at"))
        out = part if out is None else out.unionByName(part)
    return out


def write_profiled(df: DataFrame, path: str, name: str, dropped: Column | None = None) -> dict:
    """Write a table and return its profile, counted while it is written."""
    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("n_rows")]
    if dropped is not None:
        metrics.append(F.count_if(dropped).alias("n_dropped"))
    df.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    return {"table": name, "columns": df.columns, **seen.get}


def sink_safe(df: DataFrame) -> DataFrame:
    """Times to text and NaN to null, for export."""
    def safe(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        return c

    return df.select(*[safe(f) for f in df.schema.fields])


def append_versions(existing: DataFrame, incoming: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Versions to append: every (id, hash) not stored yet, once. A rerun appends nothing."""
    fresh = first_by(incoming, [id_col, hash_col], [F.col(c) for c in incoming.columns if c not in (id_col, hash_col)])
    return fresh.select(incoming.columns).join(existing.select(id_col, hash_col), [id_col, hash_col], "left_anti")


def current_versions(versions: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """Newest version of every id."""
    keep = [c for c in versions.columns if c != id_col]
    return versions.groupBy(id_col).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_v")).select(id_col, "_v.*")


def snapshot_chain(chain: list[tuple[DataFrame, int | Column | None]], id_col: str) -> DataFrame:
    """Union of a base snapshot and its children, oldest first.

    Reading fails when an id repeats along the chain or a declared count differs from the rows so far.
    """
    out = None
    for df, expected in chain:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if expected is not None:
            n = out.agg(F.count(F.lit(1)).alias("n")).scalar()
            wanted = expected if isinstance(expected, Column) else F.lit(expected)
            message = F.concat(F.lit("documents found: "), n.cast("string"), F.lit(", expected: "), wanted.cast("string"))
            out = out.filter(F.when(n != wanted, F.raise_error(message).cast("boolean")).otherwise(True))
    repeats = out.groupBy(id_col).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.filter(
        F.when(repeats > 0, F.raise_error(F.lit("document id repeats in the chain")).cast("boolean")).otherwise(True))
