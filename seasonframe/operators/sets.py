"""Set operations on frames and on id columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import first_by

_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _common_type(types: list[T.DataType]) -> T.DataType:
    kinds = {type(t) for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.NullType()
    if kinds <= set(_WIDTH):
        return max(kinds, key=_WIDTH.index)()
    if kinds == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if len(kinds) == 1:
        return next(t for t in types if not isinstance(t, T.NullType))
    return T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by name; missing columns become null and types widen to a common one."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    target = {n: _common_type([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}
    cast = [f.select(*[F.col(c).cast(target[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct."""
    return df.distinct()


def unique_on(df: DataFrame, subset: list[str], order: list[Column]) -> DataFrame:
    """First row per subset by a stated order."""
    return first_by(df, subset, order)


def intersect_ids(frames: list[DataFrame], id_col: str) -> DataFrame:
    """Ids present in every frame."""
    start = frames[0].select(id_col).distinct()
    return reduce(lambda a, b: a.join(b.select(id_col), id_col, "left_semi"), frames[1:], start)


def difference(df: DataFrame, others: list[DataFrame], id_col: str) -> DataFrame:
    """Rows whose id is in none of the others."""
    return reduce(lambda a, b: a.join(b.select(id_col), id_col, "left_anti"), others, df)
