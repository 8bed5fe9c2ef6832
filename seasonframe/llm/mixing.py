"""Mixing sources to target weights: capped targets, a time-varying curriculum, and a range-sorted training order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonframe.llm.common import WORD

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)

# No source is read more often than this, and so no document.
MAX_EPOCHS = 3

# Weight schedules over training time 0..1, as (time, weight) knots joined by straight lines; the n-th source
# in code-point order takes the n-th schedule, repeating. Only the shape matters: the area is scaled to the target.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 1.75)),
)

# Hex digits that name a slice of a source's hash order: a window holds one slice, so a source with a third of
# all rows is summed by 16 ** SLICE_DIGITS groups.
SLICE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: `source_size`, its place in code-point order (null last) and its `target`.

    The targets are the water level: min(max_epochs * size, weight * level), with the level at which they add
    up to all words. Sources are taken in the order in which a rising level meets their cap; the level is
    found at the first source that stays below. The windows run over one row per source, not over documents.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_place", F.row_number().over(by_name) - 1).withColumn(
        "_weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("_place") % len(weights)).cast("long"))
    everything = Window.partitionBy()
    meets = Window.orderBy(F.col("source_size") / F.col("_weight"), "_place")
    before = meets.rowsBetween(Window.unboundedPreceding, -1)
    after = meets.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = ranked.select(
        "*", F.sum("source_size").over(everything).alias("_total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_full"),
        F.sum("_weight").over(after).alias("_open"))
    level = (F.col("_total") - max_epochs * F.col("_full")).cast("double") / F.col("_open").cast("double")
    stays = level * F.col("_weight") <= (max_epochs * F.col("source_size")).cast("double")
    found = capped.withColumn("_level", F.min(F.when(stays, F.struct("_full", "_place", level.alias("level")))).over(everything))
    return found.select(
        "source", "source_size", "_place",
        F.least((max_epochs * F.col("source_size")).cast("double"), F.col("_weight") * F.col("_level.level")).alias("target"))


def position_of(share: Column, place: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time at which a source has been given `share` (0..1) of its words: the inverse of the
    integral of its schedule, one quadratic per straight piece."""
    out = F.lit(None).cast("double")
    for n, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, done, pieces = sum(areas), 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            rest = F.greatest(share * whole - done, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            # The stable root of w0*x + slope*x*x/2 = rest.
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
            pieces.append((done + area, F.lit(t0) + 2 * rest / (root + w0)))
            done += area
        inverse = reduce(lambda tail, p: F.when(share * whole <= p[0], p[1]).otherwise(tail),
                         reversed(pieces[:-1]), pieces[-1][1])
        out = F.when(place % len(schedules) == n, F.least(inverse, F.lit(knots[-1][0]))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        schedules: tuple = SCHEDULES, slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """One row per document: its columns doc_id and source, size, source_size, target, copies, taken, positions.

    Inside a source, documents stand in the order of a hash of their id. The mix reads the source whole as
    often as the target allows, then once more the documents whose middle lies before what is left, so the
    words taken differ from the target by half a document at most. `positions` has the training time (0..1)
    of each copy: the time at which the source's integrated schedule has asked for the words before it.

    The order's running sum needs no group in one task: sizes are added up per (source, slice of the hash
    order), slices are summed in a window of at most 16 ** `slice_digits` rows, and documents only inside their slice.

    Null texts and texts without words have size 0 and are never asked for (0 words taken); a null source is
    the last source; null ids have a place like others, equal rows tie and give equal results in some order;
    an empty table gives no rows. Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn(
        "_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sized = sized.withColumn("_slice", F.substring("_hash", 1, slice_digits))
    per_slice = sized.groupBy("source", "_slice").agg(F.sum("size").alias("size"))
    offsets = per_slice.select(
        "source", "_slice",
        F.coalesce(F.sum("size").over(
            Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_offset"))
    places = offsets.alias("o").join(source_targets(per_slice, weights, max_epochs).alias("t"),
                                     F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t._place", "t.target")
    inside = Window.partitionBy("source", "_slice").orderBy("_hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    running = sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = running.alias("d").join(
        places.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._slice") == F.col("p._slice"))
    ).select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", "p._place",
             (F.col("d._inside") + F.col("p._offset")).alias("_before"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - full * F.col("source_size")
    more = (F.col("_before") + F.col("size") / 2 < left) & (full < max_epochs)
    copies = F.when(F.col("size") > 0, full + more.cast("long")).otherwise(0)
    mixed = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))

    def share(epoch: Column) -> Column:
        asked = F.col("_before") + F.col("size") / 2 + epoch * F.col("source_size")
        return F.least(asked / F.col("target"), F.lit(1.0))

    positions = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1),
        lambda epoch: position_of(share(epoch), F.col("_place"), schedules))).otherwise(F.array().cast("array<double>"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken",
                        positions.alias("positions"))


def curriculum(mixed: DataFrame) -> DataFrame:
    """The training order: one row per copy, range-sorted by position, ties by document and copy."""
    copies = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "doc_id", "copy")
