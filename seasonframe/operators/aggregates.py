"""Season, team, weekly and telemetry aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import assert_unique, packed_order  # noqa: F401  assert_unique is part of this module's interface
from ..functions.formulas import compile_formula
from ..functions.scalars import literal_map, ratio
from .joins import mirror_opponent


def season_totals(df: DataFrame, keys: list[str], order: list[str], game: str,
                  additive: list[str], last: list[str], distinct_list: str,
                  null_unless: Mapping[str, str] | None = None,
                  weighted: Mapping[str, tuple[str, str]] | None = None,
                  rounded: Mapping[str, int] | None = None) -> DataFrame:
    """One row per key: games, sums, last attributes and the ordered distinct list.

    A sum over nothing but nulls is 0; `null_unless` {total: count} makes a total null when the
    count is not positive; `weighted` {name: (value, weight)} adds sum(v*w)/sum(w).

    The frame is read once and grouped in two ways by one aggregate: per game the sums, and per combination of the
    attributes the first and last place in the order. A key then meets only its games' partial sums, added up before
    the shuffle, and as many places as it has combinations; of rows tied in the order the largest attributes are last.
    """
    products = {f"_{n}": F.col(v) * F.col(w) for n, (v, w) in (weighted or {}).items()}
    weights = {f"_{n}_weight": F.col(w) for n, (_, w) in (weighted or {}).items()}
    at = packed_order(df, [F.col(c) for c in order])
    rows = df.withColumns({"_at": F.struct(*order) if at is None else at, "_game": F.col(game), **products, **weights})
    summed = list(dict.fromkeys([*additive, *products, *weights]))
    # Each row twice: once with its game and values, once with its attributes and place; what is null is not added up.
    values = {f"_sum_{c}": F.col(c) for c in summed} | {"_game": F.col("_game")}
    places = {f"_{i}": F.col(c) for i, c in enumerate([distinct_list, *last])} | {"_at": F.col("_at")}
    empty = {n: F.lit(None).cast(f.dataType) for n, f in zip([*values, *places], rows.select(*values.values(), *places.values()).schema.fields, strict=True)}

    def half(own: bool, filled: Mapping[str, Column]) -> Column:
        return F.struct(F.lit(own).alias("_per_game"), *[filled.get(n, none).alias(n) for n, none in empty.items()])

    named = [f"_{i}" for i in range(len(last) + 1)]
    parts = rows.select(*keys, F.inline(F.array(half(True, values), half(False, places)))).groupBy(*keys, "_per_game", "_game", *named).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_final"), *[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in summed])
    own = F.col("_per_game")
    places = F.struct("_first", "_final", *named)
    totals = parts.groupBy(*keys).agg(
        F.count(F.when(own, F.col("_game"))).alias("games"),
        *[F.sum(F.when(own, F.col(f"_sum_{c}"))).alias(f"_sum_{c}") for c in summed],
        F.collect_list(F.when(~own, places)).alias("_places"))
    newest = F.array_max(F.transform("_places", lambda x: F.struct(x["_final"], *[x[f"_{i + 1}"] for i in range(len(last))])))
    # Sorted by the first place, so that a value stands where it was first seen.
    listed = F.array_distinct(F.transform(F.array_sort("_places"), lambda x: x["_0"]))
    means = {n: F.try_divide(F.col(f"_sum__{n}").cast("double"), F.nullif(F.col(f"_sum__{n}_weight"), F.lit(0)).cast("double"))
             for n in (weighted or {})}
    totals = totals.withColumn("_last", newest).select(
        *keys, "games", *[F.coalesce(F.col(f"_sum_{c}"), F.lit(0)).alias(c) for c in additive],
        *[m.alias(n) for n, m in means.items()],
        *[F.col("_last").getField(f"_{i + 1}").alias(f"last_{c}") for i, c in enumerate(last)],
        listed.alias(f"{distinct_list}s"))
    gated = {c: F.when(F.col(n) > 0, F.col(c)) for c, n in (null_unless or {}).items()}
    totals = totals.withColumns(gated) if gated else totals
    return totals.withColumns({c: F.bround(c, digits) for c, digits in (rounded or {}).items()}) if rounded else totals


def with_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """Add {name: (numerator, denominator, scale)} ratios."""
    return df.withColumns({n: ratio(F.col(a), F.col(b), s) for n, (a, b, s) in ratios.items()})


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum of value x weight over the sum of all weights; null values add nothing."""
    return F.try_divide(
        F.sum(value * weight).cast("double"), F.nullif(F.sum(weight), F.lit(0)).cast("double"))


def team_season(weekly: DataFrame, scores: DataFrame, entity: str, opponent: str, game: str,
                stats: list[str], by: list[str], weighted: Mapping[str, tuple[str, str]] | None = None,
                period: Column | None = None) -> DataFrame:
    """Offence sums and `_allowed` sums from opponents, points for and against, distinct games.

    scores: (game, entity, points_for, points_against). `period` optionally keeps one week slice.
    """
    rows = weekly if period is None else weekly.filter(period)
    products = {f"_{n}": F.col(v) * F.col(w) for n, (v, w) in (weighted or {}).items()}
    rows = rows.withColumns(products) if products else rows
    scored = rows.join(scores, [game, entity], "left")
    sides = mirror_opponent(scored, entity, opponent, [*stats, *products])
    own = F.col("is_own")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = sides.groupBy(*by, entity).agg(
        F.count_distinct(F.when(own, F.col(game))).alias("games"),
        F.coalesce(F.sum(F.when(own, F.col("points_for"))), F.lit(0)).alias("points_scored"),
        F.coalesce(F.sum(F.when(own, F.col("points_against"))), F.lit(0)).alias("points_allowed"),
        *[zero(c).alias(c) for s in stats for c in (s, f"{s}_allowed")],
        *[F.sum(c).alias(c) for p in products for c in (p, f"{p}_allowed")],
    )
    for name, (_, weight) in (weighted or {}).items():
        out = out.withColumns({
            name: ratio(F.col(f"_{name}"), F.col(weight), digits=None),
            f"{name}_allowed": ratio(F.col(f"_{name}_allowed"), F.col(f"{weight}_allowed"), digits=None),
        })
    return out.drop(*[c for p in products for c in (p, f"{p}_allowed")])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule: rows that break it (a null outcome counts as broken) and rows checked."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return counted.unpivot(["_rows"], list(rules), "rule", "n_violations").select(
        "rule", "n_violations", F.col("_rows").alias("n_rows"))


COMPARISONS = {
    "gte": lambda v, t: v >= t,
    "gt": lambda v, t: v > t,
    "lte": lambda v, t: v <= t,
    "lt": lambda v, t: v < t,
    "eq": lambda v, t: v == t,
}
BASES = {"stat_row": "has_fact", "active_roster": "is_active", "team_games": "is_rostered"}


def threshold_analysis(facts: DataFrame, participation: DataFrame, entity: list[str], period: str,
                       attributes: list[str], formula: str, allowed: list[str], comparison: str,
                       threshold: float, basis: str) -> DataFrame:
    """Per entity: how often a weekly formula meets a threshold over the weeks of the basis.

    facts: entity, period, attributes and formula inputs. participation: entity, period, attributes, status. Each holds one
    row per entity and period, so every list below is bounded by the calendar. A participation row may also stand for
    several periods of the same attributes: then `period` and `status` are arrays of one length, and the periods are
    never rows of their own. A basis week without a fact row counts as zero production; null inputs and zero
    denominators make the week undefined.
    """
    if comparison not in COMPARISONS or basis not in BASES:
        raise ValueError(f"unknown comparison {comparison!r} or basis {basis!r}")
    compiled = compile_formula(formula, allowed)
    who = F.struct(*attributes)
    f = facts.select(*entity, F.struct(
        F.col(period).alias("period"), who.alias("who"), compiled.value.alias("value"), compiled.status.alias("status")).alias("_f"))
    # On the basis of stat rows nothing of the participation counts: neither its weeks nor its attributes.
    participation = participation.filter(F.lit(basis != "stat_row"))
    listed = isinstance(participation.schema[period].dataType, T.ArrayType)
    each = lambda c: F.col(c) if listed else F.array(c)
    p = participation.select(*entity, F.struct(
        each(period).alias("periods"), F.transform(each("status"), lambda s: F.coalesce(s == "ACT", F.lit(False))).alias("active"),
        who.alias("who")).alias("_p"))
    lists = f.unionByName(p, allowMissingColumns=True).groupBy(*entity).agg(F.collect_list("_f").alias("_f"), F.collect_list("_p").alias("_p"))
    # What a week without production gives.
    lists = lists.withColumns({c: F.lit(0.0) for c in compiled.fields})
    lists = lists.select(*entity, "_f", F.struct(compiled.value.alias("value"), compiled.status.alias("status")).alias("_zero"), F.flatten(F.transform(
        "_p", lambda block: F.transform(F.arrays_zip(block["periods"], block["active"]), lambda x: F.struct(
            x["periods"].alias("period"), x["active"].alias("active"), block["who"].alias("who"))))).alias("_p"))

    def of_period(rows: str, x: Column) -> Column:
        return F.array_max(F.filter(rows, lambda row: row["period"].eqNullSafe(x)))

    periods = F.array_distinct(F.concat(F.transform("_p", lambda x: x["period"]), F.transform("_f", lambda x: x["period"])))
    weeks = lists.select(*entity, "_zero", F.transform(periods, lambda x: F.struct(
        x.alias("period"), of_period("_f", x).alias("f"), of_period("_p", x).alias("p"))).alias("_weeks"))
    bases = {"has_fact": lambda w: w["f"].isNotNull(), "is_rostered": lambda w: w["p"].isNotNull(),
             "is_active": lambda w: F.coalesce(w["p"]["active"], F.lit(False))}
    produced = lambda w, c: F.when(w["f"].isNotNull(), w["f"][c]).otherwise(F.col("_zero")[c])
    inside = weeks.select(*entity, "_weeks", F.transform(F.filter("_weeks", bases[BASES[basis]]), lambda w: F.struct(
        w["period"].alias("period"), F.when(w["p"].isNotNull(), w["p"]["who"]).otherwise(w["f"]["who"]).alias("who"),
        produced(w, "value").alias("value"), produced(w, "status").alias("status"))).alias("_in"))
    inside = inside.withColumns({
        "_values": F.array_sort(F.filter(F.transform("_in", lambda w: w["value"]), lambda v: v.isNotNull())),
        "_undefined": F.filter("_in", lambda w: w["status"].isNotNull()),
        "_hit": F.filter("_in", lambda w: F.coalesce(COMPARISONS[comparison](w["value"], F.lit(float(threshold))), F.lit(False)))})
    number = lambda c: F.size(c).cast("bigint")
    week_list = lambda c: F.array_sort(F.array_compact(F.transform(c, lambda w: w["period"])))
    n = F.size("_values")
    low, high = (F.get("_values", F.floor((n - i) / 2).cast("int")) for i in (1, 0))
    out = inside.select(
        *entity, F.array_max(F.transform(F.filter("_in", lambda w: w["period"].isNotNull()), lambda w: F.struct(
            w["period"].alias("period"), w["who"].alias("who"))))["who"].alias("_who"),
        number(F.filter("_weeks", bases["has_fact"])).alias("stat_row_games"),
        number(F.filter("_weeks", bases["is_active"])).alias("active_games"),
        number(F.filter("_weeks", bases["is_rostered"])).alias("team_games"),
        number("_in").alias("denominator_games"),
        number("_values").alias("evaluated_games"),
        number("_undefined").alias("undefined_games"),
        week_list("_undefined").alias("undefined_weeks"),
        number("_hit").alias("qualifying_games"),
        week_list("_hit").alias("qualifying_weeks"),
        F.when(n > 0, F.aggregate("_values", F.lit(0.0), lambda total, v: total + v) / n).alias("average"),
        F.when(n > 0, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)).alias("median"),
    )
    return out.select(
        *entity, *[F.col(f"_who.{a}").alias(a) for a in attributes],
        *[c for c in out.columns if c not in (*entity, "_who")],
        ratio(F.col("qualifying_games"), F.col("denominator_games"), digits=None).alias("qualifying_rate"),
    )


class Telemetry(NamedTuple):
    totals: DataFrame
    by_label: DataFrame
    labels: DataFrame


def telemetry_rollup(events: DataFrame, sums: list[str], flags: Mapping[str, Column],
                     averages: list[str], label: str, label_array: str | None = None) -> Telemetry:
    """Totals over all events, counts by a label, and counts of labels inside an array column."""
    aggs = [
        F.count(F.lit(1)).alias("executions"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.count_if(flag).alias(n) for n, flag in flags.items()],
        *[F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 2).alias(f"average_{c}") for c in averages],
    ]
    by_label = events.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    inner = by_label.limit(0) if label_array is None else (
        events.select(F.explode(label_array).alias(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    return Telemetry(events.agg(*aggs), by_label, inner)


# USD per million tokens (input, cached input, output), and a model alias.
TOKEN_RATES = {
    "gpt-5.6-luna": (0.20, 0.02, 1.20),
    "gpt-5.6-terra": (2.00, 0.20, 12.00),
    "gpt-5.6-sol": (4.00, 0.40, 20.00),
}
MODEL_ALIASES = {"gpt-5.6": "gpt-5.6-sol"}


def token_cost(calls: DataFrame, by: list[str], rates: Mapping[str, tuple] = TOKEN_RATES,
               aliases: Mapping[str, str] = MODEL_ALIASES) -> DataFrame:
    """Cost per group of model calls; null when a call that used tokens has an unknown model.

    A model is priced by its exact name, by an alias, or by a name it extends with `-`: its
    dash-separated prefixes are looked up, longest first. Cached tokens never exceed the input.
    """
    price = literal_map({m: list(r) for m, r in rates.items()})
    name = F.lower(F.trim(F.coalesce("model", F.lit(""))))
    if aliases:
        name = F.coalesce(F.try_element_at(literal_map(aliases), name), name)
    tokens = F.split(name, "-")
    prefixes = F.transform(
        F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), "-"))
    known = F.filter(prefixes, lambda p: F.map_contains_key(price, p))
    rate = F.try_element_at(price, F.get(known, 0))
    clean = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    used = (F.coalesce("input_tokens", F.lit(0)) != 0) | (F.coalesce("output_tokens", F.lit(0)) != 0)
    cached = F.least(clean("input_tokens"), clean("cached_input_tokens"))
    priced = calls.filter(used).select(
        *by, rate.alias("_rate"), clean("input_tokens").alias("_in"), cached.alias("_cached"),
        clean("output_tokens").alias("_out"))
    cost = (
        (F.col("_in") - F.col("_cached")) * F.col("_rate")[0]
        + F.col("_cached") * F.col("_rate")[1] + F.col("_out") * F.col("_rate")[2]
    ) / 1_000_000
    summed = priced.groupBy(*by).agg(
        F.when(~F.bool_or(F.col("_rate").isNull()), F.sum(cost)).alias("cost_usd"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.col("_rate").isNull()).alias("n_unknown"))
    return summed


def rolling_quota(runs: DataFrame, provider: str, ts: str, n: str, budget: int) -> DataFrame:
    """Requests of a provider in the 24 hours before each run (strictly), and whether they exhaust the budget.

    What a run finds used is the provider's total before it less the total before the window opened. Both are
    running sums at points in time: sums inside an hour, and sums over the hours before. No frame moves, so the
    work grows with the runs however many share a day, and a window holds one hour of a provider, or one row
    per hour.

    Null is a provider like any other, as in a window. Amounts keep their type: integers and decimals add up
    exactly; floating-point ones must be finite and carry the rounding of the provider's running sum. A null amount
    counts as zero; a run without a time finds nothing used.
    """
    day_us, hour_us = 86_400_000_000, 3_600_000_000
    # Sums of integers are bigint. A decimal held one digit short of the widest keeps its scale in one addition.
    kind = runs.schema[n].dataType
    held = T.DecimalType(37, min(kind.scale, 37)) if isinstance(kind, T.DecimalType) else (
        T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType())
    timed = runs.withColumn("_us", F.unix_micros(ts))
    opened = F.col("_us") - (day_us - 1)
    points = timed.filter(F.col(ts).isNotNull()).select(
        F.col(provider).alias("_p"), F.inline(F.array(
            F.struct(F.col("_us").alias("_at"), F.col(n).cast(held).alias("_n")),
            F.struct(opened.alias("_at"), F.lit(0).cast(held).alias("_n")))))
    points = points.groupBy("_p", "_at").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast(held).alias("_n")).withColumn(
        "_hour", F.floor(F.col("_at") / hour_us))

    def running(partition: list[str], order: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0)).cast(held)

    hours = points.groupBy("_p", "_hour").agg(F.sum("_n").cast(held).alias("_n"))
    hours = hours.select(F.col("_p").alias("_hp"), F.col("_hour").alias("_h"), running(["_p"], "_hour").alias("_earlier"))
    inside = points.withColumn("_inside", running(["_p", "_hour"], "_at"))
    totals = inside.join(hours, F.col("_p").eqNullSafe(F.col("_hp")) & (F.col("_hour") == F.col("_h"))).select(
        "_p", "_at", (F.col("_inside") + F.col("_earlier")).cast(held).alias("_before"))

    def at(rows: DataFrame, when: str, total: str) -> DataFrame:
        found = totals.select(F.col("_p").alias("_tp"), F.col("_at").alias("_t"), F.col("_before").alias(total))
        return rows.join(found, F.col(provider).eqNullSafe(F.col("_tp")) & (F.col(when) == F.col("_t")), "left").drop("_tp", "_t")

    used = at(at(timed.withColumn("_from", opened), "_us", "_until"), "_from", "_gone")
    return used.withColumn("used_24h", F.coalesce(F.col("_until") - F.col("_gone"), F.lit(0).cast(held))).withColumn(
        "exhausted", F.col("used_24h") >= budget).select(*runs.columns, "used_24h", "exhausted")


def store_status(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active reports, their chunks, embedded chunks and the sorted distinct embedding models."""
    active = reports.filter("active").select("report_id")
    counted = chunks.join(active, "report_id", "left_semi").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("embedding_model").isNotNull()).alias("n_embedded"),
        F.array_sort(F.collect_set("embedding_model")).alias("models"))
    n_active = active.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.withColumn("n_active", n_active)


def completed_keys(runs: DataFrame, by: str) -> DataFrame:
    """The keys of a backfill that a succeeded run has completed, one row each: what a restart leaves out."""
    return runs.filter((F.col("status") == "succeeded") & F.col("run_key").isNotNull()).select(by, "run_key").distinct()


def backfill_progress(runs: DataFrame, by: str) -> DataFrame:
    """Per backfill: sums over succeeded and partial runs, completed keys of succeeded ones.

    More than one distinct pinned date in a backfill stops the job.
    """
    done = F.col("status") == "succeeded"
    out = runs.filter(F.col("status").isin("succeeded", "partial")).groupBy(by).agg(
        F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_new"),
        F.coalesce(F.sum("n_changed"), F.lit(0)).alias("n_changed"),
        F.count_distinct(F.when(done, F.col("run_key"))).alias("n_completed"),
        F.count_distinct("pinned_date").alias("_pins"),
        F.min("pinned_date").alias("pinned_date"))
    check = F.when(F.col("_pins") > 1, F.raise_error(F.lit("more than one pinned date")).cast("boolean"))
    return out.filter(check.otherwise(True)).drop("_pins")


def hit_at_k(results: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """One row per case: true when any expected id is among its first k results.

    results: query_id, doc_id, rank. cases: query_id, expected (array).
    """
    expected = cases.select("query_id", F.explode("expected").alias("doc_id"))
    hits = (
        results.filter(F.col("rank") <= k).join(expected, ["query_id", "doc_id"], "left_semi")
        .select("query_id").distinct().withColumn("_hit", F.lit(True))
    )
    return cases.select("query_id").join(hits, "query_id", "left").select(
        "query_id", F.coalesce("_hit", F.lit(False)).alias("passed"))


def latest_period(df: DataFrame, by: list[str], season: str, week: str, final_week: int) -> DataFrame:
    """Newest season with data per group, and whether its final week is present."""
    seasons = df.groupBy(*by, season).agg(
        F.bool_or(F.col(week) == final_week).alias("is_complete"), F.max(week).alias("last_week"))
    return seasons.groupBy(*by).agg(
        F.max_by(F.struct(season, "is_complete", "last_week"), season).alias("_s")).select(*by, "_s.*")


def report_contract(docs: DataFrame, raw: DataFrame, bases: list[str], roles: list[str]) -> DataFrame:
    """Broken rules of stored reports, one row per (report, rule).

    docs: report_id, provider, external_id, source_hash, title, published_at (text), player_ids,
    entities (array of struct player_id, confidence, basis, role). raw: provider, external_id, source_hash.
    """
    known = raw.select("provider", "external_id", "source_hash").distinct().withColumn("_raw", F.lit(True))
    joined = docs.join(known, ["provider", "external_id", "source_hash"], "left")
    ids = F.transform("entities", lambda e: e["player_id"])
    rules = {
        "id is provider:external_id":
            F.col("report_id") == F.concat_ws(":", F.col("provider"), F.col("external_id").cast("string")),
        "raw row exists": F.col("_raw").isNotNull(),
        "title is not blank": F.trim("title") != "",
        "publish time parses": F.try_to_timestamp("published_at").isNotNull(),
        "confidence in range": F.forall("entities", lambda e: e["confidence"].between(0, 1)),
        "basis allowed": F.forall("entities", lambda e: e["basis"].isin(bases)),
        "role allowed": F.forall("entities", lambda e: e["role"].isin(roles)),
        "no entity twice": F.size(F.array_distinct(ids)) == F.size(ids),
        "id list agrees": F.array_sort(ids) == F.array_sort("player_ids"),
    }
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()]),
        lambda x: x.isNotNull())
    return joined.select("report_id", F.explode(broken).alias("rule"))
