"""Column expressions: keys, codes, text, time and banding."""

from __future__ import annotations

import html
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status words and their codes, codes that make a player unavailable, live and final
# game states, name suffixes.
STATUS_CODES = {
    "questionable": "Q",
    "doubtful": "D",
    "out": "O",
    "injured reserve": "IR",
    "ir": "IR",
    "physically unable to perform": "PUP",
    "pup": "PUP",
    "suspended": "SUSP",
    "susp": "SUSP",
    "non-football injury": "NFI",
    "nfi": "NFI",
    "inactive": "INACTIVE",
}
UNAVAILABLE_CODES = ["O", "IR", "PUP", "SUSP", "NFI", "INACTIVE"]
LOCKED_STATES = ["in progress", "in_progress", "live", "complete", "completed", "final", "post"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
TAIL_PATTERN = r"(?i)\s*view fantasy impact\s*»?\s*$"

# Latin letters whose compatibility decomposition is one plain letter and marks, and that letter: Latin-1,
# Latin Extended-A and -B, and Latin Extended Additional.
_FOLDED = {
    chr(c): plain for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if len(plain := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1
}
_ACCENTED, _PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())


def literal_map(mapping: dict) -> Column:
    """Map column from a Python dict of fixed values."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def round_half_even(value: Column, digits: int) -> Column:
    """Half-even rounding of a double at the scaled value, the rule of columnar engines."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def ratio(numerator: Column, denominator: Column, scale: float = 1.0, digits: int | None = 3) -> Column:
    """Null-safe ratio: null for a null or zero denominator, rounded half-even as the last step."""
    value = F.when(
        denominator != 0,
        F.try_divide(numerator.cast("double") * F.lit(float(scale)), denominator.cast("double")),
    )
    return value if digits is None else round_half_even(value, digits)


def stable_id(value: Column, namespace: str, prefix: str) -> Column:
    """Version-5 UUID of `prefix:value` in the namespace, built from SHA-1 in the JVM."""
    ns = uuid.UUID(namespace).hex
    name = F.concat(F.lit(f"{prefix}:"), value.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(name, "UTF-8")))
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, 1
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_html_text(col: Column, tail_pattern: str | None = TAIL_PATTERN) -> Column:
    """Text of an HTML fragment: tags out, entities decoded, white space collapsed, tail removed.

    The raw text inside script and style elements stays as it is, so those elements are split off
    first and their `<` and `&` hidden while the rest is stripped. The Python step gets only values
    that still hold an entity, and nulls for the others.
    """
    pieces = F.split(col, r"(?i)(?=<(?:script|style)\b)|(?<=</script>)|(?<=</style>)")

    def strip(piece: Column) -> Column:
        raw = F.regexp_replace(piece, r"(?is)^<(?:script|style)\b[^>]*>|</(?:script|style)>$", "")
        plain = F.regexp_replace(F.regexp_replace(piece, r"(?s)<!--.*?-->", ""), r"(?s)<[/!?a-zA-Z][^>]*>", "")
        return F.when(piece.rlike(r"(?i)^<(?:script|style)\b"), F.translate(raw, "<&", "\u0001\u0002")).otherwise(plain)

    no_tags = F.array_join(F.transform(pieces, strip), "")
    # The condition stands inside the call: outside it, Spark would still send every text to Python.
    decoded = F.coalesce(_unescape(F.when(no_tags.contains("&"), no_tags)), no_tags)
    text = collapse_space(F.translate(decoded, "\u0001\u0002", "<&"))
    if tail_pattern:
        text = F.trim(F.regexp_replace(text, tail_pattern, ""))
    return text


def collapse_space(col: Column) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col, r"[\s ]+", " "))


def fold_ascii(col: Column) -> Column:
    """Plain Latin letters for accented ones; other non-ASCII characters, combining marks too, dropped."""
    return F.regexp_replace(F.translate(col, _ACCENTED, _PLAIN), r"[^\x00-\x7f]", "")


def drop_name_suffix(key: Column) -> Column:
    """Remove one trailing suffix token (jr, sr, ii ... v) from a spaced key."""
    return F.regexp_replace(key, rf"(^| )({'|'.join(NAME_SUFFIXES)})$", "")


def name_key(col: Column, mode: str) -> Column:
    """Comparison key of a name.

    `spaced`: accents folded, other non-alphanumerics to one space. `ascii`: the same after `.` and
    `'` are removed. `compact`: only letters and digits left. `no_suffix`: `ascii` without a
    generational suffix. `surname`: last token of `no_suffix`, null unless there are two tokens.
    """
    if mode == "spaced":
        return F.trim(F.regexp_replace(F.lower(fold_ascii(col)), r"[^a-z0-9]+", " "))
    if mode == "ascii":
        return name_key(F.translate(fold_ascii(col), ".'", ""), "spaced")
    if mode == "compact":
        return F.regexp_replace(F.lower(col), r"[^a-z0-9]", "")
    if mode == "no_suffix":
        return drop_name_suffix(name_key(col, "ascii"))
    if mode == "surname":
        tokens = F.split(name_key(col, "no_suffix"), " ")
        return F.when(F.size(tokens) >= 2, F.element_at(tokens, -1))
    raise ValueError(f"unknown name key mode {mode!r}")


def season_of(day: Column) -> Column:
    """Season of a date: the year turns over on the first of March."""
    return F.year(F.add_months(day, -2))


def kickoff_utc(day: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """UTC start from a local day and a clock text (HH:mm, HH:mm:ss or h:mmAM)."""
    text = F.upper(F.translate(F.trim(clock), " ", ""))
    stamp = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), text)
    local = F.coalesce(
        *[F.try_to_timestamp(stamp, F.lit(f"yyyy-MM-dd {p}")) for p in ("H:mm", "H:mm:ss", "h:mma")]
    )
    return F.to_utc_timestamp(local, zone)


def weighted_points(stats: Column, weights: Column) -> Column:
    """Sum of stat x weight over shared keys, rounded to cents.

    Without a shared key the preset total in the stats is used: `pts_ppr` from a reception weight
    of .75, `pts_half_ppr` from .25, else `pts_std`.
    """
    shared = F.map_filter(stats, lambda k, v: v.isNotNull() & F.map_contains_key(weights, k))
    total = F.aggregate(
        F.map_entries(shared), F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.element_at(weights, e["key"]),
    )
    reception = F.coalesce(F.try_element_at(weights, F.lit("rec")), F.lit(0.0))
    preset = (
        F.when(reception >= 0.75, F.try_element_at(stats, F.lit("pts_ppr")))
        .when(reception >= 0.25, F.try_element_at(stats, F.lit("pts_half_ppr")))
        .otherwise(F.try_element_at(stats, F.lit("pts_std")))
    )
    return F.bround(F.when(F.size(shared) > 0, total).otherwise(preset), 2)


def scoring_class(reception_weight: Column) -> Column:
    """Scoring class by reception weight."""
    weight = F.coalesce(reception_weight.cast("double"), F.lit(0.0))
    return F.when(weight >= 0.75, "ppr").when(weight >= 0.25, "half_ppr").otherwise("standard")


def two_quarterback(slots: Column) -> Column:
    """True when the slot list has SUPER_FLEX or more than one QB."""
    return F.array_contains(slots, "SUPER_FLEX") | (F.size(F.filter(slots, lambda s: s == "QB")) > 1)


def snippet(body: Column) -> Column:
    """Body lines without blanks and headings, leading bullet stripped, joined by a space."""
    lines = F.split(body, "\r\n|\n|\r")
    kept = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#")))
    return F.array_join(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, "^- ", ""))), " ")


def bounded(col: Column, n: int) -> Column:
    """White space collapsed; text over n characters cut to n with a closing `...`."""
    text = collapse_space(col)
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("..."))
    )


def normalize_url(col: Column) -> Column:
    """Lower-case scheme and host, no trailing slash (an empty path is `/`), query kept, fragment dropped."""
    text = F.regexp_replace(F.trim(col), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(text, r"(\?.+)$", 1)
    path = F.coalesce(F.nullif(F.regexp_replace(path, r"/+$", ""), F.lit("")), F.lit("/"))
    return F.concat(scheme, F.lit("://"), host, path, query)


def status_code(col: Column) -> Column:
    """Code of a known status word, else the upper-case text; blank becomes null."""
    text = F.nullif(F.trim(col), F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(STATUS_CODES), F.lower(text)), F.upper(text))


def is_unavailable(code: Column) -> Column:
    """True for the codes that take a player out."""
    return F.coalesce(code.isin(UNAVAILABLE_CODES), F.lit(False))


def embedding_text(title: Column, source: Column, published: Column, players: Column,
                   teams: Column, kind: Column, storyline: Column, body: Column) -> Column:
    """Seven header lines, a blank line and the body: the text an embedding is made from."""
    header = [
        ("Title", title),
        ("Source", source),
        ("Published", published),
        ("Players", F.array_join(players, ", ")),
        ("Teams", F.array_join(teams, ", ")),
        ("Document type", kind),
        ("Storyline", F.translate(storyline, "_", " ")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in header], F.lit(""), body)


def text_hash(col: Column) -> Column:
    """SHA-256 of the text, hexadecimal."""
    return F.sha2(col, 256)


def content_hash(json_text: Column) -> Column:
    """SHA-256 of the key-sorted compact JSON (variant output is sorted and compact)."""
    return F.sha2(F.to_json(F.parse_json(json_text)), 256)


def record_hash(*fields: Column) -> Column:
    """SHA-256 over named columns as key-sorted JSON, for records that never were JSON text."""
    return content_hash(F.to_json(F.struct(*fields)))


def band_by_boundaries(value: Column, boundaries: Column) -> Column:
    """Index of the first boundary greater than the value, else the number of boundaries."""
    return F.size(F.filter(boundaries, lambda b: b <= value))


def linear_boundaries(low: Column, high: Column, lo: float = 0.10, hi: float = 0.85,
                      n: int = 16, step: int = 25) -> Column:
    """n+1 boundaries spread evenly between two fractions of a range, rounded to the step.

    Raises at run time when the rounded boundaries do not strictly increase.
    """
    def to_step(value: Column) -> Column:
        return F.floor(value / step + 0.5) * step

    first, last = to_step(low + (high - low) * lo), to_step(low + (high - low) * hi)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda i: to_step(first + i * (last - first) / n)
    )
    rising = F.forall(
        F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: a < b), lambda x: x
    )
    return F.when(rising, points).otherwise(
        F.raise_error(F.lit("boundaries must strictly increase")).cast("array<bigint>")
    )


def snake_pick(round_no: Column, slot: Column, teams: Column) -> Column:
    """Overall pick number of a slot in a round; even rounds run backwards."""
    place = F.when(round_no % 2 == 1, slot).otherwise(teams - slot + 1)
    return (round_no - 1) * teams + place


def snake_coordinates(pick: Column, teams: Column) -> Column:
    """struct(round, slot) of an overall pick number."""
    round_no = F.floor((pick - 1) / teams) + 1
    place = (pick - 1) % teams + 1
    slot = F.when(round_no % 2 == 1, place).otherwise(teams - place + 1)
    return F.struct(round_no.cast("bigint").alias("round"), slot.cast("bigint").alias("slot"))


def is_locked(kickoff: Column, state: Column, as_of: Column) -> Column:
    """Locked once the game has started or its state is live or final."""
    started = F.coalesce(kickoff <= as_of, F.lit(False))
    return started | F.coalesce(F.lower(F.trim(state)).isin(LOCKED_STATES), F.lit(False))


def can_fill(slot_type: Column, slot_id: Column, eligible: Column, group: Column,
             current_slot: Column, locked: Column, unavailable: Column) -> Column:
    """A locked starter only fits its own slot; others must be available starters or bench."""
    own_slot = (group == "starter") & F.coalesce(current_slot == slot_id, F.lit(False))
    free = group.isin("starter", "bench") & ~unavailable
    return F.array_contains(eligible, slot_type) & F.when(locked, own_slot).otherwise(free)


def one_of(col: Column, allowed: list) -> Column:
    """Allow-list predicate."""
    return col.isin(allowed)


def in_range(col: Column, low=None, high=None) -> Column:
    """Closed range predicate; an absent bound does not filter."""
    parts = []
    if low is not None:
        parts.append(col >= F.lit(low))
    if high is not None:
        parts.append(col <= F.lit(high))
    result = F.lit(True)
    for part in parts:
        result = result & part
    return result
