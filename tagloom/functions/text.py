"""Column expressions on strings: trimming, cleaning, labels, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

SPACE = r"(?U)\s+"


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def collapse(s: Column) -> Column:
    """Stripped, with single blanks inside."""
    return strip(F.regexp_replace(s, SPACE, " "))


def normalized(s: Column) -> Column:
    """Lower-cased and collapsed."""
    return F.lower(collapse(s))


def words(s: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(collapse(F.coalesce(s, F.lit(""))), " "), lambda w: w != "")


def is_missing(s: Column) -> Column:
    return s.isNull() | F.lower(strip(s)).isin(*lexicon.MISSING)


def visible(s: Column) -> Column:
    """No-break spaces become blanks; zero-width characters and byte order marks go."""
    return strip(F.translate(F.translate(s, " ", " "), "​﻿", ""))


def titled(s: Column) -> Column:
    """Every letter that follows no letter is upper case, the others lower case."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def raw_text(s: Column) -> Column:
    """Without parentheses, trade marks and company suffixes; collapsed."""
    s = F.regexp_replace(s, r"\([^)]*\)", "")
    s = F.regexp_replace(s, "[®™©]", "")
    s = F.regexp_replace(s, r"(?i)\b(Inc\.|LLC|Ltd\.|Corp\.|Corporation|Company|Co\.)\b", "")
    return collapse(s)


def label_name(s: Column) -> Column:
    """A label without "recipe(s)", directions, hyphens and brackets at its ends; title case."""
    s = strip(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "-", " "))
    s = F.regexp_replace(s, r"^[\[\]{}()<>\s]+|[\[\]{}()<>\s]+$", "")
    s = F.regexp_replace(s, r"\brecipes?\b", " ")
    s = F.regexp_replace(s, r"\b(north|south|east|west|northern|southern|eastern|western)\b", " ")
    return titled(collapse(s))


def label_key(s: Column) -> Column:
    """The form under which labels are looked up: lower case, no brackets and quotes at the ends, single blanks for separators."""
    s = F.btrim(F.lower(F.coalesce(s, F.lit(""))), F.lit("[]{}()\"' "))
    return strip(F.regexp_replace(s, r"[\s\-_,]+", " "))


def slug(s: Column) -> Column:
    """Letters and digits only; "label" where none is left."""
    kept = F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    return F.when(kept == "", F.lit("label")).otherwise(kept)


def alnum_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"([a-z0-9]+)"), F.lit(1))


def overlap_tokens(s: Column) -> Column:
    """Letter words of two characters or more (accents off) that count as overlap."""
    plain = F.translate(F.lower(s), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![a-z_])([a-z_]{2,15})(?![a-z_])"), F.lit(1))  # longer words don't count
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in lexicon.OVERLAP_STOPS]))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, on lower case; 0 where one is blank."""
    x, y = F.lower(strip(F.coalesce(a, F.lit("")))), F.lower(strip(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def should_merge(a: Column, b: Column, least: float = 0.7) -> Column:
    return F.arrays_overlap(overlap_tokens(a), overlap_tokens(b)) | (levenshtein_ratio(a, b) >= least)


def contains_any(s: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | s.contains(p)
    return out


def is_dropped(s: Column) -> Column:
    """Blank, in the drop list, or with a dropped part."""
    low = F.lower(strip(s))
    return (low == "") | low.isin(*lexicon.DROP_TOKENS) | contains_any(low, lexicon.DROP_SUBSTRINGS)


def is_junk(s: Column) -> Column:
    """Null, dropped, or a measure such as 16 oz or 28-ounce."""
    low = F.lower(strip(F.coalesce(s, F.lit(""))))
    return is_dropped(F.coalesce(s, F.lit(""))) | low.rlike(r"\b\d+\s*(oz|ounce|ounces|g|gram|grams|ml|litre|liter)\b") | low.rlike(r"\d+-\s*ounce")


def network_name(s: Column) -> Column:
    """A node name for the co-occurrence plot: lower-case letters; null for dropped, "-ed" and very short names."""
    t = F.lower(F.btrim(strip(s), F.lit("\"'")))
    t = F.regexp_replace(t, r"[()\[\]{}]", " ")
    t = F.regexp_replace(t, r"\d+[^a-z]+", " ")
    t = strip(F.regexp_replace(F.regexp_replace(t, r"[^a-z\s]", " "), r"\s+", " "))
    return F.when(~(is_dropped(t) | t.endswith("ed") | (F.length(t) <= 2)), t)


def profile_name(s: Column, mapped: Column) -> Column:
    """A record item for profiles: `mapped` is the dictionary's name of item_key(s); null for noise."""
    t = strip(F.coalesce(mapped, item_key(s, lower=False)))
    low = F.lower(t)
    noise = is_dropped(low) | low.isin(*lexicon.PREPARATION) | low.endswith("ed") | low.rlike(r"^[\W_]+$")
    return F.when(s.isNotNull() & ~noise, t)


def item_key(s: Column, lower: bool = True) -> Column:
    t = F.btrim(F.btrim(strip(s), F.lit('"')), F.lit("'"))
    t = F.regexp_replace(t, r"^[,;:]+|[,;:]+$", "")
    return F.lower(t) if lower else t


def map_term(s: Column, mapped: Column) -> Column:
    """A feature term: its dictionary name, or null where that is dropped."""
    t = strip(F.coalesce(mapped, strip(s)))
    return F.when(~is_dropped(t), t)


def with_offsets(items: Column, separator: str = ", ") -> Column:
    """struct<text, spans: array<struct<start, end>>>: the joined items and where each stands."""
    sizes = F.transform(items, F.length)
    before = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda t, n: t + n + len(separator))
    spans = F.transform(sizes, lambda n, i: F.struct(before(i).alias("start"), (before(i) + n).alias("end")))
    return F.struct(F.array_join(items, separator).alias("text"), spans.alias("spans"))


def _channel(color: Column, i: int) -> Column:
    return F.conv(F.substring(F.ltrim(color, F.lit("#")), 2 * i + 1, 2), 16, 10).cast("int")


def _color(channels: list[Column]) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("bigint")), 2, "0") for c in channels]))


def lighter(color: Column, share: float = 0.35) -> Column:
    """A color (#rrggbb) moved towards white; anything else stays."""
    channels = [_channel(color, i) for i in range(3)]
    return F.when(color.rlike("(?i)^#?[0-9a-f]{6}"), _color([F.least(F.lit(255), F.floor(c + (255 - c) * F.lit(share))) for c in channels])).otherwise(color)


def blended(a: Column, b: Column, otherwise: str = "#6b7280") -> Column:
    """The even mixture of two colors; gray where one is none."""
    ok = a.rlike("(?i)^#?[0-9a-f]{6}") & b.rlike("(?i)^#?[0-9a-f]{6}")
    return F.when(ok, _color([F.floor((_channel(a, i) + _channel(b, i)) / 2) for i in range(3)])).otherwise(F.lit(otherwise))
