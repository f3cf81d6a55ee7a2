"""Column expressions for the token pipelines: strip noise, canonical forms, dictionary lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import alnum_tokens, is_dropped, strip, words

NUMBER = r"^[0-9]+([./][0-9]+)?$"


def without_repeats(ws: Column) -> Column:
    """Words without consecutive repeats (any case)."""
    last = lambda a: F.lower(F.element_at(a, -1))
    step = lambda a, w: F.when((F.size(a) > 0) & (last(F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("")))) == F.lower(w)), a).otherwise(F.concat(a, F.array(w)))
    return F.aggregate(ws, F.array().cast("array<string>"), step)


def strip_noise(ws: Column, frequency: Column | None = None) -> Column:
    """Words without noise words, numbers and repeats; of several, those with the largest frequency (map<string,bigint>)."""
    kept = F.filter(ws, lambda w: ~F.lower(w).isin(*lexicon.PHRASE_NOISE) & ~w.rlike(NUMBER))
    kept = without_repeats(F.when(F.size(kept) > 0, kept).otherwise(F.slice(ws, 1, 1)))
    if frequency is None:
        return kept
    count = lambda w: F.coalesce(F.try_element_at(frequency, F.lower(w)), F.lit(0).cast("bigint"))
    best = F.array_max(F.transform(kept, count))
    return F.when(F.size(kept) > 1, F.filter(kept, lambda w: count(w) == best)).otherwise(kept)


def first_words(raw: Column, frequency: Column | None = None) -> Column:
    """The words of a phrase that count: the first alone where it is repeated; else those that are no noise."""
    ws = words(raw)
    ws = F.when((F.size(ws) >= 2) & (F.lower(F.get(ws, F.lit(0))) == F.lower(F.get(ws, F.lit(1)))), F.slice(ws, 1, 1)).otherwise(ws)
    return F.when(F.size(ws) > 1, strip_noise(ws, frequency)).otherwise(ws)


def short_phrase(ws: Column) -> Column:
    """Words as a phrase; null beyond four."""
    return F.when(F.size(ws) <= 4, F.array_join(ws, " "))


def first_pass(raw: Column, frequency: Column | None = None) -> Column:
    """A phrase up to the second dictionary lookup: null beyond four words."""
    return short_phrase(first_words(raw, frequency))


def last_pass(phrase: Column, collapse_repeats: bool = False) -> Column:
    """A phrase after the second lookup: null where it is blank or dropped."""
    out = strip(F.array_join(without_repeats(words(phrase)), " ") if collapse_repeats else phrase)
    return F.when(~is_dropped(out), out)


def singular_candidates(phrase: Column) -> tuple[Column, Column, Column]:
    """Whether a phrase may change, its canonical name if its form is listed, and its last word without plural ending."""
    low = F.lower(strip(phrase))
    ws = words(low)
    tail = F.slice(ws, 2, 1_000)
    frozen = F.arrays_overlap(tail, F.array(*[F.lit(w) for w in lexicon.STOP_SUFFIXES])) | (F.size(ws) == 0)
    named = F.lit(None).cast("string")
    for name, forms in lexicon.CANONICAL_SETS.items():
        named = F.when(low.isin(*forms), F.lit(name)).otherwise(named)
    last = F.get(ws, F.size(ws) - 1)
    bare = F.when(last.endswith("es") & (F.length(last) > 2), last.substr(F.lit(1), F.length(last) - 2)).when(last.endswith("s") & (F.length(last) > 1), last.substr(F.lit(1), F.length(last) - 1))
    plural = F.array_join(F.concat(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.array(bare)), " ")
    return ~frozen, named, F.when(bare.isNotNull(), plural)


def canonical(phrase: Column, names: Column) -> Column:
    """The canonical form of a phrase; names: array<string> of the dictionary's keys and values."""
    free, named, bare = singular_candidates(phrase)
    listed = bare.isin(*[f for forms in lexicon.CANONICAL_SETS.values() for f in forms]) | F.array_contains(names, bare)
    return F.when(~free, phrase).otherwise(F.coalesce(named, F.when(listed, bare), phrase))


def head_words(phrase: Column) -> Column:
    """The rule-based normaliser: the last two alphanumeric words without descriptive words, units and numbers; null if none is left."""
    kept = F.filter(alnum_tokens(phrase), lambda w: ~w.isin(*lexicon.DESCRIPTIVE) & ~w.isin(*lexicon.UNITS) & ~w.rlike(r"^\d+$"))
    tail = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2)
    return F.when(F.size(kept) > 0, F.array_join(tail, " "))


def _tags(ws: Column) -> Column:
    """A letter for each word: O of, F other function words and commas, U numbers and units, D descriptive words, M participles and adverbs, W what may be a noun."""

    def tag(w: Column) -> Column:
        known = F.when(w == "of", "O").when(w.isin(",", *lexicon.FUNCTION_WORDS), "F").when(w.isin(*lexicon.UNITS) | w.rlike(r"^\d+$"), "U").when(w.isin(*lexicon.DESCRIPTIVE), "D")
        return known.when(w.rlike("^(.{3,}ed|.{4,}ing|.{3,}ly)$"), "M").otherwise("W")

    return F.array_join(F.transform(ws, tag), "")


def head_phrase(phrase: Column) -> Column:
    """The head of a phrase with its compounds: the last run of nouns before the first function word or comma.

    Where there is none and "of" follows (2 cups of flour), the part behind it
    counts.  A generic head alone takes the nearest participle before it that isn't
    descriptive.  Without a noun the last two words that count stand for the phrase;
    null if none is left.
    """
    ws = F.regexp_extract_all(F.lower(F.coalesce(phrase, F.lit(""))), F.lit("([a-z0-9]+|,)"), F.lit(1))
    tags = _tags(ws)
    first = F.regexp_extract(tags, "^[^FO]*", 0)
    second = F.regexp_extract(tags, "^[^FO]*O([^FO]*)", 1)
    plain = first.contains("W")
    part = F.when(plain, first).otherwise(second)
    start = F.when(plain, 0).otherwise(F.length(first) + 1)
    run = F.length(F.regexp_extract(part, "(W+)[^W]*$", 1))
    at = start + F.length(F.regexp_extract(part, "^(.*?)W+[^W]*$", 1))
    nouns = F.slice(ws, at + 1, run)
    before = F.regexp_extract(F.substring(tags, start + 1, at - start), "M[^M]*$", 0)
    modifier = F.get(ws, at - F.length(before))
    generic = (run == 1) & F.get(ws, at).isin(*lexicon.GENERIC_HEADS) & (F.length(before) > 0)
    return F.when(run == 0, head_words(phrase)).when(generic, F.concat_ws(" ", modifier, F.get(ws, at))).otherwise(F.array_join(nouns, " "))


def lookup(token: Column, table: Column) -> Column:
    """A dictionary column's entry for a token, or the token."""
    return F.coalesce(F.try_element_at(table, token), token)


def with_map(token: Column, table: Column | None = None, frequency: Column | None = None, collapse_repeats: bool = False, canonicalizer=None) -> Column:
    """The whole token pipeline for one token, with the dictionary as a map column; null where the token is dropped.

    canonicalizer: a function from a token column to a token column, run first.
    """
    raw = canonicalizer(token) if canonicalizer else token
    found = (lambda t: F.coalesce(F.try_element_at(table, t), F.try_element_at(table, F.lower(t)), t)) if table is not None else (lambda t: t)
    return last_pass(found(first_pass(found(strip(raw)), frequency)), collapse_repeats)
