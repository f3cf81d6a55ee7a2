"""Column expressions that read lists out of dirty cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import collapse, label_name, strip, visible


def literal_list(s: Column) -> Column:
    """array<string> from a JSON array or a Python list or tuple written as text; null where it is neither."""
    t = strip(s)
    t = F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("["), F.substring(t, 2, 10_000_000).substr(F.lit(1), F.length(t) - 2), F.lit("]"))).otherwise(t)
    t = F.regexp_replace(t, r",\s*\]$", "]")
    # bare words only where the text can't be read without: they could stand inside a quoted item
    bare = F.regexp_replace(t, r"(?<=[\[,]\s{0,8})(None|True|False)(?=\s{0,8}[,\]])", '"$1"')
    return F.when(t.startswith("[") & t.endswith("]"), F.coalesce(F.from_json(t, "array<string>"), F.from_json(bare, "array<string>")))


def filled(items: Column, trimmed: bool = False) -> Column:
    items = F.transform(items, lambda x: strip(F.coalesce(x, F.lit("None")))) if trimmed else F.transform(items, lambda x: F.coalesce(x, F.lit("None")))
    return F.filter(items, lambda x: strip(x) != "")


def empty() -> Column:
    return F.array().cast("array<string>")


def listish(s: Column) -> Column:
    """Items of a list cell; a text that is no list is one item; null and blank are empty."""
    return F.when(s.isNull() | (strip(s) == ""), empty()).otherwise(filled(F.coalesce(literal_list(s), F.array(s))))


def listlike(s: Column) -> Column:
    """Trimmed items of a list cell; a text that is no list is cut at commas."""
    parts = F.split(F.regexp_replace(strip(s), r"^[\[(]|[\])]$", ""), ",")
    return F.when(s.isNull() | (strip(s) == ""), empty()).otherwise(filled(F.coalesce(literal_list(s), F.when(strip(s).rlike(r"^[\[(]"), parts), F.split(s, ",")), trimmed=True))


def words_or_list(s: Column) -> Column:
    """Items of a list cell; a text that is no list is cut at white space."""
    return F.when(s.isNull() | (strip(s) == ""), empty()).otherwise(F.coalesce(filled(literal_list(s)), F.split(collapse(s), " ")))


def source_label(s: Column, default: str) -> Column:
    """A source's label: the element of a list of one, the list's text for more; default where it is missing."""
    items = filled(literal_list(s), trimmed=True)
    missing = s.isNull() | F.lower(strip(s)).isin(*lexicon.MISSING)
    several = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return F.when(missing, F.lit(default)).when(items.isNull(), strip(s)).when(F.size(items) == 0, F.lit(default)).when(F.size(items) == 1, items[0]).otherwise(several)


def split_labels(s: Column) -> Column:
    """Clean labels of a cell: a list; else cut at commas; else at the first of " & ", " and ", " AND " that it has."""
    t = strip(F.coalesce(s, F.lit("")))
    joint = F.when(t.contains(" & "), F.split(t, " & ")).when(t.contains(" and "), F.split(t, " and ")).when(t.contains(" AND "), F.split(t, " AND ")).otherwise(F.array(t))
    parts = F.coalesce(literal_list(t), F.when(t.contains(","), F.split(t, ",")), joint)
    return F.filter(F.transform(parts, lambda x: label_name(F.coalesce(x, F.lit("")))), lambda x: x != "")


def labels_of(s: Column) -> Column:
    """As split_labels, and empty where the cell is missing."""
    return F.when(s.isNull() | F.lower(strip(s)).isin(*lexicon.MISSING), empty()).otherwise(split_labels(s))


def first_label(s: Column) -> Column:
    """The first label of a cell, without invisible characters; empty where it is missing."""
    t = visible(F.coalesce(s, F.lit("")))
    return F.when(F.lower(t).isin(*lexicon.MISSING), F.lit("")).otherwise(visible(F.coalesce(F.get(literal_list(t), F.lit(0)), t)))


def single_label(s: Column, corrections: dict[str, str] | None = None) -> Column:
    """One label of a cell: corrected, generic ones dropped if others are left, "american" too; then the first."""
    table = lexicon.LABEL_CORRECTIONS if corrections is None else corrections
    t = F.btrim(visible(F.coalesce(s, F.lit(""))), F.lit("[]'\" "))
    parts = F.filter(F.transform(F.split(t, ","), visible), lambda x: x != "")
    if table:
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        parts = F.transform(parts, lambda x: F.coalesce(F.try_element_at(pairs, F.regexp_replace(F.lower(x), "-", " ")), x))
    special = F.filter(parts, lambda x: ~F.lower(x).isin(*lexicon.GENERIC_LABELS))
    parts = F.when(F.size(special) > 0, special).otherwise(parts)
    others = F.filter(parts, lambda x: F.lower(x) != "american")
    parts = F.when((F.size(parts) > 1) & (F.size(others) > 0), others).otherwise(parts)
    return F.btrim(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit("[]{}() "))


def split_last_and(items: Column) -> Column:
    """A list whose last item is cut at its right-most " and " (looked for in any case, cut in lower case)."""
    last = F.get(items, F.size(items) - 1)
    head, tail = strip(F.regexp_extract(last, r"^(.*) and (.*)$", 1)), strip(F.regexp_extract(last, r"^(.*) and (.*)$", 2))
    parts = F.filter(F.array(head, tail), lambda x: x != "")
    return F.when((F.size(items) > 0) & last.rlike(r"^.* and .*$"), F.concat(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), parts)).otherwise(items)


def comma_items(s: Column) -> Column:
    """Items of a cell without brackets and quotes at its ends, cut at commas; empty where it is missing."""
    t = F.btrim(visible(F.coalesce(s, F.lit(""))), F.lit("[]'\" "))
    parts = F.filter(F.transform(F.split(t, ","), visible), lambda x: x != "")
    return F.when(visible(F.coalesce(s, F.lit(""))) == "", empty()).when(t.contains(","), parts).otherwise(F.array(t))
