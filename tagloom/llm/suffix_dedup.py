"""Removal of repeated passages, byte by byte, by a prefix-free parse of the corpus.

Each byte goes that a string of `length` bytes covers which starts anywhere else
too, in this document or another.  Strings never cross documents; they are judged
on the input, not on what is left.

Parse.  A rolling hash of `word` bytes triggers: of the words in a window of
`length` bytes the (last) least hash is the window's trigger.  Consecutive windows
with one trigger are a phrase, the bytes they cover.  Phrases overlap by length - 1
bytes, so every window lies in exactly one phrase; equal windows have equal
triggers at equal places, whatever surrounds them.

Dictionary.  Equal phrases are one entry, however often the parse has them.  What
the corpus order of all suffixes says up to `length` bytes then follows from the
dictionary's and the parse's:

* a trigger that the parse has once heads no repeated window;
* all windows of a phrase that the parse has twice are repeated;
* what remains are phrases that the parse has once, beside other phrases with the
  same trigger.  Only windows with one trigger can be equal, so the dictionary's
  suffixes are sorted trigger by trigger, each cut at `length` bytes: equal
  neighbours are repeated windows.  A trigger with more than GROUP phrases isn't
  sorted in one task: the windows of each of its phrases are halved by their
  distance to the trigger, and each half is a phrase again whose trigger is longer,
  the bytes that all its windows have.  Halves are judged as phrases were, until
  few share a trigger; after some eight halvings a window is its own trigger.

So a row stands for a phrase (some 70 bytes of new text), not for a byte, and
bytes travel only for phrases that stay undecided.  Texts are known by 128-bit
digests: a text that occurs twice is repeated as a whole, and copies are parsed
once in a task.

Null texts are empty.  Texts of fewer than `length` bytes lose nothing.  Rows that
repeat a doc_id, or have none, are documents of their own.  Long texts are parsed
in pieces without effect on the result.  Only doc_id and text are read, whatever
else the table has; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_heavy, map_batches, slices, spread_join, staged, utf8

#: Phrases of one trigger that one task sorts.
GROUP = 256
#: Windows whose triggers are found at once.
PIECE = 1 << 18
#: Texts whose digests a task remembers.
SEEN = 100_000

_PLACES = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Setting:
    """length: bytes of a repeated string; word: bytes of a trigger."""

    length: int = 200
    word: int = 50

    def __post_init__(self):
        if not 1 <= self.word < self.length <= 1023:
            raise ValueError("a trigger is shorter than the string, which has 1023 bytes at most")


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, modulo 2**64."""
    size = PIECE + 1024
    if n > size:
        raise ValueError("piece too long")
    if size not in _POWERS:
        both = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _POWERS[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(b)[:-1]]) for b in both)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _least_words(raw: np.ndarray, setting: Setting) -> np.ndarray:
    """For each window of raw the place of its trigger."""
    n, w = len(raw), setting.word
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    rolled = (sums[w:] - sums[:-w]) * down[: n - w + 1] * np.uint64(0xD1B54A32D192ED03)
    keys = (rolled & ~_PLACES) | (_PLACES - np.arange(len(rolled), dtype=np.uint64))
    # least key of each run of `width`, from running minima of blocks forwards and backwards
    width = setting.length - w + 1
    blocks = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    forwards = np.minimum.accumulate(blocks, axis=1).ravel()
    backwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - setting.length + 1
    least = np.minimum(backwards[:windows], forwards[width - 1 : width - 1 + windows])
    return (_PLACES - (least & _PLACES)).astype(np.int64)


def parse(raw: np.ndarray, ends: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts that lie one behind the other, as places in raw: trigger, first window, last window.  ends: where each text ends."""
    windows = len(raw) - setting.length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    trigger = np.empty(windows, np.int64)
    for start in range(0, windows, PIECE):
        stop = min(windows, start + PIECE)
        trigger[start:stop] = start + _least_words(raw[start : stop + setting.length - 1], setting)
    # windows that begin fewer than `length` bytes before a text's end aren't any
    outside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(outside, np.maximum(ends - setting.length + 1, 0), 1)
    np.add.at(outside, ends, -1)
    inside = np.cumsum(outside)[:windows] == 0
    changes = trigger[1:] != trigger[:-1]
    first = inside.copy()
    first[1:] &= changes | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= changes | ~inside[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return trigger[first], first, last


def _texts(batches):
    """Slices of batches as (slice, bytes of all texts, bytes as array, offsets)."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = utf8(part.column("text"))
            yield part, raw.tobytes(), raw, offsets


def _digests(data: bytes, offsets: np.ndarray) -> list[bytes]:
    places = offsets.tolist()
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]


def repeated_keys(docs: DataFrame, setting: Setting) -> DataFrame:
    """key, n of the triggers (8 bytes) and long enough texts (16 bytes) that occur n > 1 times."""

    def keys(batches):
        for _, data, raw, offsets in _texts(batches):
            at, _, _ = parse(raw, offsets[1:], setting)
            w = setting.word
            found = [xxhash.xxh3_64_digest(data[p : p + w]) for p in at.tolist()]
            found += [k for k, size in zip(_digests(data, offsets), np.diff(offsets).tolist(), strict=True) if size >= setting.length]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["key"])

    return map_batches(docs.select("text"), keys, "key binary").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def phrases(docs: DataFrame, setting: Setting) -> DataFrame:
    """head (the trigger), body (the phrase's digest), key (the text's digest), place (of its first window, with lead and number of further windows packed behind it).

    Texts that a task has seen are left out, so that copies don't multiply.
    """

    def found(batches):
        seen: set[bytes] = set()
        for _, data, raw, offsets in _texts(batches):
            keys = _digests(data, offsets)
            fresh = []
            for key in keys:
                fresh.append(key not in seen)
                seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            at, first, last = parse(raw, offsets[1:], setting)
            doc = np.searchsorted(offsets, first, side="right") - 1
            new = np.array(fresh, bool)[doc] if len(doc) else np.zeros(0, bool)
            at, first, last, doc = at[new], first[new], last[new], doc[new]
            w, more = setting.word, setting.length
            place = ((first - offsets[doc]) << 20) | ((at - first) << 10) | (last - first)
            p, f, e = at.tolist(), first.tolist(), last.tolist()
            columns = [
                pa.array([xxhash.xxh3_64_digest(data[x : x + w]) for x in p], pa.binary()),
                pa.array([xxhash.xxh3_128_digest(data[y : z + more], x - y) for x, y, z in zip(p, f, e, strict=True)], pa.binary()),
                pa.array([keys[i] for i in doc.tolist()], pa.binary()),
                pa.array(place),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["head", "body", "key", "place"])

    return map_batches(docs.select("text"), found, "head binary, body binary, key binary, place bigint")


def _first(place: Column) -> Column:
    return F.shiftright(place, 20)


def _many(place: Column) -> Column:
    return place.bitwiseAND(1023)


def packed(docs: DataFrame, once: bool) -> DataFrame:
    """doc_id, key and pack (the compressed text); once: texts that a task has seen are left out."""

    def run(batches):
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for part, data, _, offsets in _texts(batches):
            keys = _digests(data, offsets)
            if once:
                chosen = []
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        chosen.append(i)
                if len(seen) > SEEN:
                    seen.clear()
            else:
                chosen = range(len(keys))
            texts = pa.array([pack(data[offsets[i] : offsets[i + 1]]) for i in chosen], pa.binary())
            rows = pa.array(chosen, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), pa.array([keys[i] for i in chosen], pa.binary()), texts], names=["doc_id", "key", "pack"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, key binary, pack binary")


#: A row for each phrase, or part of one, that is still undecided: head (only phrases of one head can share windows), key, first (window), lead (from the first window to the trigger), low and high (the cell of leads it lies in), bytes.
_CUT = "head binary, key binary, first bigint, lead int, low int, high int, bytes binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


_CUT_SCHEMA = pa.schema([("head", pa.binary()), ("key", pa.binary()), ("first", pa.int64()), ("lead", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())])


def _cut(texts: DataFrame, setting: Setting) -> DataFrame:
    """The phrases `cuts` of texts, with `heavy`."""
    cell = 1 << (setting.length - setting.word).bit_length()
    schema = _CUT_SCHEMA.append(pa.field("heavy", pa.bool_()))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column("key")[i].as_py(), unpack(batch.column("pack")[i].as_py())
                rows = []
                for c in batch.column("cuts")[i].as_py():
                    first, lead, many = c["place"] >> 20, c["place"] >> 10 & 1023, c["place"] & 1023
                    rows.append((c["head"], key, first, lead, 0, cell, text[first : first + many + setting.length], c["heavy"]))
                yield _rows(rows, schema)

    return map_batches(texts.select("key", "pack", "cuts"), run, f"{_CUT}, heavy boolean")


def equal_neighbours(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string which of its suffixes, cut to `length` bytes, another suffix equals: the cut suffixes are sorted and neighbours compared."""
    starts = np.cumsum([0] + [len(s) - length + 1 for s in strings])
    suffixes = [s[i : i + length] for s in strings for i in range(len(s) - length + 1)]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    same = np.zeros(len(suffixes), bool)
    for a, b in zip(order[:-1], order[1:], strict=True):
        if suffixes[a] == suffixes[b]:
            same[a] = same[b] = True
    return [same[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _sorted_groups(cuts: DataFrame, setting: Setting) -> DataFrame:
    """key, first, last of runs of repeated windows, of heads with few phrases."""

    def run(batches):
        group: dict[tuple[bytes, int], bytes] = {}
        head = None
        schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])

        def done():
            out: list[tuple[bytes, int, int]] = []
            if len(group) > 1:
                for (key, at), flags in zip(group, equal_neighbours(list(group.values()), setting.length), strict=True):
                    if flags.any():
                        out += [(key, at + a, at + b) for a, b in zip(*(x.tolist() for x in _runs(flags)), strict=True)]
            return out

        for batch in batches:
            out = []
            for h, key, first, data in zip(*(batch.column(c).to_pylist() for c in ("head", "key", "first", "bytes")), strict=True):
                if h != head:
                    out += done()
                    group, head = {}, h
                group[key, first] = data
            yield _rows(out, schema)
        yield _rows(done(), schema)

    some = cuts.repartition("head").sortWithinPartitions("head")
    return map_batches(some.select("head", "key", "first", "bytes"), run, "key binary, first bigint, last bigint")


def _halved(cuts: DataFrame, setting: Setting) -> DataFrame:
    """Each phrase's windows in both halves of its cell of leads, as rows of their own with a new head, the bytes that all windows of the half have, and body, the digest of their own bytes."""
    length, most = setting.length, setting.length - setting.word
    schema = _CUT_SCHEMA.append(pa.field("body", pa.binary()))

    def run(batches):
        for batch in batches:
            out = []
            for key, first, lead, low, high, data in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "lead", "low", "high", "bytes")), strict=True):
                middle = (low + high) // 2
                for x, y in ((low, middle), (middle, high)):
                    a, b = max(x, lead - (len(data) - length)), min(y - 1, lead)  # leads of the last and the first window
                    if a <= b:
                        core, own = data[lead - x : lead - min(y - 1, most) + length], data[lead - b : lead - a + length]
                        out.append((xxhash.xxh3_128_digest(core, x << 10 | y), key, first + lead - b, b, x, y, own, xxhash.xxh3_128_digest(own, a << 10 | b)))
            yield _rows(out, schema)

    return map_batches(cuts.select("key", "first", "lead", "low", "high", "bytes"), run, f"{_CUT}, body binary")


def _judged(rows: DataFrame) -> DataFrame:
    """rows (head, body, loc: where it is) of a written table, with repeated (its body is elsewhere too) and entries (bodies of its head), where either says that its windows may be repeated; undecided: not repeated, or the one copy that others are to be compared with."""
    entries = staged(rows.groupBy("body", "head").agg(F.min("loc").alias("least"), F.max("loc").alias("greatest"), F.count("*").alias("n")), "dictionary")
    heads = staged(entries.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").withColumn("entries", F.col("n")), "heads")
    known = spread_join(entries.withColumnRenamed("n", "copies"), heads.select("head", "entries"), "head", "body", counted_heavy(heads, "head"), "left")
    known = known.where("least < greatest OR entries IS NOT NULL").select("body", "least", (F.col("least") < F.col("greatest")).alias("repeated"), F.coalesce("entries", F.lit(1)).alias("entries"), F.col("copies").alias("n"))
    known = staged(known, "known")
    out = spread_join(rows, known.drop("n"), "body", "loc", counted_heavy(known, "body"))
    return out.withColumn("undecided", (F.col("entries") > 1) & (~F.col("repeated") | (F.col("least") == F.col("loc")))).drop("least")


def repeated_windows(docs: DataFrame, setting: Setting | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, first, last) of runs of windows that are repeated, by the digest of their text; and (key, n) of the texts that occur n > 1 times."""
    setting = setting or Setting()
    counts = staged(repeated_keys(docs, setting), "keys")
    triggers = counts.where(F.octet_length("key") == 8).withColumnRenamed("key", "head")
    copies = counts.where(F.octet_length("key") == 16)
    parsed = phrases(docs, setting).withColumn("loc", F.xxhash64("key", "place"))
    parsed = staged(spread_join(parsed, triggers.select("head"), "head", "key", counted_heavy(triggers, "head"), "left_semi"), "phrases")
    place = F.col("place")
    heavy = F.col("entries") > GROUP
    marked = staged(_judged(parsed).select("head", "key", "place", "repeated", "undecided", heavy.alias("heavy")), "marked")
    found = [marked.where("repeated").select("key", _first(place).alias("first"), (_first(place) + _many(place)).alias("last"))]
    cuts = marked.where("undecided").groupBy("key").agg(F.collect_set(F.struct("head", "heavy", "place")).alias("cuts"))
    cuts = staged(_cut(spread_join(packed(docs, once=True), cuts, "key", "doc_id", []), setting), "cuts")
    found.append(_sorted_groups(cuts.where("NOT heavy"), setting))
    # the windows of heads with many phrases are halved until few phrases have what they share; a cell of one lead decides itself
    cuts = cuts.where("heavy")
    last = F.col("first") + F.octet_length("bytes") - setting.length
    for _ in range((setting.length - setting.word).bit_length()):
        if cuts.isEmpty():
            break
        halves = staged(_halved(cuts, setting).withColumn("loc", F.xxhash64("key", "first")), "halves")
        marked = staged(_judged(halves).select("head", "key", "first", "lead", "low", "high", "bytes", "repeated", "undecided", heavy.alias("heavy")), "judged")
        found.append(marked.where("repeated").select("key", "first", last.alias("last")))
        found.append(_sorted_groups(marked.where("undecided AND NOT heavy"), setting))
        cuts = marked.where("undecided AND heavy")
    return reduce(DataFrame.unionByName, found), copies


def _applied(texts: DataFrame, setting: Setting, kind: str) -> DataFrame:
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, spans, kept = [], [], []
            for pack, runs, copied in zip(*(batch.column(c) for c in ("pack", "runs", "copied")), strict=True):
                text = unpack(pack.as_py())
                runs, gone = runs.as_py() or [], []
                if copied.as_py():
                    runs = [{"first": 0, "last": len(text) - setting.length}]
                for r in sorted((r["first"], r["last"] + setting.length) for r in runs):
                    if gone and r[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], r[1])
                    else:
                        gone.append(list(r))
                edges = [0, *(x for g in gone for x in g), len(text)]
                sizes.append(len(text))
                spans.append([{"first": a, "size": b - a} for a, b in gone])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return map_batches(texts.select("doc_id", "pack", "runs", "copied"), run, f"doc_id {kind}, n_bytes bigint, spans array<struct<first:bigint,size:bigint>>, kept binary")


def without_repeats(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """For every document doc_id, n_bytes, spans (first byte and size of each run removed) and kept (the other bytes, which may cut characters)."""
    setting = setting or Setting()
    windows, copies = repeated_windows(docs, setting)
    runs = windows.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    runs = staged(runs.join(copies, "key", "full").select("key", "runs", F.col("n").isNotNull().alias("copied"), F.coalesce("n", F.lit(1)).alias("n")), "runs")
    texts = spread_join(packed(docs, once=False), runs.drop("n"), "key", "doc_id", counted_heavy(runs, "key"), "left")
    return _applied(texts, setting, docs.schema["doc_id"].dataType.simpleString())


def digests(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["size"])
    return without_repeats(docs, setting).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
