"""Best-fit packing of token sequences by the configuration linear program.

Only the histogram of lengths (one count per length, at most `capacity` of them)
is gathered on the driver.  A configuration says how many pieces of each length
share a sequence.  The linear program over configurations is solved by
multiplicative weights: every length has a weight that falls as it gets covered.
Each round a knapsack dynamic program over all open lengths gives the value of
every room for the weights, and for each open length configurations are traced
through it as long as pieces are left; those near the best value, or nearly
full, are tight for a solution of the dual program and are used.  The fractional
solution is rounded down; what is left is packed best-fit decreasing, again on
the histogram.  Where that stays above the dual bound, as it does with few
lengths that fill no sequence, the linear program is solved by the simplex
method with exact prices as well, up to EXACT lengths.  The plan with fewest
sequences counts, best fit alone among them, so it never takes more than that.
Pieces then get their places by arithmetic from their rank within their length,
so that placing is spread over all tasks however many pieces share a length.

Null texts are empty: the end id alone.  Rows that repeat a document are packed
each; a null doc_id is one like others.  Very long texts are cut into pieces of
`capacity`.  Only doc_id and text are read, whatever else the table has.  An
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, slices, staged
from .tokenization import PieceEncoder, crc_of

#: So many lengths at most have their linear program solved to the end: a pivot costs their number's square.
EXACT = 256


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids and an end id, longer ones cut into pieces."""
    encoder = PieceEncoder(tokenizer)
    end = np.array([end_id], "<u2")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                rows = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    ids = np.concatenate([np.frombuffer(raw, "<u2"), end])
                    rows += [(doc_id, k, a, len(x := ids[a : a + capacity]), crc_of(x)) for k, a in enumerate(range(0, len(ids), capacity))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(lengths: list[int], values: list[float], most: list[int], capacity: int) -> dict[int, int]:
    """The most valuable multiset of lengths that fits, each at most so many times: counts by place in lengths."""
    best = np.zeros(capacity + 1)
    taken = []
    for i, (length, value, n) in enumerate(zip(lengths, values, most, strict=True)):
        k, n = 1, min(n, capacity // length)
        while n > 0:  # 1, 2, 4, ... copies and the rest make every number
            k = min(k, n)
            size = k * length
            total = best[:-size] + k * value
            better = total > best[size:]
            best[size:] = np.where(better, total, best[size:])
            taken.append((i, k, size, better))
            n, k = n - k, 2 * k
    out: dict[int, int] = {}
    c = int(best.argmax())
    for i, k, size, better in reversed(taken):
        if c >= size and better[c - size]:
            out[i] = out.get(i, 0) + k
            c -= size
    return out


def room_values(values: np.ndarray, capacity: int) -> np.ndarray:
    """The largest value of any multiset of lengths that fits into 0, 1, ... capacity; values holds each length's, minus infinity where there is none."""
    known = np.flatnonzero(values > 0)
    short, long = int(known[0]), int(known[-1])
    best = np.zeros(capacity + 1)
    back = np.ascontiguousarray(values[::-1])  # back[capacity - length]
    held = np.empty(capacity)
    for room in range(short, capacity + 1):
        low, high = max(0, room - long), room - short + 1
        total = np.add(best[low:high], back[capacity - room + low : capacity - room + high], out=held[: high - low])
        best[room] = max(best[room - 1], total.max())
    return best


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float = 1e-3, near: float = 2e-4, enough: float = 0.99, rounds: int = 200) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations (counts by place in lengths, which ascend) with their fractional amounts, and a lower bound for the sequences.

    No length is covered beyond its count; copies are bounded by that and the
    capacity alone.  A length's value is the length times a weight that falls
    exponentially with the share of its count that is covered; the values
    divided by that of the best configuration solve the dual program, so their
    worth is a bound.  A configuration is used when its value is within `near`
    of the best one's, or its fill of a full sequence, which is the volume's
    dual solution; `near` doubles when a round adds little.  It ends when
    `enough` of the volume is covered or eight rounds added little.
    """
    left, out = counts.astype(float), []
    total = float((lengths * counts).sum())
    bound, covered, idle = total / capacity, 0.0, 0
    for _ in range(rounds):
        open_ = np.flatnonzero(left >= 1)
        if covered >= enough * total or not len(open_) or idle == 8:
            break
        size, room_for, before = lengths[open_], left[open_], covered
        worth = size * np.exp(-rate * (1 - room_for / counts[open_]))
        values = np.full(capacity + 1, -np.inf)
        values[size] = worth
        best = room_values(values, capacity)
        bound = max(bound, float((worth * counts[open_]).sum()) / best[capacity])
        for first in range(len(open_) - 1, -1, -1):
            while room_for[first] >= 1:
                used, room, value = {first: 1}, capacity - int(size[first]), worth[first]
                while room >= size[0]:
                    fit = int(np.searchsorted(size, room, side="right"))
                    further = np.where(room_for[:fit] >= 1, best[room - size[:fit]] + worth[:fit], -1.0)
                    for i, n in used.items():
                        if i < fit and room_for[i] < n + 1:
                            further[i] = -1
                    as_good = np.flatnonzero(further >= best[room] * (1 - 1e-9) - 1e-9)
                    i = int(as_good[-1]) if len(as_good) else int(further.argmax())  # of equals the longest: short ones fit later, too
                    if further[i] <= 0:
                        break
                    used[i] = used.get(i, 0) + 1
                    room, value = room - int(size[i]), value + worth[i]
                amount = min(room_for[i] / n for i, n in used.items())
                if amount < 1 or (value < (1 - near) * best[capacity] and capacity - room < (1 - near) * capacity):
                    break
                out.append(({int(open_[i]): n for i, n in used.items()}, float(amount)))
                for i, n in used.items():
                    room_for[i] -= amount * n
                covered += amount * (capacity - room)
        left[open_] = room_for
        if covered - before < 2e-3 * total:
            idle, near = idle + 1, 2 * near
    return out, bound


def solve_exactly(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 5e-4) -> tuple[list[tuple[dict[int, int], float]], float]:
    """As solve, by the simplex method: every pivot prices all lengths, and it ends within `gap` of the dual bound.

    The prices divided by the value of the best configuration are a solution of
    the dual program, so their worth is a lower bound for the sequences.
    """
    n = len(lengths)
    fit = np.minimum(capacity // lengths, counts)
    base = [{i: int(fit[i])} for i in range(n)]
    inverse, amount = np.diag(1.0 / fit), counts / fit
    bound = float((lengths * counts).sum()) / capacity
    while True:
        price = inverse.sum(axis=0)
        found = knapsack(lengths.tolist(), np.maximum(price, 0).tolist(), counts.tolist(), capacity)
        used = {i: k for i, k in found.items() if price[i] > 0}
        value = sum(price[i] * k for i, k in used.items())
        bound = max(bound, float(price @ counts) / max(value, 1.0))
        if value <= 1 + 1e-9 or amount.sum() <= bound * (1 + gap):
            break
        column = inverse[:, list(used)] @ np.array(list(used.values()), float)
        able = np.flatnonzero(column > 1e-9)
        ratio = amount[able] / column[able]
        out = int(able[np.flatnonzero(ratio <= ratio.min() + 1e-12)[0]])
        base[out] = used
        row, inverse[out] = inverse[out] / column[out], 0
        share, amount[out] = amount[out] / column[out], 0
        column[out] = -1
        inverse -= np.outer(column, row)
        amount = np.maximum(amount - column * share, 0)
    return [(used, float(x)) for used, x in zip(base, amount, strict=True) if x > 1e-9], bound


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: configurations (counts by length) and how many sequences have each."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, used: dict[int, int], many: int) -> None:
        if many:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((used, many))

    for length, left in sorted(zip(lengths, counts, strict=True), reverse=True):
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if full := left // fit:
                    put(capacity - fit * length, {length: fit}, full)
                if rest := left - full * fit:
                    put(capacity - rest * length, {length: rest}, 1)
                break
            room = rooms[at]
            used, many = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            fit = room // length
            full = min(many, left // fit)
            put(room - fit * length, used | {length: used.get(length, 0) + fit}, full)
            left -= full * fit
            if full < many:
                rest = min(left, fit) if left < fit else 0
                if rest:
                    put(room - rest * length, used | {length: used.get(length, 0) + rest}, 1)
                    left -= rest
                put(room, used, many - full - bool(rest))
    return [x for room in rooms for x in bins[room]]


def rounded(fractional: list[tuple[dict[int, int], float]], size: np.ndarray, many: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Whole amounts, largest first and rounded down, and best-fit decreasing for what they leave; and the volume's share of the former."""
    left = many.copy()
    out = []
    for used, amount in sorted(fractional, key=lambda x: -x[1]):
        n = min([int(amount + 1e-9), *(int(left[i] // k) for i, k in used.items())])
        if n > 0:
            out.append(({int(size[i]): k for i, k in used.items()}, n))
            for i, k in used.items():
                left[i] -= n * k
    rest = np.flatnonzero(left)
    return out + best_fit(size[rest].tolist(), left[rest].tolist(), capacity), 1 - float((left * size).sum()) / float((many * size).sum())


@dataclass(frozen=True)
class Plan:
    """Configurations (counts by length) and numbers of sequences; the sequences of best fit alone, a lower bound for any plan, and the volume's share that the linear program placed."""

    made: list[tuple[dict[int, int], int]]
    best_fit: int
    bound: float
    share: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.made)


def plan(lengths: list[int], counts: list[int], capacity: int = 4096, gap: float = 5e-4, **options) -> Plan:
    """A plan that holds exactly the counted lengths; the linear program's where best fit alone isn't better."""
    if not lengths:
        return Plan([], 0, 0.0, 0.0)
    order = np.argsort(lengths)
    size, many = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    plain = best_fit(size.tolist(), many.tolist(), capacity)
    alone = sum(n for _, n in plain)
    found, bound = solve(size, many, capacity, **options)
    tried = [rounded(found, size, many, capacity), (plain, 0.0)]
    fewest = min(sum(n for _, n in made) for made, _ in tried)
    if len(size) <= EXACT and fewest > bound * (1 + gap) + 1:  # as near to the dual bound as the simplex goes
        found, dual = solve_exactly(size, many, capacity, gap)
        bound = max(bound, dual)
        tried.insert(0, rounded(found, size, many, capacity))
    made, share = min(tried, key=lambda t: sum(n for _, n in t[0]))
    return Plan(made, alone, bound, share)


def ranked(rows: DataFrame, by: str, counts: list[tuple[int, int]], order: list[str], per_bucket: int = 256, salt: int = 23) -> DataFrame:
    """rows with rank (from 0) within each value of by.

    A value's rows are dealt into hash buckets, more of them the more rows it
    has; ranks are the bucket's first rank and the order inside.
    """
    spark = rows.sparkSession
    bits = spark.createDataFrame([(v, max(0, (n // per_bucket).bit_length())) for v, n in counts], f"__v {rows.schema[by].dataType.simpleString()}, __bits int")
    bits = F.broadcast(bits) if len(counts) <= 100_000 else bits
    key = F.xxhash64(F.lit(salt), *order)
    # a shift by 64 counts as none: the key's highest bit goes first, so at most 63 are shifted
    bucket = F.expr("shiftrightunsigned(shiftrightunsigned(__key, 1), 63 - __bits)")
    keyed = rows.join(bits, F.col(by) == F.col("__v")).withColumn("__key", key).withColumn("__bucket", bucket).drop("__v", "__bits")
    per = keyed.groupBy(by, "__bucket").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = staged(per.select(by, "__bucket", ahead.alias("__ahead")), "ranks")
    inside = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy("__key", *order)) - 1
    return keyed.join(before, [by, "__bucket"]).withColumn("rank", F.col("__ahead") + inside).drop("__key", "__bucket", "__ahead")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs."""
    cut = staged(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = [(r[0], r[1]) for r in cut.groupBy("length").count().collect()]  # a row for each length, at most capacity
    made = plan([c[0] for c in counts], [c[1] for c in counts], capacity, **options)
    # for each length, in order of its ranks: the configuration, how many of the length in a sequence, first sequence, place in the sequence
    base, rows, seen = 0, [], {}
    for used, n in made.made:
        place = 0
        for length, k in sorted(used.items(), reverse=True):
            rows.append((length, seen.get(length, 0), k, base, place))
            seen[length] = seen.get(length, 0) + n * k
            place += length * k
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    wide = np.int64(1 << 40)

    def placed(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, side="right") - 1
            if not (table[at, 0] == length).all():
                raise ValueError("a length isn't planned for")
            k = rank - table[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table[at, 3] + k // table[at, 2]), pa.array(table[at, 4] + k % table[at, 2] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_batches(ranked(cut, "length", counts, ["doc_id", "piece", "ids_crc32"]), placed, schema)
