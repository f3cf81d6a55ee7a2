"""Quality by a generalised additive model with pairwise interactions.

Numbers that describe a text's form are cut into bins.  Shallow trees, boosted
in turn over the features, learn a table of additions for every feature's bins;
then the pairs of features that still explain most get tables over the grid of
their coarser bins.  A score is a sum of looked-up additions, made for whole
batches at once.  The model is fitted on a bounded sample of labelled rows; every
text is scored whole.

Null and empty texts have features like any other (all zero) and get a score.
Without labelled rows, or features that tell anything, the score is the smoothed
share of label 1 (0.5 without labels).  Repeated rows are scored each; of rows to
learn from, equal ones count once.  Very long texts are described whole, and equal
scores need no order.  An empty table gives an empty result.  Only doc_id and text
are read, whatever else the table has; filtering keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices
from .learning import labelled, remainder
from .textstats import Words, mixed

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper_share", "digit_share", "wide_share", "bangs", "symbols", "pipes", "commas", "stops", "lines",
    "distinct_words", "top_word", "repeated_triples", "repeated_lines", "symbol_ends", "short_words", "capitals", "longest_word",
)


def _classes() -> np.ndarray:
    """A class per byte: 1 upper, 2 lower, 3 digit, 4 above ASCII, 5 !, 6 |, 7 comma, 8 . and ?, 9 line end, 10 other sign, 0 else."""
    c = np.zeros(256, dtype=np.uint8)
    c[33:127] = 10
    c[65:91], c[97:123], c[48:58], c[128:] = 1, 2, 3, 4
    for byte, k in ((33, 5), (124, 6), (44, 7), (46, 8), (63, 8), (10, 9)):
        c[byte] = k
    c[[34, 39, 40, 41, 45, 58, 59]] = 0
    return c


_CLASS = _classes()


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = Words(column)
    rows, off, kinds = len(w), w.offsets, _CLASS[w.raw]
    count = np.zeros((11, rows))
    for k in range(1, 11):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        count[k] = total[off[1:]] - total[off[:-1]]
    size = np.diff(off).astype(float)
    n = np.diff(w.first).astype(float)
    some, some_bytes = np.maximum(n, 1), np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    per = lambda x: (lambda t: t[w.first[1:]] - t[w.first[:-1]])(np.concatenate([[0.0], np.cumsum(x)])) / some
    mean = per(length)
    spread = np.sqrt(np.maximum(0, per(length**2) - mean**2))
    ends = _CLASS[w.raw[w.end - 1]] if len(w.end) else np.zeros(0, np.uint8)
    starts = _CLASS[w.raw[w.start]] if len(w.start) else np.zeros(0, np.uint8)
    letters = np.maximum(count[1] + count[2] + count[4] / 2, 1)
    distinct, top, triples, repeated, longest = (np.zeros(rows) for _ in range(5))
    h = w.hash
    third = mixed(h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7)) if len(h) > 2 else np.zeros(0, np.uint64)
    breaks = np.flatnonzero(kinds == 9)
    line_of_word = np.searchsorted(breaks, w.start)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b == a:
            continue
        s = np.sort(h[a:b])
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        distinct[i], top[i], longest[i] = (len(edge) - 1) / (b - a), np.diff(edge).max() / (b - a), length[a:b].max()
        if b - a > 2:
            s = np.sort(third[a : b - 2])
            triples[i] = 1 - (1 + np.count_nonzero(s[1:] != s[:-1])) / len(s)
        lines = line_of_word[a:b]
        if lines[-1] > lines[0]:
            at = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
            s = np.sort(np.add.reduceat(h[a:b] * (np.arange(b - a, dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, b - a))).astype(np.uint64) + np.uint64(1)), at))
            repeated[i] = 1 - (1 + np.count_nonzero(s[1:] != s[:-1])) / len(s)
    return np.column_stack([
        np.log1p(size), np.log1p(n), mean, spread, count[1] / letters, count[3] / some_bytes, count[4] / some_bytes, count[5] / some, count[10] / some, count[6] / some, count[7] / some, count[8] / some, count[9] / some,
        distinct, top, triples, repeated, per((ends == 5) | (ends == 10)), per(length <= 3), per(starts == 1), longest,
    ])


@dataclass
class AdditiveModel:
    """Edges of the bins by feature, additions by feature and bin, and by pair of features and pair of coarse bins."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, b = np.full(len(x), self.start), self.bins(x)
        for f, table in enumerate(self.tables):
            out += table[b[:, f]]
        for (f, g), table in self.pairs.items():
            out += table[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _leaf(g, h, ridge):
    return g / (h + ridge)


def _stump(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """A tree of few leaves over ordered bins, from gradients and curvatures by bin: additions by bin."""
    parts = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gl, hl, gr, hr = G[cut] - G[a], H[cut] - H[a], G[b] - G[cut], H[b] - H[cut]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        (a, b), c = best[1:]
        parts[parts.index((a, b))] = (a, c)
        parts.append((c, b))
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(G[b] - G[a], H[b] - H[a], ridge)
    return out


def _corner(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four parts: its gain and the additions."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, out
    a, b = G[:-1, :-1], H[:-1, :-1]
    top, right = (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b)
    rest = (G[-1, -1] - a - top[0] - right[0], H[-1, -1] - b - top[1] - right[1])
    quarters = ((a, b), top, right, rest)
    gain = sum(x**2 / (y + ridge) for x, y in quarters) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 0:
        return best, out
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = _leaf(a[i, j], b[i, j], ridge), _leaf(top[0][i, j], top[1][i, j], ridge)
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = _leaf(right[0][i, j], right[1][i, j], ridge), _leaf(rest[0][i, j], rest[1][i, j], ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.1, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 2.0) -> AdditiveModel:
    model = AdditiveModel(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * pair_bins // max(s, pair_bins) for s in sizes]
    odds = np.full(len(y), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, size in enumerate(sizes):
            g, h = slopes()
            step = rate * _stump(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), ridge)
            model.tables[f] += step
            odds += step[b[:, f]]
    c = [model.coarse[f][b[:, f]] for f in range(len(sizes))]
    wide = [int(m.max()) + 1 for m in model.coarse]

    def grid(f, g, values):
        return np.bincount(c[f] * wide[g] + c[g], values, wide[f] * wide[g]).reshape(wide[f], wide[g])

    g, h = slopes()
    ranked = sorted(((_corner(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = {(i, j): np.zeros((wide[i], wide[j])) for _, i, j in ranked[:pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            step = rate * _corner(grid(i, j, g), grid(i, j, h), ridge)[1]
            table += step
            odds += step[c[i], c[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most_rows: int = 20_000, **options) -> AdditiveModel:
    """The model from labels.quality, of rows where crc32(doc_id) % modulus isn't held_out; most_rows bounds the sample."""

    def described(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", remainder(F.col("doc_id"), modulus) != held_out, most_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = map_batches(rows, described, f"doc_id {kind}, y int, x array<double>").toPandas().sort_values(["doc_id"], kind="stable")
    x = np.array(seen["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # rows that repeat an id come in any order
    return fit(x[order], seen["y"].to_numpy(float)[order], **options)


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = learn(docs, labels, modulus, held_out, **options)

    def scored(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.score(features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    return map_batches(base, scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""
    model = learn(docs, labels, **options)

    def chosen(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= least))

    return map_batches(docs, chosen, docs.schema)
