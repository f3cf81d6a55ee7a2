"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its
letters' vectors, each permuted (rolled) by its place, by multiplying them
component by component.  A text's vector bundles (adds) the vectors of all its
n-grams, a language's prototype those of its training texts, and a text gets the
language whose prototype has the largest cosine.  Letters are lower-cased;
anything else is one blank at word edges.

Vectors come from seeds, so every executor makes the same ones.  The vectors of
n-grams are made once per worker and kept in a table of bounded size.
Prototypes are sums of unit vectors over a sample of the texts to learn from,
a bounded number for each language; every text is compared whole.

Null texts and texts without a letter are `und` with score 0; so is every text
when there is nothing to learn from.  Languages that tie are taken in order of
their names.  Repeated rows are predicted each, an empty table gives an empty
result, very long texts are counted whole, and only doc_id, text and lang are
read, whatever else the table has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices
from .learning import remainder

UNKNOWN = "und"
#: Anything but letters and the marks that belong to them, such as vowel signs.
_BREAK = regex.compile(r"[^\p{L}\p{M}]+")
_CODES = 21  # bits of a code point


def letters(text: str | None) -> str:
    """Lower-cased letters with one blank at both ends of every word; empty without letters."""
    found = _BREAK.sub(" ", text.lower()).strip() if text else ""
    return f" {found} " if any(map(str.isalpha, found)) else ""  # marks alone are no letters


_SHARED: dict[tuple, Encoder] = {}


def shared(*setting: int) -> Encoder:
    """One encoder for all tasks of a worker, so that its table serves them all."""
    if setting not in _SHARED:
        _SHARED[setting] = Encoder(*setting)
    return _SHARED[setting]


class Encoder:
    """Hypervectors of texts."""

    def __init__(self, dims: int = 512, n: int = 3, seed: int = 11, most_grams: int = 60_000):
        self.dims, self.n, self.seed, self.most_grams = dims, n, seed, most_grams
        self._reset()

    def _reset(self) -> None:
        self.letter: dict[int, np.ndarray] = {}
        self.codes = np.zeros(0, np.uint64)
        self.table = np.zeros((0, self.dims), np.float32)

    def __reduce__(self):
        return shared, (self.dims, self.n, self.seed, self.most_grams)

    def letter_vector(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) > 20_000:
                self.letter.clear()
            self.letter[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims).astype(np.int8) * 2 - 1
        return self.letter[code]

    def gram_vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dims), np.int8)
        for place in range(self.n):
            code = (grams >> np.uint64(_CODES * place)) & np.uint64((1 << _CODES) - 1)
            which, back = np.unique(code, return_inverse=True)
            out *= np.roll(np.stack([self.letter_vector(int(c)) for c in which]), place, axis=1)[back]
        return out.astype(np.float32)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """A row of dims for each text: the sum of its n-grams' vectors; zero without letters."""
        out = np.zeros((len(texts), self.dims), np.float32)
        counted = []
        for text in texts:
            code = np.frombuffer(letters(text).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            if len(code) < self.n:
                code = np.concatenate([code, np.full(self.n - len(code), 32, np.uint64)]) if len(code) else code
            gram = code[: len(code) - self.n + 1] if len(code) else code
            for place in range(1, self.n if len(code) else 0):
                gram = gram | (code[place : len(code) - self.n + 1 + place] << np.uint64(_CODES * place))
            counted.append(np.unique(gram, return_counts=True))
        for i, (gram, count) in enumerate(counted):
            for first in range(0, len(gram), self.most_grams):  # pieces that fit into the table
                piece = slice(first, first + self.most_grams)
                out[i] += count[piece].astype(np.float32) @ self._rows(gram[piece])
        return out

    def _rows(self, gram: np.ndarray) -> np.ndarray:
        """The vectors of at most most_grams distinct n-grams; a table without room for the new ones is emptied and takes all of gram."""
        at = np.searchsorted(self.codes, gram)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == gram) if len(self.codes) else np.zeros(len(gram), bool)
        if not known.all():
            if len(self.codes) + np.count_nonzero(~known) > self.most_grams:
                self.codes, self.table, known = self.codes[:0], self.table[:0], np.zeros(len(gram), bool)
            self._learn(gram[~known])
            at = np.searchsorted(self.codes, gram)
        return self.table[at]

    def _learn(self, fresh: np.ndarray) -> None:
        codes = np.concatenate([self.codes, fresh])
        order = np.argsort(codes)
        self.codes, self.table = codes[order], np.concatenate([self.table, self.gram_vectors(fresh)])[order]


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def even(counts: list[int], most: int) -> int:
    """The largest number for each that takes at most `most` in all, where nothing gives more than it has."""
    left = most
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) >= left:
            return left // (len(counts) - i)
        left -= n
    return max(counts, default=0)


def learn(docs: DataFrame, modulus: int = 3, held_out: int = 1, most_rows: int = 20_000, least: int = 100, encoder: Encoder | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (by name) and their prototypes as unit vectors.

    Learns from text and lang of a sample of the rows where crc32(doc_id) %
    modulus isn't held_out: all rows of a language with few, and about the same
    number of every other, so that about most_rows are taken, but never fewer
    than about `least` of a language that has them.
    """
    encoder = encoder or Encoder()
    dims = encoder.dims
    rows = docs.where(remainder(F.col("doc_id"), modulus) != held_out).where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()]  # a row for each language
    share = max(least, even([n for _, n in counts], most_rows))
    steps = 1 << 40
    limits = docs.sparkSession.createDataFrame([(lang, min(steps, steps * share // n)) for lang, n in counts], "lang string, limit bigint")
    rows = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(steps)) < F.col("limit")).select("text", "lang")

    def summed(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                for lang, v in zip(langs, unit(encoder.vectors(part.column("text").to_pylist())), strict=True):
                    held[lang] = held[lang] + v if lang in held else v.astype(np.float64)
        for lang in held:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims, dtype=np.int32)), pa.array(held[lang])], names=["lang", "dim", "v"])

    sums = map_batches(rows, summed, "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("v")).collect()
    found.sort(key=lambda r: r["lang"])
    table = np.array([[x["v"] for x in r["v"]] for r in found], dtype=np.float64).reshape(-1, dims)
    # sums of doubles come in any order: rounding makes reruns agree
    return [r["lang"] for r in found], np.round(unit(table), 9).astype(np.float32)


def predict(docs: DataFrame, modulus: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 at least) for every row of docs."""
    encoder = options.setdefault("encoder", Encoder())
    langs, prototypes = learn(docs, modulus, held_out, **options)

    def predicted(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                v = unit(encoder.vectors(part.column("text").to_pylist()))
                near = v @ prototypes.T if langs else np.zeros((len(v), 1), np.float32)
                best, some = near.argmax(axis=1), v.any(axis=1) & bool(langs)
                name = [langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.clip(near[np.arange(len(v)), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    return map_batches(base, predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
