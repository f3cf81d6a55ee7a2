"""Span tagging by a structured perceptron, trained by iterative parameter mixing.

Texts are cut into tokens, whose tags say where spans begin (B), go on (I) or
aren't (O); Viterbi decoding finds the best allowed sequence of tags.  Weights lie
in a table of `size` hashed features, so that the model's size doesn't depend on
the texts.

Training documents are dealt into parts of a fixed number of rows.  Each epoch
every part makes one pass from common weights, in an order of its own; the parts'
changes are averaged (iterative parameter mixing), and averaged over the pass for
the model that is measured.  The best model by span F1 on the validation
documents stays and is saved whenever it improves; training ends when it hasn't
improved for some epochs.  Parts, orders and sums don't depend on the cluster, so
reruns agree up to the rounding of sums.

Documents: a key, text, and spans (array of start, end, label; code points, end
exclusive).  Null texts have no tokens; spans of no token are unreachable and count
as missed, spans without a label aren't any.  Of overlapping spans the one that begins first has the tokens.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import map_batches, staged

#: Training documents of a part.
PART_ROWS = 20_000
SPANS = "array<struct<start:int,end:int,label:string>>"

_TOKEN = re.compile(r"\w+|[^\w\s]")


def tokens(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, token) of words and signs."""
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text or "")]


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token))


def features(words: list[str], size: int) -> np.ndarray:
    """Hashed features of every token, a row each: the word, its ends and shape, its neighbours."""
    low = [w.lower() for w in words]
    out = []
    for i, w in enumerate(low):
        before, after = low[i - 1] if i else "<", low[i + 1] if i + 1 < len(low) else ">"
        named = ("b", f"w={w}", f"p={w[:3]}", f"s={w[-3:]}", f"h={_shape(words[i])}", f"l={before}", f"r={after}", f"lw={before} {w}", f"wr={w} {after}", f"l2={low[i - 2] if i > 1 else '<'}")
        out.append([zlib.crc32(n.encode()) % size for n in named])
    return np.array(out, np.int64).reshape(len(words), 10)


def tags_of(found: list[tuple[int, int, str]], spans, labels: list[str]) -> np.ndarray:
    """Tags of tokens: 0, then 2k + 1 where a span of label k begins and 2k + 2 where it goes on."""
    out = np.zeros(len(found), np.int64)
    taken = -1
    for start, end, label in sorted((s[0], s[1], s[2]) for s in spans if s[2] in labels):
        inside = [i for i, (a, b, _) in enumerate(found) if a < end and b > start and i > taken]
        for n, i in enumerate(inside):
            out[i] = 2 * labels.index(label) + (1 if n == 0 else 2)
        taken = inside[-1] if inside else taken
    return out


def spans_of(found: list[tuple[int, int, str]], tags, labels: list[str]) -> list[tuple[int, int, str]]:
    out: list[list] = []
    for (a, b, _), tag in zip(found, tags, strict=True):
        if tag % 2:
            out.append([a, b, labels[tag // 2]])
        elif tag:
            out[-1][1] = b
    return [tuple(s) for s in out]


def allowed(n_tags: int) -> np.ndarray:
    """From each tag (the last row: the beginning) to each: whether it may follow."""
    ok = np.ones((n_tags + 1, n_tags), bool)
    for tag in range(2, n_tags, 2):
        ok[:, tag] = False
        ok[[tag - 1, tag], tag] = True
    return ok


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tags of the greatest sum of emissions (tokens x tags) and moves (tags and the beginning x tags); of equal ones the least tag at the last difference."""
    n, k = emissions.shape
    if not n:
        return np.zeros(0, np.int64)
    best, back = moves[-1] + emissions[0], np.zeros((n, k), np.int64)
    for i in range(1, n):
        ways = best[:, None] + moves[:-1]
        back[i] = ways.argmax(axis=0)
        best = ways[back[i], np.arange(k)] + emissions[i]
    out = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        out.append(int(back[i][out[-1]]))
    return np.array(out[::-1])


@dataclass
class Tagger:
    """labels; weights: one row for each hashed feature, then one for each tag before and one for the beginning."""

    labels: list[str]
    size: int
    weights: np.ndarray = None
    history: list[dict] = field(default_factory=list)  # epoch, precision, recall, f1, best

    def __post_init__(self):
        self.n_tags = 2 * len(self.labels) + 1
        if self.weights is None:
            self.weights = np.zeros((self.size + self.n_tags + 1, self.n_tags))
        self.barred = np.where(allowed(self.n_tags), 0.0, -np.inf)

    def tag(self, places: np.ndarray) -> np.ndarray:
        return viterbi(self.weights[places].sum(axis=1), self.weights[self.size :] + self.barred)

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, label) of every text."""
        out = []
        for text in texts:
            found = tokens(text)
            out.append(spans_of(found, self.tag(features([t for _, _, t in found], self.size)), self.labels))
        return out

    def write(self, spark: SparkSession, path: str) -> None:
        """As a Parquet table of the weights that aren't 0, and one of the labels."""
        place = np.flatnonzero(self.weights)
        spark.createDataFrame(pa.table({"place": place, "weight": self.weights.ravel()[place]})).write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(k, x, self.size) for k, x in enumerate(self.labels)], "k int, label string, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Tagger:
        named = sorted(spark.read.parquet(f"{path}/labels").collect())
        out = cls([r["label"] for r in named], named[0]["size"])
        rows = spark.read.parquet(f"{path}/weights").toPandas()
        out.weights.ravel()[rows["place"].to_numpy()] = rows["weight"].to_numpy()
        return out


class _Pass:
    """One part's pass: weights, and for averaging the sums of changes times when they were made."""

    def __init__(self, start: Tagger):
        self.model = Tagger(start.labels, start.size, start.weights.copy())
        self.late = np.zeros_like(start.weights)
        self.seen, self.touched = 0, set()

    def learn(self, places: np.ndarray, gold: np.ndarray) -> None:
        guess = self.model.tag(places)
        if (guess != gold).any():
            for tags, sign in ((gold, 1.0), (guess, -1.0)):
                rows = np.concatenate([places.ravel(), self.model.size + np.concatenate([[self.model.n_tags], tags[:-1]])])
                columns = np.concatenate([np.repeat(tags, places.shape[1]), tags])
                np.add.at(self.model.weights, (rows, columns), sign)
                np.add.at(self.late, (rows, columns), sign * self.seen)
                self.touched.update((rows * self.model.n_tags + columns).tolist())
        self.seen += 1

    def changes(self, start: np.ndarray) -> pa.RecordBatch:
        """place, last, mean: what the pass changed at its end, and on average over its documents."""
        place = np.array(sorted(self.touched), np.int64)
        last = self.model.weights.ravel()[place] - start.ravel()[place]
        mean = last - self.late.ravel()[place] / max(self.seen, 1)
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(last), pa.array(mean)], names=["place", "last", "mean"])


def _passes(docs: DataFrame, model: Tagger, epoch: int, parts: int) -> DataFrame:
    """Sum over all parts of what their passes change, by place."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of `size` rows

    def run(batches):
        start, now, part = sent.value, None, None
        for batch in batches:
            for p, text, spans in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "spans")), strict=True):
                if p != part:
                    if now is not None:
                        yield now.changes(start.weights)
                    now, part = _Pass(start), p
                found = tokens(text)
                if found:
                    gold = [(s["start"], s["end"], s["label"]) for s in spans or [] if s["label"] is not None]
                    now.learn(features([t for _, _, t in found], start.size), tags_of(found, gold, start.labels))
        if now is not None:
            yield now.changes(start.weights)

    dealt = docs.repartition(parts, "part").sortWithinPartitions("part", F.xxhash64(F.lit(epoch), "key"), "key")
    changes = map_batches(dealt.select("part", "text", "spans"), run, "place bigint, last double, mean double")
    return changes.groupBy("place").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean"))


def evaluated(docs: DataFrame, model: Tagger) -> DataFrame:
    """label, precision, recall, f1, spans (of the documents) by label, and over all with label null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = []
            texts, wanted = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            for got, want in zip(sent.value.spans(texts), wanted, strict=True):
                want = {(s["start"], s["end"], s["label"]) for s in want or [] if s["label"] is not None}
                rows += [(x[2], x in want, True) for x in got] + [(x[2], x in set(got), False) for x in want]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_())], names=["label", "right", "guess"])

    found = map_batches(docs.select("text", "spans"), run, "label string, right boolean, guess boolean")
    counts = found.rollup("label").agg(F.count_if(F.col("guess") & F.col("right")).alias("hit"), F.count_if("guess").alias("guessed"), F.count_if(~F.col("guess")).alias("spans"))
    precision, recall = (F.col("hit") / F.greatest(F.col(c), F.lit(1)) for c in ("guessed", "spans"))
    return counts.select("label", precision.alias("precision"), recall.alias("recall"), (2 * F.col("hit") / F.greatest(F.col("guessed") + F.col("spans"), F.lit(1))).alias("f1"), "spans")


def train(docs: DataFrame, valid: DataFrame, key: list[str], epochs: int = 8, patience: int = 2, least_gain: float = 1e-4, size: int = 1 << 16, part_rows: int = PART_ROWS, most: int | None = None, seed: int = 42, path: str | None = None) -> Tagger:
    """The best tagger by span F1 on `valid`, with its history (epoch, precision, recall, f1, best).

    docs, valid: key columns, text, spans.  most: at most about so many training
    documents, chosen by the hash of their key (all unless given).  path: where the
    best tagger is written each time there is a better one.
    """
    spark = docs.sparkSession
    # spans stay arrays of structs; the key is one hash, ties are broken by the text
    named = docs.select(F.xxhash64(F.lit(seed), *key).alias("key"), "text", F.col("spans").cast(SPANS).alias("spans"))
    rows = staged(named, "documents")
    n = rows.count()
    if most is not None and n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(1 << 40)) < (1 << 40) * most // n)
    parts = max(1, -(-min(n, most or n) // part_rows))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "key"), F.lit(parts)).cast("int"))
    held = staged(valid.select("text", F.col("spans").cast(SPANS).alias("spans")), "validation")
    labels = sorted(r[0] for r in rows.select(F.explode("spans.label").alias("label")).where("label is not null").distinct().collect())
    model = best = Tagger(labels, size)
    if not labels:
        return best
    top, bad = -1.0, 0
    for epoch in range(epochs):
        found = _passes(rows, model, epoch, parts).toPandas()  # a row for each weight that changed: `size` times tags at most
        place = found["place"].to_numpy()
        after, mean = model.weights.copy(), model.weights.copy()
        after.ravel()[place] += found["last"].to_numpy() / parts
        mean.ravel()[place] += found["mean"].to_numpy() / parts
        now = Tagger(labels, size, mean)
        score = evaluated(held, now).where("label is null").first()
        measures = (score["precision"], score["recall"], score["f1"]) if score else (0.0, 0.0, 0.0)
        better = measures[2] > top + least_gain
        model = Tagger(labels, size, after)
        line = {"epoch": epoch + 1, "precision": measures[0], "recall": measures[1], "f1": measures[2], "best": better}
        if better:
            now.history = [*best.history, line]
            best, top, bad = now, measures[2], 0
            if path:
                best.write(spark, path)
        else:
            best.history.append(line)
            bad += 1
            if bad >= patience:
                break
    return best
