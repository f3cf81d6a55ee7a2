"""Labels of documents, any number each: one-vs-rest logistic regression by mini-batches.

Words are hashed into `size` features, so that the model's size depends on `size`
and the number of labels alone.  Rows are dealt into BUCKETS by the hash of their
key, each a folder; a step reads the buckets of its batch only, every task sums the
gradient of its rows, and the sums are added in two steps.  Batches grow from epoch
to epoch, and each epoch goes through all rows in another order of buckets.  After
each epoch the micro-averaged F1 on the validation rows is taken; the best weights
stay and are written whenever they improve, and training ends when they haven't for
some epochs.

Documents: a key, words (array of strings) and labels (array of strings).  Null
words and labels are none; a label counts once in a document; documents without
words have the bias alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import map_batches, staged

#: Folders of rows: the smallest batch is one of them.
BUCKETS = 64
#: Partial sums that come to the driver in a step.
SUMS = 8
#: Weights of a model at most: it is held by the driver and every worker.
MOST_WEIGHTS = 16_000_000
#: Rows of a file.
FILE_ROWS = 2_000_000


@dataclass
class Model:
    """labels; weights: a row for each feature and a last one for the bias, a column for each label."""

    labels: list[str]
    size: int
    weights: np.ndarray = None
    history: list[dict] = field(default_factory=list)  # epoch, batches, loss, precision, recall, f1, best

    def __post_init__(self):
        if (self.size + 1) * len(self.labels) > MOST_WEIGHTS:
            raise ValueError(f"{len(self.labels)} labels of {self.size} features; at most {MOST_WEIGHTS} weights are handled")
        if self.weights is None:
            self.weights = np.zeros((self.size + 1, len(self.labels)))

    def probabilities(self, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """Of every label for each row of features."""
        return 1 / (1 + np.exp(-np.clip(_products(self.weights, places, values), -30, 30)))

    def write(self, spark: SparkSession, path: str) -> None:
        """As a Parquet table of the weights that aren't 0, and one of the labels."""
        place = np.flatnonzero(self.weights)
        spark.createDataFrame(pa.table({"place": place, "weight": self.weights.ravel()[place]})).write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(k, x, self.size) for k, x in enumerate(self.labels)], "k int, label string, size int").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        named = sorted(spark.read.parquet(f"{path}/labels").collect())
        out = cls([r["label"] for r in named], named[0]["size"])
        rows = spark.read.parquet(f"{path}/weights").toPandas()
        out.weights.ravel()[rows["place"].to_numpy()] = rows["weight"].to_numpy()
        return out


def hashed(words: list[str | None] | None, size: int) -> tuple[list[int], list[float]]:
    """Places and values of a document's features: damped counts of its words, of length 1."""
    counts: dict[int, int] = {}
    for w in words or []:
        if w is not None:
            place = zlib.crc32(w.encode()) % size
            counts[place] = counts.get(place, 0) + 1
    places = sorted(counts)
    values = np.log1p([counts[p] for p in places])
    return places, (values / max(np.linalg.norm(values), 1e-12)).tolist()


def _products(weights: np.ndarray, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    out = np.tile(weights[-1], (len(places), 1))
    sizes = [len(p) for p in places]
    if sum(sizes):
        rows = np.repeat(np.arange(len(places)), sizes)
        np.add.at(out, rows, weights[np.concatenate(places)] * np.concatenate(values)[:, None])
    return out


def _features(docs: DataFrame, key: list[str], words: str, labels: str, names: list[str], size: int, seed: int) -> DataFrame:
    """key (a hash), places, values, y (places of labels)."""
    index = {x: i for i, x in enumerate(names)}

    def run(batches):
        for batch in batches:
            both = [hashed(w, size) for w in batch.column("words").to_pylist()]
            y = [sorted({index[x] for x in found or [] if x in index}) for found in batch.column("labels").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([b[0] for b in both], pa.list_(pa.int32())), pa.array([b[1] for b in both], pa.list_(pa.float64())), pa.array(y, pa.list_(pa.int32()))], names=["key", "places", "values", "y"])

    rows = docs.select(F.xxhash64(F.lit(seed), *key).alias("key"), F.col(words).cast("array<string>").alias("words"), F.col(labels).cast("array<string>").alias("labels"))
    return map_batches(rows, run, "key bigint, places array<int>, values array<double>, y array<int>")


def _targets(column: pa.Array, n_labels: int) -> np.ndarray:
    out = np.zeros((len(column), n_labels))
    for i, found in enumerate(column.to_pylist()):
        out[i, found] = 1
    return out


def _rows_of(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.array(p, np.int64) for p in batch.column("places").to_pylist()], [np.array(v, float) for v in batch.column("values").to_pylist()]


def gradient(rows: DataFrame, model: Model) -> tuple[np.ndarray, float, int]:
    """Sum over rows of the gradient of the log loss, of the loss, and the number of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # MOST_WEIGHTS at most
    size, k = model.size, len(model.labels)

    def packed(total: np.ndarray, loss: float, n: int, part: int) -> pa.RecordBatch:
        touched = np.flatnonzero(total.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([touched.astype("<i8").tobytes()], pa.binary()), pa.array([total[touched].astype("<f8").tobytes()], pa.binary()), pa.array([loss]), pa.array([n], pa.int64())], names=["part", "places", "sums", "loss", "n"])

    def run(batches):
        now = sent.value
        total, loss, n = np.zeros_like(now.weights), 0.0, 0
        for batch in batches:
            places, values = _rows_of(batch)
            p, y = now.probabilities(places, values), _targets(batch.column("y"), k)
            off = p - y
            loss -= float((y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12))).sum())
            sizes = [len(x) for x in places]
            if sum(sizes):
                np.add.at(total, np.concatenate(places), off[np.repeat(np.arange(len(places)), sizes)] * np.concatenate(values)[:, None])
            total[-1] += off.sum(axis=0)
            n += len(y)
        task = TaskContext.get()
        if n:
            yield packed(total, loss, n, task.partitionId() if task else 0)

    def added(tables):
        total, loss, n = np.zeros((size + 1, k)), 0.0, 0
        for r in tables.sort_values("part").itertuples():
            total[np.frombuffer(r.places, "<i8")] += np.frombuffer(r.sums, "<f8").reshape(-1, k)
            loss, n = loss + r.loss, n + r.n
        return packed(total, loss, n, 0).to_pandas()

    schema = "part int, places binary, sums binary, loss double, n bigint"
    parts = map_batches(rows.select("places", "values", "y"), run, schema)
    found = parts.groupBy((F.col("part") % SUMS).alias("some")).applyInPandas(lambda key, t: added(t).assign(some=int(key[0])), f"{schema}, some int").toPandas()
    sent.unpersist()
    total, loss, n = np.zeros((size + 1, k)), 0.0, 0
    for r in found.sort_values("some").itertuples():
        total[np.frombuffer(r.places, "<i8")] += np.frombuffer(r.sums, "<f8").reshape(-1, k)
        loss, n = loss + r.loss, n + r.n
    return total, loss, n


def _scored(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    """label, precision, recall, f1, documents by label, and over all labels with label null."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names, k = model.labels, len(model.labels)

    def run(batches):
        counts = np.zeros((3, k), np.int64)
        for batch in batches:
            guess, y = sent.value.probabilities(*_rows_of(batch)) >= threshold, _targets(batch.column("y"), k) > 0
            counts += np.array([(guess & y).sum(axis=0), guess.sum(axis=0), y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c) for c in counts)], names=["label", "hit", "guessed", "documents"])

    found = map_batches(rows.select("places", "values", "y"), run, "label string, hit bigint, guessed bigint, documents bigint")
    found = found.rollup("label").agg(*(F.sum(c).alias(c) for c in ("hit", "guessed", "documents")))
    precision, recall = (F.col("hit") / F.greatest(F.col(c), F.lit(1)) for c in ("guessed", "documents"))
    return found.select("label", precision.alias("precision"), recall.alias("recall"), (2 * F.col("hit") / F.greatest(F.col("guessed") + F.col("documents"), F.lit(1))).alias("f1"), "documents")


def evaluated(docs: DataFrame, model: Model, words: str, labels: str, threshold: float = 0.5) -> DataFrame:
    """label, precision, recall, f1, documents of a model on documents."""
    return _scored(_features(docs.withColumn("__k", F.lit(0)), ["__k"], words, labels, model.labels, model.size, 0), model, threshold)


def predicted(docs: DataFrame, model: Model, words: str, threshold: float = 0.5) -> DataFrame:
    """docs with predicted (labels of probability `threshold` or more, by name), best (the likeliest label) and probability (of it)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = "predicted array<string>, best string, probability double"

    def run(batches):
        now = sent.value
        names = np.array(now.labels, object)
        for batch in batches:
            both = [hashed(w, now.size) for w in batch.column("__words").to_pylist()]
            p = now.probabilities([np.array(b[0], np.int64) for b in both], [np.array(b[1], float) for b in both])
            best = p.argmax(axis=1) if p.shape[1] else None
            plain = batch.drop_columns(["__words"])
            columns = [pa.array([sorted(names[x >= threshold]) for x in p], pa.list_(pa.string())), pa.array(names[best] if best is not None else [None] * len(p), pa.string()), pa.array(p[np.arange(len(p)), best] if best is not None else [None] * len(p), pa.float64())]
            yield pa.RecordBatch.from_arrays([*plain.columns, *columns], names=[*plain.schema.names, "predicted", "best", "probability"])

    rows = docs.withColumn("__words", F.col(words).cast("array<string>"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(rows, run, f"{kind}, {added}")


def train(docs: DataFrame, valid: DataFrame, key: list[str], words: str, labels: str, epochs: int = 4, size: int = 1 << 15, rate: float = 1.0, decay: float = 1e-6, first_batch: int = 4, last_batch: int = 16, patience: int = 2, least_gain: float = 1e-4, threshold: float = 0.5, seed: int = 42, path: str | None = None) -> Model:
    """The best model by micro-averaged F1 on `valid`, with its history.

    first_batch, last_batch: buckets of a batch in the first and the last epoch.
    rate: of the steps, which are scaled by each weight's past gradients.
    path: where the best model is written each time there is a better one.
    """
    spark = docs.sparkSession
    names = sorted(r[0] for r in docs.select(F.explode(F.col(labels).cast("array<string>")).alias("label")).where("label is not null").distinct().limit(MOST_WEIGHTS // (size + 1) + 1).collect())
    model = best = Model(names, size)  # refuses more labels than weights allow
    if not names:
        return best
    rows = _features(docs, key, words, labels, names, size, seed).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(BUCKETS)).cast("int"))
    n = docs.count()
    piece = F.pmod(F.xxhash64(F.lit(seed + 2), "key"), F.lit(max(1, n // (BUCKETS * FILE_ROWS))))
    rows = staged(rows.repartition(BUCKETS * max(1, n // (BUCKETS * FILE_ROWS)), "bucket", piece), "buckets", by=["bucket"])
    held = staged(_features(valid, key, words, labels, names, size, seed), "validation")
    past, top, bad = np.full_like(model.weights, 1e-8), -1.0, 0
    for epoch in range(epochs):
        width = round(first_batch * (last_batch / first_batch) ** (epoch / max(epochs - 1, 1)))
        order = np.random.default_rng(seed + epoch).permutation(BUCKETS).tolist()
        weights, loss, seen = model.weights.copy(), 0.0, 0
        for start in range(0, BUCKETS, width):
            total, part, m = gradient(rows.where(F.col("bucket").isin(order[start : start + width])), Model(names, size, weights))
            loss, seen = loss + part, seen + m
            if m:
                g = total / m + decay * weights
                past += g * g
                weights = weights - rate * g / np.sqrt(past)
        model = Model(names, size, weights)
        score = _scored(held, model, threshold).where("label is null").first()
        f1 = score["f1"] if score else 0.0
        better = f1 > top + least_gain
        line = {"epoch": epoch + 1, "batches": -(-BUCKETS // width), "loss": loss / max(seen, 1), "precision": score["precision"] if score else 0.0, "recall": score["recall"] if score else 0.0, "f1": f1, "best": better}
        if better:
            model.history, best, top, bad = [*best.history, line], model, f1, 0
            if path:
                best.write(spark, path)
        else:
            best.history.append(line)
            bad += 1
            if bad >= patience:
                break
    return best
