"""The span tagger and the multi-label classifier against plain versions of their parts, and what they learn."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import entities, multilabel, tagging

SPAN_DOCS = "k bigint, text string, spans array<struct<start:int,end:int,label:string>>"
LABEL_DOCS = "k bigint, words array<string>, labels array<string>"


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_finds_the_best_of_all_sequences(seed):
    rng = np.random.default_rng(seed)
    n, k = 5, 5
    emissions, moves = rng.normal(size=(n, k)), rng.normal(size=(k + 1, k)) + np.where(tagging.allowed(k), 0, -np.inf)

    def score(tags):
        return sum(moves[a, b] + emissions[i, b] for i, (a, b) in enumerate(zip((k, *tags[:-1]), tags, strict=True)))

    assert tuple(tagging.viterbi(emissions, moves)) == max(itertools.product(range(k), repeat=n), key=score)
    assert tagging.viterbi(np.zeros((0, k)), moves).tolist() == []


def test_spans_and_tags_are_the_same_thing():
    text = "two fresh eggs, olive oil (extra virgin)"
    found = tagging.tokens(text)
    spans = [(4, 14, "FOOD"), (16, 25, "FOOD"), (27, 39, "GRADE")]
    labels = ["FOOD", "GRADE"]
    tags = tagging.tags_of(found, spans, labels)
    assert tagging.spans_of(found, tags, labels) == spans
    assert tagging.tags_of(found, [(4, 14, "FOOD"), (10, 25, "FOOD"), (0, 3, "OTHER")], labels).tolist()[:3] == [0, 1, 2]
    assert tagging.tokens(None) == [] and tagging.features([], 8).shape[0] == 0


def span_docs(n, seed=1):
    """Amounts and foods: which word is which shows by place and word."""
    rng = random.Random(seed)
    foods, sizes, out = ["red onion", "garlic", "olive oil", "black bean soup"], ["cup", "spoon", "pinch"], []
    for i in range(n):
        food, size = rng.choice(foods), f"{rng.randint(1, 9)} {rng.choice(sizes)}"
        text, spans = (f"{size} of {food}", [(0, len(size), "AMOUNT"), (len(size) + 4, len(size) + 4 + len(food), "FOOD")]) if rng.random() < 0.5 else (f"{food}: {size}", [(0, len(food), "FOOD"), (len(food) + 2, len(food) + 2 + len(size), "AMOUNT")])
        out.append((i, text, spans))
    return out


def test_tagger_learns_and_saves_its_best(spark, tmp_path):
    docs = spark.createDataFrame(span_docs(300), SPAN_DOCS)
    odd = spark.createDataFrame([(900, None, None), (901, "", []), (902, "!!", [(0, 2, None)])], SPAN_DOCS)
    train, valid = docs.where("k < 200").union(odd), docs.where("k >= 200")
    path = f"file://{tmp_path}/tagger"
    tagger = tagging.train(train, valid, ["k"], epochs=6, part_rows=40, size=1 << 12, path=path)
    assert [h["best"] for h in tagger.history][0] and tagger.history[-1]["epoch"] <= 6
    assert max(h["f1"] for h in tagger.history) == [h["f1"] for h in tagger.history if h["best"]][-1] > 0.95
    rows = {r["label"]: r for r in tagging.evaluated(valid, tagger).collect()}
    assert rows[None]["f1"] == [h["f1"] for h in tagger.history if h["best"]][-1] and rows["FOOD"]["spans"] == rows["AMOUNT"]["spans"] == 100
    again = tagging.Tagger.read(spark, path)
    assert again.labels == tagger.labels and np.array_equal(again.weights, tagger.weights)
    twice = tagging.train(train.repartition(3), valid, ["k"], epochs=6, part_rows=40, size=1 << 12)
    assert np.allclose(twice.weights, tagger.weights) and [h["f1"] for h in twice.history] == [h["f1"] for h in tagger.history]


def test_mixing_one_part_is_a_plain_perceptron(spark):
    rows = span_docs(30)
    docs = spark.createDataFrame(rows, SPAN_DOCS)
    tagger = tagging.train(docs, docs, ["k"], epochs=1, size=1 << 10)
    hashes = {r["k"]: (r["o"], r["h"]) for r in docs.select("k", F.xxhash64(F.lit(42), "k").alias("h")).select("k", "h", F.xxhash64(F.lit(0), "h").alias("o")).collect()}
    model, total = tagging.Tagger(tagger.labels, 1 << 10), np.zeros_like(tagger.weights)
    for _, text, spans in sorted(rows, key=lambda r: hashes[r[0]]):
        found = tagging.tokens(text)
        places = tagging.features([t for _, _, t in found], 1 << 10)
        gold, guess = tagging.tags_of(found, spans, model.labels), model.tag(places)
        for tags, sign in ((gold, 1), (guess, -1)):
            for i, tag in enumerate(tags):
                for p in places[i]:
                    model.weights[p, tag] += sign
                model.weights[(1 << 10) + (tags[i - 1] if i else model.n_tags), tag] += sign
        total += model.weights
    assert np.allclose(tagger.weights, total / 30)


def test_training_ends_when_nothing_improves_and_without_labels(spark):
    docs = spark.createDataFrame(span_docs(40), SPAN_DOCS)
    tagger = tagging.train(docs, docs, ["k"], epochs=30, patience=2, size=1 << 12)
    assert len(tagger.history) < 30 and [h["best"] for h in tagger.history][-2:] == [False, False]
    assert tagging.train(docs.limit(0), docs, ["k"]).history == []
    assert len(tagging.train(docs, docs, ["k"], epochs=1, most=10, size=1 << 10).history) == 1


def test_extractors_work_by_batch_and_keep_items_without_span(spark):
    docs = spark.createDataFrame(span_docs(200), SPAN_DOCS)
    tagger = tagging.train(docs, docs, ["k"], epochs=5, size=1 << 12)
    records = spark.createDataFrame([(1, "['2 cup of garlic', 'plainly nothing here']"), (2, "['2 cup of garlic']"), (3, None), *((i, "['olive oil: 3 pinch']") for i in range(4, 600))], "row bigint, items string")
    none = spark.createDataFrame([], "key string, value string"), spark.createDataFrame([], "id bigint, token string")

    class Plain:
        def spans(self, texts):
            return [[] if "nothing" in t else s for t, s in zip(texts, tagger.spans(texts), strict=True)]

    plain = Plain()
    found = entities.tall(records, "row", "items", *none, entities.BatchExtractor(lambda: plain)).collect()
    names = {(r["row_id"], r["pos"]): [] for r in found}
    for r in sorted(found, key=lambda r: r["start"]):
        names[r["row_id"], r["pos"]].append((r["ent_text"], r["label"]))
    assert names[1, 0] == names[2, 0] == [("2 cup", "AMOUNT"), ("garlic", "FOOD")]
    assert names[1, 1] == [("plainly nothing here", entities.LABEL)]
    assert all(names[i, 0] == [("olive oil", "FOOD"), ("3 pinch", "AMOUNT")] for i in range(4, 600)) and len(names) == 599
    assert {(r["row_id"], r["ent_text"]) for r in entities.tall(records.where("row = 2"), "row", "items", *none, entities.tagged(spark, tagger)).collect()} == {(2, "2 cup"), (2, "garlic")}


def label_docs(n, seed=1):
    rng = random.Random(seed)
    about = {"sweet": ["sugar", "honey", "syrup"], "sour": ["lemon", "vinegar"], "hot": ["chili", "pepper"]}
    out = []
    for i in range(n):
        labels = [x for x in about if rng.random() < 0.5]
        out.append((i, [rng.choice(about[x]) for x in labels] + rng.choices(["cup", "bowl", "plate"], k=3), labels))
    return out


def test_gradient_is_the_sum_over_rows(spark):
    rows = label_docs(60)
    docs = spark.createDataFrame(rows, LABEL_DOCS)
    names, size = ["hot", "sour", "sweet"], 64
    rng = np.random.default_rng(2)
    model = multilabel.Model(names, size, rng.normal(size=(size + 1, 3)))
    total, loss, n = multilabel.gradient(multilabel._features(docs.repartition(5), ["k"], "words", "labels", names, size, 1), model)
    want, cost = np.zeros((size + 1, 3)), 0.0
    for _, words, labels in rows:
        x = np.zeros(size + 1)
        places, values = multilabel.hashed(words, size)
        x[places], x[-1] = values, 1
        y, p = np.array([a in labels for a in names], float), 1 / (1 + np.exp(-x @ model.weights))
        want += np.outer(x, p - y)
        cost -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    assert n == 60 and np.allclose(total, want) and abs(loss - cost) < 1e-8


def test_classifier_learns_several_labels_and_saves_its_best(spark, tmp_path):
    docs = spark.createDataFrame(label_docs(400), LABEL_DOCS)
    odd = spark.createDataFrame([(900, None, None), (901, [], ["hot", "hot", None]), (902, [None, "sugar"], [])], LABEL_DOCS)
    train, valid = docs.where("k < 300").union(odd), docs.where("k >= 300")
    path = f"file://{tmp_path}/labels"
    model = multilabel.train(train, valid, ["k"], "words", "labels", epochs=4, size=1 << 12, path=path)
    assert [h["batches"] for h in model.history] == sorted((h["batches"] for h in model.history), reverse=True) and model.history[0]["batches"] == 16
    best = [h for h in model.history if h["best"]][-1]
    assert best["f1"] == max(h["f1"] for h in model.history) > 0.95
    rows = {r["label"]: r for r in multilabel.evaluated(valid, model, "words", "labels").collect()}
    assert abs(rows[None]["f1"] - best["f1"]) < 1e-12 and set(rows) == {None, "hot", "sour", "sweet"}
    again = multilabel.Model.read(spark, path)
    assert again.labels == model.labels and np.array_equal(again.weights, model.weights)
    found = multilabel.predicted(valid, model, "words").collect()
    assert sum(sorted(r["labels"]) == r["predicted"] for r in found) > 90 and all(0 <= r["probability"] <= 1 for r in found)
    twice = multilabel.train(train.repartition(3), valid, ["k"], "words", "labels", epochs=4, size=1 << 12)
    assert np.allclose(twice.weights, model.weights)


def test_classifier_without_labels_and_with_too_many(spark):
    docs = spark.createDataFrame(label_docs(10), LABEL_DOCS)
    model = multilabel.train(docs.limit(0), docs, ["k"], "words", "labels")
    assert model.labels == [] and multilabel.predicted(docs, model, "words").where("best IS NULL AND size(predicted) = 0").count() == 10
    with pytest.raises(ValueError, match="weights"):
        multilabel.Model([str(i) for i in range(600)], 1 << 15)
