"""Entities of record texts: extraction, normalisation, encoding, wide and tall tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import listlike, split_last_and
from ..functions.text import normalized, raw_text, strip
from ..functions.tokens import head_words
from ..storage import map_batches, staged
from .spread import spread_join
from .tagging import Tagger

#: The label of entities.
LABEL = "INGREDIENT"


def whole_item(item: Column) -> Column:
    """The default extractor: the item is one entity."""
    return F.array(F.struct(item.alias("raw"), F.lit(0).alias("start"), F.length(item).alias("end"), F.lit(LABEL).alias("label")))


_LOADED: dict[str, object] = {}


class BatchExtractor:
    """An extractor whose model works on lists of texts: load() makes it once in a worker, its spans(texts) gives (start, end, label) lists.

    A text without span is one entity, as for whole_item.
    """

    def __init__(self, load: Callable[[], object]):
        self.load, self.name = load, uuid.uuid4().hex

    def model(self):
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]

    def found(self, items: DataFrame) -> DataFrame:
        """item, entities of a table of distinct items."""

        def run(batches):
            model = self.model()
            for batch in batches:
                texts = batch.column("item").to_pylist()
                rows = [[{"raw": t[a:b], "start": a, "end": b, "label": x} for a, b, x in spans] or [{"raw": t, "start": 0, "end": len(t), "label": LABEL}] for t, spans in zip(texts, model.spans(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(rows, pa.list_(pa.struct([("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))], names=["item", "e"])

        return map_batches(items.select("item"), run, "item string, e array<struct<raw:string,start:int,end:int,label:string>>")


def tagged(spark, tagger: Tagger) -> BatchExtractor:
    """A trained tagger as an extractor: each worker gets it once."""
    sent = spark.sparkContext.broadcast(tagger)  # of bounded size
    return BatchExtractor(lambda: sent.value)


def tall(df: DataFrame, key: str, text: str, mapping: DataFrame, encoder: DataFrame, extractor: Callable[[Column], Column] | BatchExtractor = whole_item) -> DataFrame:
    """row_id, pos, ent_text, start, end, label, norm, canonical, id: one row for every entity.

    A batch extractor sees each distinct item once; what it finds is joined back.

    Items are parsed and the last one cut at " and "; the normalised name falls
    back on the item itself; names are looked up in mapping (key, value) and
    encoder (token, id), unknown ones have id 0.  Both joins are on distinct
    names' columns, so small tables are broadcast by the planner.
    """
    items = F.filter(F.transform(split_last_and(listlike(F.col(text))), raw_text), lambda x: x != "")
    rows = df.select(F.col(key).alias("row_id"), F.posexplode(items).alias("pos", "item"))
    if isinstance(extractor, BatchExtractor):
        rows = staged(rows, "items")
        rows = spread_join(rows, extractor.found(rows.select("item").distinct()), "item", "row_id").select("row_id", "pos", F.posexplode("e").alias("nth", "e"))
    else:
        rows = rows.select("row_id", "pos", F.posexplode(extractor(F.col("item"))).alias("nth", "e"))
    rows = rows.select("row_id", "pos", "nth", F.col("e.raw").alias("ent_text"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.label").alias("label"))
    rows = rows.withColumn("norm", normalized(F.coalesce(head_words(F.col("ent_text")), F.col("ent_text"))))
    side = mapping.groupBy(normalized(F.col("key")).alias("__k")).agg(F.max(normalized(F.col("value"))).alias("__v"))
    rows = rows.join(side, F.col("norm") == F.col("__k"), "left").withColumn("canonical", F.coalesce("__v", "norm")).drop("__k", "__v")
    ids = encoder.select(F.col("token").alias("__t"), F.col("id").cast("bigint").alias("id"))
    return rows.join(ids, F.col("canonical") == F.col("__t"), "left").withColumn("id", F.coalesce("id", F.lit(0).cast("bigint"))).drop("__t")


def wide(df: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """row_id, text, NER_raw, NER_clean (distinct), spans_json, Ingredients (ids, not distinct), also for rows without entity.

    Column names are compared in any case, so the ids are encoded_ingredients where the text column is called ingredients.
    """
    ids = "encoded_ingredients" if text.lower() == "ingredients" else "Ingredients"
    span = F.struct("pos", "nth", "ent_text", "start", "end", "label", "norm", "canonical", "id")
    lists = entities.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("s"))
    out = df.select(F.col(key).alias("row_id"), F.col(text)).join(lists, "row_id", "left").withColumn("s", F.coalesce("s", F.from_json(F.lit("[]"), lists.schema["s"].dataType)))
    spans = F.transform("s", lambda x: F.struct(x["ent_text"].alias("raw"), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["norm"].alias("norm"), x["canonical"].alias("canonical"), x["id"].alias("id")))
    return out.select("row_id", text, F.col("s.ent_text").alias("NER_raw"), F.array_distinct("s.canonical").alias("NER_clean"), F.to_json(spans).alias("spans_json"), F.col("s.id").alias(ids))


def attached(records: DataFrame, wide_rows: DataFrame, key: str) -> DataFrame:
    """records with NER_clean and Ingredients as inferred_ingredients and encoded_ingredients, by row key; empty lists where a record has none."""
    lists = wide_rows.select(F.col("row_id").alias("__row"), F.col("NER_clean").alias("inferred_ingredients"), F.col("Ingredients").alias("encoded_ingredients"))
    out = records.join(lists, F.col(key) == F.col("__row"), "left").drop("__row")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.withColumns({"inferred_ingredients": none("inferred_ingredients", "array<string>"), "encoded_ingredients": none("encoded_ingredients", "array<bigint>")})


def diagnostics(wide_rows: DataFrame) -> DataFrame:
    """zero_id_share, single_id_share: shares of ids that are 0, and of rows with one id."""
    column = "encoded_ingredients" if "encoded_ingredients" in wide_rows.columns else "Ingredients"
    ids = F.sum(F.size(column))
    zero = F.sum(F.size(F.filter(column, lambda x: x == 0)))
    return wide_rows.agg((zero / F.greatest(ids, F.lit(1))).alias("zero_id_share"), F.avg((F.size(column) == 1).cast("double")).alias("single_id_share"))


def described(wide_rows: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows, rows with a prediction and mean list size; and the most frequent names."""
    counts = wide_rows.agg(F.count("*").alias("rows"), F.count_if(F.size("NER_clean") > 0).alias("with_prediction"), F.avg(F.size("NER_clean")).alias("mean_size"))
    names = wide_rows.select(F.explode("NER_clean").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return counts, names


def _split(key: str, seed: int, valid: float) -> Column:
    """"valid" for a share of the documents, by the digest of their key and place; "train" for the others."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("pos").cast("string")))
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.when(at < int(valid * (1 << 32)), "valid").otherwise("train").alias("split")


def training_documents(df: DataFrame, key: str, items: str, seed: int = 42, valid: float = 0.2) -> DataFrame:
    """text, start, end, label, split: each item as a document that is one entity; the split is by hash."""
    rows = df.select(key, F.posexplode(items).alias("pos", "text")).withColumn("text", strip(F.col("text"))).where("text <> ''")
    return rows.select(key, "pos", "text", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(LABEL).alias("label"), _split(key, seed, valid))


def with_spans(docs: DataFrame) -> DataFrame:
    """training_documents with its entity as a list of spans, as a tagger learns from."""
    return docs.withColumn("spans", F.array(F.struct("start", "end", "label"))).drop("start", "end", "label")


def classifier_documents(df: DataFrame, key: str, items: str, label: str, labels: DataFrame, seed: int = 42, valid: float = 0.2) -> DataFrame:
    """As training_documents, with the record's label, for records whose label is in labels."""
    rows = df.join(labels.select(label).distinct(), label, "left_semi").select(key, label, F.posexplode(items).alias("pos", "text")).withColumn("text", strip(F.col("text"))).where("text <> ''")
    return rows.withColumn("split", _split(key, seed, valid))
