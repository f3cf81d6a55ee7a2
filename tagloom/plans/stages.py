"""The stages: each reads tables, applies operators, and writes tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, parse, text, tokens
from ..operators import dictmap, entities, labels, models, multilabel, network, order, pairs, recommend, report, similarity, tagging, vocab
from ..sources import readers, writers
from ..storage import staged
from .config import flag, required
from .runner import Context, StageResult, stage

#: The columns that number a record.
KEY = ["Dataset_ID", "index"]


def _read(ctx: Context, path: str) -> DataFrame:
    return readers.read_table(ctx.spark, ctx.config.path(path))


def _fresh(ctx: Context, df: DataFrame, where: str) -> bool:
    """Whether a table was written whole, and after all files that df reads; what is staged on the way is always new."""
    done = f"{where}/_SUCCESS"
    if not readers.exists(ctx.spark, done):
        return False
    made = readers.modified(ctx.spark, done)
    return all(readers.modified(ctx.spark, f) <= made for f in df.inputFiles())


def _write(ctx: Context, df: DataFrame, path: str) -> str:
    """Writes a stage's table; with `force: false` in the configuration, only where it is absent or older than its inputs."""
    where = ctx.config.path(path)
    if flag(ctx.config.raw.get("force"), True) or not _fresh(ctx, df, where):
        writers.parquet(df, where)
    return where


def _lists(df: DataFrame, column: str, reader=parse.listlike) -> DataFrame:
    """df with a list column whatever its cells are."""
    return df if df.schema[column].dataType.simpleString() == "array<string>" else df.withColumn(column, reader(F.col(column).cast("string")))


def _dictionary(ctx: Context, path: str | None) -> DataFrame:
    """key, value; empty where there is no file."""
    if path and readers.exists(ctx.spark, ctx.config.path(path)):
        return readers.jsonl_map(ctx.spark, ctx.config.path(path))
    return ctx.spark.createDataFrame([], "key string, value string")


def _parents(ctx: Context, path: str | None) -> DataFrame:
    if path and readers.exists(ctx.spark, ctx.config.path(path)):
        return readers.json_object(ctx.spark, ctx.config.path(path), "child", "parent")
    return ctx.spark.createDataFrame([], "child string, parent string")


@stage
def download(ctx: Context, **overrides) -> StageResult:
    """Sources are expected in raw_dir: there is no network connector."""
    cfg = ctx.config.stage("download", **overrides)
    raw = cfg.get("raw_dir") or (ctx.config.raw.get("paths") or {}).get("raw_data_dir")
    found = readers.discovered(ctx.spark, ctx.config.path(raw)) if raw and readers.exists(ctx.spark, ctx.config.path(raw)) else []
    return StageResult("download", "skipped", details={"reason": "no network connector", "sources": [p for _, p in found]})


@stage
def combine_raw(ctx: Context, **overrides) -> StageResult:
    cfg = ctx.config.stage("combine_raw", **overrides)
    folder, out = required(cfg, "combine_raw", "data_dir", "output_path")
    default = cfg.get("cuisine_default", "unknown")
    known = sorted(ctx.config.raw.get("known_labels") or []) or None
    parts, skipped = [], {}
    for number, path in readers.discovered(ctx.spark, ctx.config.path(folder), tuple(cfg.get("excluded_files") or ())):
        try:
            parts.append(readers.unified(readers.read_table(ctx.spark, path), number, default, known))
        except Exception as e:  # noqa: BLE001  a source that can't be read, or without records, is left out
            skipped[path] = str(e)
    if not parts:
        return StageResult("combine_raw", "failed", details={"error": "no source has records", "skipped": skipped})
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return StageResult("combine_raw", "success", {"combined": _write(ctx, df, out)}, {"skipped": skipped})


def _normalized(ctx: Context, name: str, lists: DataFrame, column: str, key: list[str], cfg: dict, normalise) -> StageResult:
    """Clean lists, similarity dictionary, mapped lists, encoder, encoded lists: the steps that both normalisations share."""
    steps, out = cfg.get("stages") or {}, cfg.get("output") or {}
    outputs = {}
    words = staged(lists.select(F.explode(column).alias("token")).distinct(), "words")
    clean = words.withColumn("name", normalise(F.col("token"))).where("name is not null and name <> ''")
    base = dictmap.map_lists(lists, column, clean, key, max_tokens=1_000_000, keep_unmapped=name == "ingredient_normalization")
    base = staged(base, "baseline")
    if flag(steps.get("write_parquet"), True) and out.get("baseline_parquet"):
        outputs["baseline"] = _write(ctx, base, out["baseline_parquet"])
    mapping = ctx.spark.createDataFrame([], "`from` string, `to` string")
    for step, section, default in (("sbert_dedupe", "sbert", 0.9), ("w2v_dedupe", "w2v", 0.85)):
        if not flag(steps.get(step), step == "sbert_dedupe"):
            continue
        params = cfg.get(section) or {}
        counts = staged(vocab.vocabulary(base, column, int(params.get("min_freq_for_vocab", 2))), "vocabulary")
        vectors = models.phrase_vectors(base.withColumn("__w", F.flatten(F.transform(column, lambda t: F.split(F.lower(t), r"\s+")))).withColumnRenamed("__w", "words"), "words", counts, int(params.get("vector_size", 100))) if section == "w2v" else None
        generic = lexicon.GENERIC if flag(params.get("block_generic_as_canon"), True) else ()
        mapping = similarity.dedupe_phrases(counts, float(params.get("threshold", default)), int(params.get("min_len", 1)), generic, vectors)
    mapping = staged(mapping, "mapping")
    if out.get("cosine_map_path"):
        outputs["map"] = ctx.config.path(out["cosine_map_path"])
        writers.jsonl_map(mapping, outputs["map"])
    deduped = base
    if flag(steps.get("apply_cosine_map"), True):
        names = dictmap.resolve_tokens(words.select("token").union(clean.select(F.col("name"))), dictmap.lookup_table(mapping))
        deduped = staged(dictmap.map_lists(base, column, names, key), "deduped")
        if out.get("dedup_parquet"):
            outputs["deduped"] = _write(ctx, deduped, out["dedup_parquet"])
    if flag(steps.get("encode_ids"), True):
        params = cfg.get("encoder") or {}
        encoder = staged(vocab.fit_encoder(deduped, column, key, int(params.get("min_freq", 1))), "encoder")
        for k, target in (("encoder", out.get("encoder_parquet")),):
            if target:
                outputs[k] = _write(ctx, encoder, target)
        prefix = "ingredient" if name == "ingredient_normalization" else "cuisine"
        if out.get(f"{prefix}_id_to_token") and out.get(f"{prefix}_token_to_id"):
            writers.encoder_json(encoder, ctx.config.path(out[f"{prefix}_id_to_token"]), ctx.config.path(out[f"{prefix}_token_to_id"]))
            outputs["token_to_id"] = ctx.config.path(out[f"{prefix}_token_to_id"])
        if out.get("unified_parquet"):
            encoded = vocab.encode_lists(deduped, column, encoder, key, "Ingredients", empty_as_unknown=True)
            outputs["unified"] = _write(ctx, encoded.select(F.lit(int(params.get("dataset_id", 1))).alias("Dataset ID"), F.col(key[-1]).cast("bigint").alias("Index"), "Ingredients"), out["unified_parquet"])
    return StageResult(name, "success", outputs)


@stage
def ingredient_normalization(ctx: Context, **overrides) -> StageResult:
    """Lists of the entity corpus: rule-based names, similarity dictionary, encoder.

    normalizer: "head" for a phrase's head with its compounds; otherwise the last words that count.
    """
    cfg = ctx.config.stage("ingredient_normalization", **overrides)
    path, column = required(cfg, "ingredient_normalization", "data.input_path", "data.ner_col")
    lists = staged(readers.list_column(ctx.spark, ctx.config.path(path), column).withColumn("row_id", F.monotonically_increasing_id()), "lists")
    clean = (cfg.get("output") or {}).get("list_col_for_vocab") or "NER_clean"
    lists = lists.withColumnRenamed(column, clean) if clean != column else lists
    return _normalized(ctx, "ingredient_normalization", lists, clean, ["row_id"], cfg, lambda t: (tokens.head_phrase if cfg.get("normalizer") == "head" else tokens.head_words)(text.raw_text(t)))


@stage
def cuisine_normalization(ctx: Context, **overrides) -> StageResult:
    """Labels: cut, cleaned, merged by similarity, encoded; and the records with both kinds of labels."""
    cfg = ctx.config.stage("cuisine_normalization", **overrides)
    path, column = required(cfg, "cuisine_normalization", "data.input_path", "data.cuisine_col")
    df = _read(ctx, path)
    key = [c for c in KEY if c in df.columns] or ["__row"]
    df = df if key != ["__row"] else staged(df.withColumn("__row", F.monotonically_increasing_id()), "records")
    cells = df.withColumn("cuisine_clean", parse.labels_of(F.col(column).cast("string") if df.schema[column].dataType.simpleString() != "array<string>" else F.to_json(column)))
    noise = lambda x: ~F.lower(x).isin(*lexicon.GENERIC_LABELS) & ~x.rlike(r"[\[\]{}]")
    lists = staged(cells.withColumn("cuisine_clean", F.filter("cuisine_clean", noise)), "labels")
    result = _normalized(ctx, "cuisine_normalization", lists.select(*key, "cuisine_clean"), "cuisine_clean", key, cfg, text.label_name)
    out = cfg.get("output") or {}
    target = ctx.config.artifact("cuisine_combined_encoded") or out.get("combined_parquet")
    if target:
        names = _dictionary(ctx, out.get("cosine_map_path"))
        mapped = dictmap.map_lists(lists, "cuisine_clean", names.select(F.col("key").alias("token"), F.col("value").alias("name")), key, out="cuisine_deduped", keep_unmapped=True)
        encoder = vocab.fit_encoder(mapped, "cuisine_deduped", key)
        combined = vocab.encode_lists(mapped, "cuisine_deduped", encoder, key, "cuisine_encoded").drop("cuisine_clean", "__row")
        result.outputs["combined"] = _write(ctx, combined, target)
    return result


@stage
def ingredient_ner_train(ctx: Context, **overrides) -> StageResult:
    """Training documents for an extractor, and a tagger trained on them, saved whenever its F1 on the held-out documents improves."""
    cfg = ctx.config.stage("ingredient_ner", **overrides).get("training") or {}
    ner = cfg.get("ner") or {}
    if not flag(ner.get("enabled"), True):
        return StageResult("ingredient_ner_train", "skipped")
    path, column = required(ner, "ingredient_ner_train", "train_path", "ner_list_col")
    df = _lists(_read(ctx, path).withColumn("__row", F.monotonically_increasing_id()), column)
    docs = entities.training_documents(staged(df, "corpus"), "__row", column, int(ner.get("random_seed", 42)), float(ner.get("valid_fraction", 0.2)))
    where = ctx.config.path((ner.get("out_dir") or "models/ingredient_ner") + "/documents")
    writers.shards(docs, where, int(ner.get("shard_size", 2000)))
    docs = entities.with_spans(ctx.spark.read.parquet(where))
    target = ctx.config.path(ner.get("model_dir") or (ner.get("out_dir") or "models/ingredient_ner") + "/model")
    most = ner.get("max_train_docs") or ner.get("max_rows")
    tagger = tagging.train(docs.where("split = 'train'"), docs.where("split = 'valid'"), ["__row", "pos"], epochs=int(ner.get("n_epochs", 2)), patience=int(ner.get("early_stopping_patience", 2)), most=most and int(most), seed=int(ner.get("random_seed", 42)), path=target)
    if not tagger.history:
        return StageResult("ingredient_ner_train", "success", {"documents": where}, {"epochs": 0})
    best = [h for h in tagger.history if h["best"]][-1:]
    return StageResult("ingredient_ner_train", "success", {"documents": where, **({"model": target} if best else {})}, {"epochs": len(tagger.history), **(best[0] if best else {})})


@stage
def ingredient_ner_infer(ctx: Context, extractor=None, **overrides) -> StageResult:
    """Entities of the records' texts: wide and tall tables, and the records with their names and ids.

    Found by the extractor given, else by the tagger that model.model_dir names, if it's there, else each item is one.
    """
    cfg = ctx.config.stage("ingredient_ner", **overrides).get("inference") or {}
    path, out = required(cfg, "ingredient_ner_infer", "data.input_path", "output.out_base")
    opts, art = cfg.get("inference") or {}, cfg.get("artifacts") or {}
    chosen = [k for k in ("sample_n", "sample_frac", "head_n") if opts.get(k)]
    if len(chosen) > 1:
        raise ValueError(f"ingredient_ner_infer: only one of {', '.join(chosen)} can be given")
    df = _read(ctx, path)
    df = staged(df.withColumn("__row", F.monotonically_increasing_id()), "records")
    if chosen:  # by row and hash, so that reruns on these records agree
        df = staged(order.sampled(df, "__row", head=opts.get("head_n") and int(opts["head_n"]) or None, n=opts.get("sample_n") and int(opts["sample_n"]) or None, share=opts.get("sample_frac") and float(opts["sample_frac"]) or None), "sample")
    model = (cfg.get("model") or {}).get("model_dir")
    if extractor is None and model and readers.exists(ctx.spark, ctx.config.path(model) + "/weights"):
        extractor = entities.tagged(ctx.spark, tagging.Tagger.read(ctx.spark, ctx.config.path(model)))
    encoder = ctx.spark.createDataFrame([], "id bigint, token string")
    if art.get("ingredient_token_to_id") and readers.exists(ctx.spark, ctx.config.path(art["ingredient_token_to_id"])):
        encoder = readers.json_object(ctx.spark, ctx.config.path(art["ingredient_token_to_id"]), "token", "id").selectExpr("cast(id as bigint) id", "token")
    column = opts.get("text_col", "ingredients")
    tall = staged(entities.tall(df, "__row", column, _dictionary(ctx, art.get("cosine_map_path")), encoder, extractor or entities.whole_item), "tall")
    wide = staged(entities.wide(df, "__row", column, tall), "wide")
    outputs = {"tall": _write(ctx, tall, f"{out}_tall.parquet"), "wide": _write(ctx, wide, f"{out}_wide.parquet")}
    if (cfg.get("output") or {}).get("combined_dataset"):
        both = df.join(wide.select(F.col("row_id").alias("__row"), F.col("NER_clean").alias("inferred_ingredients"), F.col(wide.columns[-1]).alias("encoded_ingredients")), "__row", "left").drop("__row")
        outputs["combined"] = _write(ctx, both, cfg["output"]["combined_dataset"])
    return StageResult("ingredient_ner_infer", "success", outputs, entities.diagnostics(wide).first().asDict())


@stage
def ingredient_post_map(ctx: Context, **overrides) -> StageResult:
    """A second dictionary over list columns, with canonical forms of plurals."""
    cfg = ctx.config.stage("ingredient_post_map", **overrides)
    if not flag(cfg.get("enabled"), True):
        return StageResult("ingredient_post_map", "skipped")
    mapping = staged(_dictionary(ctx, cfg.get("map_path")), "dictionary")
    outputs = {}
    known = mapping.select(F.explode(F.array("key", "value")).alias("t")).distinct()
    for i, target in enumerate(cfg.get("targets") or []):
        column = target["list_col"]
        df = staged(_lists(_read(ctx, target["input_path"]), column).withColumn("__row", F.monotonically_increasing_id()), "target")
        canonical = dictmap.canonical_names(df.select(F.explode(column).alias("token")), known.withColumnRenamed("t", "name"))
        canonical = staged(canonical.select(F.col("token").alias("raw"), F.col("name").alias("token")), "canonical")
        resolved = dictmap.resolve_tokens(canonical.select("token"), mapping, collapse_repeats=flag(cfg.get("collapse_duplicate_words")))
        names = canonical.join(resolved, "token").select(F.col("raw").alias("token"), "name")
        mapped = dictmap.map_lists(df, column, names, ["__row"], distinct=flag(cfg.get("dedupe_tokens"), True)).drop("__row")
        outputs[f"target_{i}"] = _write(ctx, mapped, target["output_path"])
    return StageResult("ingredient_post_map", "success", outputs)


@stage
def ingredient_encoding(ctx: Context, **overrides) -> StageResult:
    cfg = ctx.config.stage("ingredient_encoding", **overrides)
    path, out, ids = required(cfg, "ingredient_encoding", "input_path", "output_path", "ingredient_token_to_id")
    column, encoded = cfg.get("inferred_column", "inferred_ingredients"), cfg.get("encoded_column", "encoded_ingredients")
    df = staged(_lists(_read(ctx, path), column, parse.listish).withColumn("__row", F.monotonically_increasing_id()).drop(encoded), "records")
    encoder = readers.json_object(ctx.spark, ctx.config.path(ids), "token", "id").selectExpr("cast(id as bigint) id", "token")
    done = vocab.encode_lists(df, column, encoder, ["__row"], encoded, any_case=False).drop("__row")
    counts = vocab.encode_counters(done, encoded).first().asDict()
    return StageResult("ingredient_encoding", "success", {"encoded": _write(ctx, done, out)}, counts)


@stage
def cuisine_classifier(ctx: Context, **overrides) -> StageResult:
    """A classifier of labels, one document for each item; the best epoch's weights are written."""
    cfg = (ctx.config.stage("cuisine_classifier", **overrides).get("training") or {}).get("cuisine_classifier") or {}
    if not flag(cfg.get("enabled"), True):
        return StageResult("cuisine_classifier", "skipped")
    (path,) = required(cfg, "cuisine_classifier", "train_path")
    df = _read(ctx, path)
    items = readers.found_column(df.columns, ("inferred_ingredients", *lexicon.RECORD_COLUMNS), cfg.get("text_col"))
    label = readers.found_column(df.columns, ("cuisine_deduped", *lexicon.LABEL_COLUMNS), cfg.get("cuisine_col"))
    if not items or not label:
        raise ValueError("cuisine_classifier: no column of items or labels")
    rows = _labelled(ctx, df, items, label, cfg.get("parent_map_path"))
    allowed = cfg.get("allowed_labels_path")
    names = None
    if allowed and readers.exists(ctx.spark, ctx.config.path(allowed)):
        names = labels.with_parent(readers.allowed_labels(ctx.spark, ctx.config.path(allowed)), "label", _parents(ctx, cfg.get("parent_map_path")), out="label").select("label").distinct()
    rows = staged(labels.with_support(rows, "label", int(cfg.get("min_label_freq", 100)), names), "labelled")
    docs = entities.classifier_documents(rows, "__row", "items", "label", rows.select("label").distinct(), int(cfg.get("random_seed", 42)), float(cfg.get("valid_fraction", 0.2)))
    docs = docs.withColumn("words", F.concat(models.terms(F.col("text")), F.array(F.concat(F.lit("="), F.lower("text"))))).withColumn("cats", F.array("label"))
    docs = staged(docs, "documents")
    valid = docs.where("split = 'valid'")
    where = ctx.config.path(cfg.get("out_dir") or "models/cuisine_classifier")
    model = multilabel.train(docs.where("split = 'train'"), valid, ["__row", "pos"], "words", "cats", epochs=int(cfg.get("n_epochs", 3)), patience=int(cfg.get("early_stopping_patience", 3)), seed=int(cfg.get("random_seed", 42)), path=where)
    right = multilabel.predicted(valid.select("words", "label"), model, "words").agg(F.avg((F.col("best") == F.col("label")).cast("double"))).first()[0]
    best = [h for h in model.history if h["best"]][-1:]
    return StageResult("cuisine_classifier", "success", {"model": where} if best else {}, {"accuracy": right or 0.0, "epochs": len(model.history), "f1": best[0]["f1"] if best else 0.0})


def _labelled(ctx: Context, df: DataFrame, items: str, label: str, parent_map: str | None, parents: bool = True) -> DataFrame:
    """__row, items, doc, label, child: records as lists and texts with one label, its parent where parents holds."""
    cell = F.concat_ws(",", label) if df.schema[label].dataType.simpleString() == "array<string>" else F.col(label).cast("string")
    rows = _lists(df, items).select(F.monotonically_increasing_id().alias("__row"), F.col(items).alias("items"), F.array_join(items, " ").alias("doc"), parse.single_label(cell).alias("child"))
    rows = staged(rows.where("child <> ''"), "labelled")
    if not parents:
        return rows.withColumn("label", F.col("child"))
    return labels.with_parent(rows, "child", _parents(ctx, parent_map), out="label")


@stage
def ingredients_summary(ctx: Context, **overrides) -> StageResult:
    cfg = ctx.config.stage("ingredients_summary", **overrides)
    path, out = required(cfg, "ingredients_summary", "data.map_path", "output.reports_dir")
    if not readers.exists(ctx.spark, ctx.config.path(path)):
        return StageResult("ingredients_summary", "skipped", details={"reason": "no dictionary"})
    rows = ctx.spark.read.schema("`from` string, `to` string").json(ctx.config.path(path))
    counts, targets = dictmap.summary(rows)
    where = ctx.config.path(out)
    writers.csv_report(targets, f"{where}/top_targets")
    writers.csv_report(rows.limit(20), f"{where}/examples")
    return StageResult("ingredients_summary", "success", {"reports": where}, counts.first().asDict())


@stage
def analysis_baseline(ctx: Context, **overrides) -> StageResult:
    """TF-IDF, logistic regression with its report and features, forest, clusters and their measures."""
    cfg = ctx.config.stage("analysis_baseline", **overrides)
    path, out, items, label = required(cfg, "analysis_baseline", "data.input_path", "output.reports_dir", "data.ingredients_col", "data.cuisine_col")
    p = cfg.get("params") or {}
    tree = _parents(ctx, p.get("parent_map_path"))
    rows = _labelled(ctx, _read(ctx, path), items, label, p.get("parent_map_path"), flag(p.get("apply_parent_for_training")))
    rows = labels.with_support(rows.where(~F.col("label").rlike(r"[\[\]{}]")), "label", int(p.get("min_label_freq", 20)))
    if p.get("max_label_samples"):
        rows = labels.downsampled(rows, "label", int(p["max_label_samples"]), [F.xxhash64("__row", F.lit(42))])
    rows = staged(rows, "rows")
    featured, words = models.tfidf_vectors(rows, "doc", int(p.get("ngram_min", 1)), int(p.get("ngram_max", 1)), int(p.get("min_df", 5)), float(p.get("max_df") or 1.0), int(p.get("max_features", 20_000)))
    featured = staged(featured.drop("doc"), "features")
    train, test = models.split_by_hash(featured, "__row")
    model = models.logistic(train, "label", int(p.get("max_iter", 500)))
    guesses = models.predicted(model, test, "label").select("__row", "y_true", "y_pred")
    guesses = labels.with_parent(labels.with_parent(guesses, "y_true", tree, out="y_true_parent"), "y_pred", tree, out="y_pred_parent")
    guesses = staged(report.parent_match(guesses, "y_true", "y_pred", "y_true_parent", "y_pred_parent"), "guesses")
    where = ctx.config.path(out)
    writers.csv_report(guesses.drop("__row"), f"{where}/logreg_preds")
    writers.csv_report(report.classification_report(guesses, "y_true", "y_pred"), f"{where}/logreg_report")
    writers.csv_report(report.classification_report(guesses, "y_true_parent", "y_pred_parent"), f"{where}/logreg_report_parent")
    writers.csv_report(models.top_features(model, words), f"{where}/top_features")
    models.forest(train, "label", most=int(p.get("rf_max_samples", 20_000)), key="__row").write().overwrite().save(f"{where}/random_forest")
    grouped = staged(models.clustered(featured, int(p.get("kmeans_k", 10))).select("__row", "child", "label", "features", "cluster"), "clusters")
    writers.csv_report(grouped.select(F.col("child").alias("cuisine"), F.col("label").alias("cuisine_parent"), "cluster"), f"{where}/clusters")
    entries = staged(models.vector_entries(featured, "__row"), "entries")
    space = "label" if flag(p.get("cluster_use_parent_labels")) else "child"
    measures = {"kmeans_k": int(p.get("kmeans_k", 10)), "silhouette": report.sparse_silhouette(entries, grouped.select(F.col("__row").alias("key"), "cluster")).first()[0], "ari": report.adjusted_rand(grouped, space, "cluster").first()[0], "ari_label_space": "parent" if space == "label" else "child"}
    writers.csv_report(ctx.spark.createDataFrame([tuple(measures.values())], "kmeans_k int, silhouette double, ari double, ari_label_space string"), f"{where}/metrics")
    if flag(p.get("use_svd")):
        values, vectors, projections = models.randomised_svd(entries, len(words), int(p.get("svd_components", 300)))
        total = entries.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 1.0
        shares = ctx.spark.createDataFrame([(i, float(v * v / total)) for i, v in enumerate(values)], "component int, explained_variance_ratio double")
        writers.csv_report(models.cumulative_share(shares, "explained_variance_ratio", "component"), f"{where}/svd_variance")
        writers.csv_report(ctx.spark.createDataFrame(models.component_terms(vectors.tolist(), words, int(p.get("svd_top_terms", 15))), "component int, direction string, rank int, term string, weight double"), f"{where}/svd_terms")
        sample = order.sampled(projections.withColumnRenamed("key", "__row"), "__row", n=int(p.get("svd_sample", 5000)))
        sample = sample.join(featured.select("__row", "label", "child"), "__row").select("__row", F.col("child").alias("cuisine"), F.col("label").alias("cuisine_parent"), *[F.get("projection", F.lit(i)).alias(f"svd_{i + 1}") for i in range(min(2, len(values)))])
        writers.csv_report(sample, f"{where}/svd_projections")
    return StageResult("analysis_baseline", "success", {"reports": where}, measures)


@stage
def analysis_pmi(ctx: Context, **overrides) -> StageResult:
    cfg = ctx.config.stage("analysis_pmi", **overrides)
    path, column, out = required(cfg, "analysis_pmi", "data.input_path", "data.ingredients_col", "output.reports_dir")
    p = cfg.get("params") or {}
    df = staged(_lists(_read(ctx, path), column, parse.words_or_list).select(F.monotonically_increasing_id().alias("__row"), column), "records")
    mapping = _dictionary(ctx, (cfg.get("data") or {}).get("dedupe_map_path"))
    names = dictmap.resolve_tokens(df.select(F.explode(column).alias("token")), mapping)
    lists = staged(pairs.trimmed(dictmap.map_lists(df, column, names, ["__row"], max_tokens=1_000_000), column, int(p.get("max_items_per_record", 60))), "baskets")
    edges = staged(pairs.pmi(lists, column, int(p.get("min_count", 15)), float(p.get("min_pmi", 1.0))), "pmi")
    where = ctx.config.path(out)
    writers.parquet(edges, f"{where}/pmi.parquet")
    writers.csv_report(edges.orderBy(F.desc("pmi"), "ingredient_a", "ingredient_b"), f"{where}/pmi_pairs")
    nodes = network.degrees(edges).join(network.betweenness(edges).withColumnRenamed("node", "ingredient"), "ingredient", "left")
    writers.csv_report(nodes, f"{where}/node_metrics")
    writers.gexf(edges, f"{where}/pmi.gexf")
    return StageResult("analysis_pmi", "success", {"reports": where}, {"pairs": edges.count()})


@stage
def analysis_recommender(ctx: Context, **overrides) -> StageResult:
    """Fusion reports of all pairs of the most frequent labels."""
    cfg = ctx.config.stage("analysis_recommender", **overrides)
    path, items, label, out = required(cfg, "analysis_recommender", "data.input_path", "data.ingredients_col", "data.cuisine_col", "output.reports_dir")
    pmi_dir = (ctx.config.stage("analysis_pmi").get("output") or {}).get("reports_dir") or cfg.get("pmi_dir")
    edges = ctx.spark.read.parquet(f"{ctx.config.path(pmi_dir)}/pmi.parquet")
    df = _lists(_lists(_read(ctx, path), items, parse.words_or_list), label)
    rows = df.select(F.explode(label).alias("label"), items).where("label <> ''").select("label", F.explode(items).alias("raw"))
    names = _dictionary(ctx, (cfg.get("data") or {}).get("dedupe_map_path"))
    words = rows.select("raw").distinct().withColumn("__k", text.item_key(F.col("raw"))).join(names.withColumnRenamed("key", "__k"), "__k", "left").select("raw", text.profile_name(F.col("raw"), F.col("value")).alias("item")).where("item is not null")
    profile = staged(labels.profiles(rows.join(words, "raw"), "label", "item"), "profile")
    most = profile.groupBy("label").agg(F.sum("freq").alias("n")).orderBy(F.desc("n"), "label").limit(int((cfg.get("params") or {}).get("max_cuisines", 30)))
    profile = staged(profile.join(most.select("label"), "label", "left_semi"), "profile")
    central = staged(network.betweenness(edges, samples=500).select(F.col("node").alias("item"), F.col("betweenness").alias("centrality")), "central")
    found = staged(recommend.fusions(edges, profile, recommend.label_pairs(most), central, float((cfg.get("params") or {}).get("strictness", 0.6))), "fusions")
    where = ctx.config.path(out)
    return StageResult("analysis_recommender", "success", {"reports": where}, {"files": len(writers.fusion_files(found, where))})


@stage
def analysis_graph(ctx: Context, top_k: int = 15, min_shared: int = 2, **overrides) -> StageResult:
    """Nodes and edges of the network of labels that share features."""
    base = ctx.config.path(required(ctx.config.stage("analysis_baseline"), "analysis_graph", "output.reports_dir")[0])
    where = ctx.config.path(required(ctx.config.stage("analysis_graph", **overrides), "analysis_graph", "output.viz_dir")[0])
    features = ctx.spark.read.csv(f"{base}/top_features", header=True, schema="class string, rank int, feature string, weight double").where(F.col("rank") <= top_k)
    names = _dictionary(ctx, ctx.config.artifact("cosine_map"))
    words = features.select("feature").distinct().withColumn("__k", F.lower("feature")).join(names.withColumnRenamed("key", "__k"), "__k", "left").select("feature", text.map_term(F.col("feature"), F.col("value")).alias("term")).where("term is not null")
    profile = staged(features.join(words, "feature").groupBy("class", "term").agg(F.sum("weight").alias("weight")), "profile")
    tree = _parents(ctx, (ctx.config.stage("analysis_baseline").get("params") or {}).get("parent_map_path"))
    edges = staged(network.shared_terms(profile, "class", "term", "weight", min_shared), "edges")
    named = labels.with_parent(profile.select("class").distinct(), "class", tree, aliases={})
    up = labels.with_parent(profile, "class", tree, aliases={}).groupBy("parent", "term").agg(F.sum("weight").alias("weight"))
    upper = network.shared_terms(up, "parent", "term", "weight", max(2, min_shared))
    writers.csv_report(edges.withColumn("terms", F.array_join("terms", ", ")), f"{where}/label_edges")
    writers.csv_report(upper.withColumn("terms", F.array_join("terms", ", ")), f"{where}/parent_edges")
    counts = ctx.spark.read.csv(f"{base}/clusters", header=True).groupBy(F.col("cuisine").alias("class")).agg(F.count("*").alias("count"))
    support = profile.select("class").distinct().join(counts, "class", "left").na.fill(1, ["count"])
    known = named.where(F.col("parent") != F.col("class"))
    writers.csv_report(network.label_nodes(support, "class", "count", profile, known, "class", "parent"), f"{where}/network_nodes")
    writers.csv_report(network.hierarchy_edges(profile, "class", known, "class", "parent"), f"{where}/hierarchy_edges")
    metrics = network.degrees(edges, "label_a", "label_b").join(network.betweenness(edges, "label_a", "label_b").withColumnRenamed("node", "ingredient"), "ingredient", "left")
    nodes = named.join(metrics.withColumnRenamed("ingredient", "class"), "class", "left").select(F.col("class").alias("node"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "parent", F.lit("cuisine").alias("kind"))
    writers.csv_report(nodes, f"{where}/network_metrics")
    return StageResult("analysis_graph", "success", {"reports": where})


@stage
def analysis_viz(ctx: Context, **overrides) -> StageResult:
    """The tables behind the plots: confusion matrices, supports, cluster pivot, ingredient network."""
    base = ctx.config.path(required(ctx.config.stage("analysis_baseline"), "analysis_viz", "output.reports_dir")[0])
    where = ctx.config.path(required(ctx.config.stage("analysis_viz", **overrides), "analysis_viz", "output.viz_dir")[0])
    guesses = ctx.spark.read.csv(f"{base}/logreg_preds", header=True)
    writers.csv_report(report.confusion(guesses, "y_true", "y_pred"), f"{where}/confusion")
    writers.csv_report(report.confusion(guesses, "y_true_parent", "y_pred_parent"), f"{where}/confusion_parent")
    rows = ctx.spark.read.csv(f"{base}/logreg_report", header=True)
    rows = report.without_averages(rows)
    writers.csv_report(rows.select("label", "support", "f1"), f"{where}/support")
    clusters = ctx.spark.read.csv(f"{base}/clusters", header=True)
    writers.csv_report(report.pivoted(clusters, "cluster", "cuisine", 15), f"{where}/cluster_pivot")
    pmi_dir = (ctx.config.stage("analysis_pmi").get("output") or {}).get("reports_dir")
    if pmi_dir and readers.exists(ctx.spark, f"{ctx.config.path(pmi_dir)}/pmi.parquet"):
        edges = ctx.spark.read.parquet(f"{ctx.config.path(pmi_dir)}/pmi.parquet")
        clean = edges.select(text.network_name(F.col("ingredient_a")).alias("a"), text.network_name(F.col("ingredient_b")).alias("b"), "pmi").where("a is not null and b is not null and a <> b")
        top = staged(clean.orderBy(F.desc("pmi"), "a", "b").limit(600), "network")
        writers.csv_report(top, f"{where}/ingredient_edges")
        nodes = network.degrees(top, "a", "b").join(network.betweenness(top, "a", "b").withColumnRenamed("node", "ingredient"), "ingredient", "left")
        writers.csv_report(network.merged_metrics(nodes, text.network_name(F.col("ingredient")), "degree", "betweenness"), f"{where}/ingredient_metrics")
    return StageResult("analysis_viz", "success", {"reports": where})


@stage
def cleanup_artifacts(ctx: Context, **overrides) -> StageResult:
    cfg = ctx.config.stage("cleanup_artifacts", **overrides)
    if not flag(cfg.get("enabled")):
        return StageResult("cleanup_artifacts", "skipped")
    keep = [ctx.config.artifact(a) for a in cfg.get("keep_artifacts") or []] + [ctx.config.path(k) for k in cfg.get("keep") or []]
    done = writers.cleanup(ctx.spark, [ctx.config.path(p) for p in cfg.get("patterns") or []], [k for k in keep if k], flag(cfg.get("dry_run"), True))
    return StageResult("cleanup_artifacts", "success", details={"paths": done})
