"""The configured stages from raw sources to reports, on a small made-up corpus."""

import json
import random

import pytest
import yaml

from tagloom.plans.config import Config, flag, required
from tagloom.plans.runner import ORDER, STAGES, Runner

ITEMS = {"Italian": ["fresh basil", "tomato", "olive oil", "2 cups pasta", "garlic"], "Mexican": ["corn", "black bean", "tomato", "chili", "lime"], "Thai": ["fish stock", "lime", "chili", "coconut milk", "garlic"]}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    rng = random.Random(3)
    raw = top / "raw"
    raw.mkdir()
    rows = []
    for i in range(240):
        label = rng.choice(sorted(ITEMS))
        rows.append((json.dumps(rng.sample(ITEMS[label], 4)), label))
    (raw / "a.csv").write_text("Ingredients,Cuisine\n" + "\n".join('"' + r[0].replace('"', '""') + '",' + r[1] for r in rows[:120]))
    (raw / "b.csv").write_bytes(("ingredient,country\n" + "\n".join('"' + r[0].replace('"', '""') + '",' + r[1] for r in rows[120:]) + '\n"[""cr\xe8me""]",\n').encode("cp1252"))
    (raw / "skip.csv").write_text("x,y\n1,2\n")
    spark.createDataFrame([(json.loads(r[0]),) for r in rows], "NER array<string>").write.parquet(str(top / "corpus.parquet"))
    (top / "parents.json").write_text(json.dumps({"Italian": "European", "Mexican": "American", "Thai": "Asian"}))
    art = lambda n: str(top / n)
    cfg = {
        "artifacts": {"cuisine_combined_encoded": art("combined_cuisine.parquet"), "cosine_map": art("map.jsonl")},
        "pipeline": {
            "ingredient_normalization": {"data": {"input_path": art("corpus.parquet"), "ner_col": "NER"}, "output": {"baseline_parquet": art("clean.parquet"), "dedup_parquet": art("dedup.parquet"), "cosine_map_path": art("map.jsonl"), "list_col_for_vocab": "NER_clean", "unified_parquet": art("unified.parquet"), "ingredient_id_to_token": art("i2t.json"), "ingredient_token_to_id": art("t2i.json")}, "sbert": {"threshold": 0.9}},
            "ingredient_ner": {"training": {"ner": {"train_path": art("clean.parquet"), "ner_list_col": "NER_clean", "out_dir": art("ner")}}, "inference": {"data": {"input_path": art("combined.parquet")}, "output": {"out_base": art("pred"), "combined_dataset": art("inferred.parquet")}, "artifacts": {"cosine_map_path": art("map.jsonl"), "ingredient_token_to_id": art("t2i.json")}, "inference": {"text_col": "ingredients"}}},
            "combine_raw": {"data_dir": str(raw), "output_path": art("combined.parquet")},
            "ingredient_post_map": {"map_path": art("none.jsonl"), "collapse_duplicate_words": True, "targets": [{"input_path": art("inferred.parquet"), "output_path": art("post.parquet"), "list_col": "inferred_ingredients"}]},
            "ingredient_encoding": {"input_path": art("post.parquet"), "output_path": art("encoded.parquet"), "ingredient_token_to_id": art("t2i.json")},
            "cuisine_normalization": {"data": {"input_path": art("encoded.parquet"), "cuisine_col": "cuisine"}, "output": {"cosine_map_path": art("cmap.jsonl"), "cuisine_id_to_token": art("ci2t.json"), "cuisine_token_to_id": art("ct2i.json")}, "sbert": {"threshold": 0.65, "min_freq_for_vocab": 1}},
            "cuisine_classifier": {"training": {"cuisine_classifier": {"train_path": art("combined_cuisine.parquet"), "text_col": "inferred_ingredients", "cuisine_col": "cuisine_deduped", "min_label_freq": 5, "out_dir": art("clf"), "parent_map_path": art("parents.json")}}},
            "ingredients_summary": {"data": {"map_path": art("map.jsonl")}, "output": {"reports_dir": art("summary")}},
            "analysis_baseline": {"data": {"input_path": art("combined_cuisine.parquet"), "ingredients_col": "inferred_ingredients", "cuisine_col": "cuisine_deduped"}, "params": {"min_df": 2, "max_df": 1.0, "ngram_max": 2, "kmeans_k": 3, "min_label_freq": 5, "max_iter": 30, "parent_map_path": art("parents.json"), "use_svd": True, "svd_components": 2}, "output": {"reports_dir": art("baseline")}},
            "analysis_pmi": {"data": {"input_path": art("combined_cuisine.parquet"), "ingredients_col": "inferred_ingredients"}, "params": {"min_count": 3, "min_pmi": -5.0}, "output": {"reports_dir": art("pmi")}},
            "analysis_recommender": {"data": {"input_path": art("combined_cuisine.parquet"), "ingredients_col": "inferred_ingredients", "cuisine_col": "cuisine_deduped"}, "output": {"reports_dir": art("fusion")}},
            "analysis_graph": {"output": {"viz_dir": art("graph")}},
            "analysis_viz": {"output": {"viz_dir": art("viz")}},
            "cleanup_artifacts": {"enabled": True, "dry_run": True, "patterns": [art("*.parquet")], "keep_artifacts": ["cuisine_combined_encoded"]},
        },
    }
    path = top / "config.yaml"
    path.write_text(yaml.safe_dump(cfg))
    out = Runner(spark, Config.load(str(path))).run([*ORDER, "cleanup_artifacts", "nonsense"], stop_on_failure=False)
    return top, {r.name: r for r in out}


def test_every_stage_succeeds(results):
    _, out = results
    states = {n: r.status for n, r in out.items()}
    assert states.pop("download") == "skipped" and states.pop("nonsense") == "skipped"
    assert set(states.values()) == {"success"}, {n: out[n].details for n, s in states.items() if s != "success"}


def test_combined_counts_skipped_sources(spark, results):
    top, out = results
    df = spark.read.parquet(str(top / "combined.parquet"))
    assert {(r[0], r[1]) for r in df.groupBy("Dataset_ID").count().collect()} == {(1, 120), (2, 120)}  # the unlabelled row is dropped
    assert any("skip.csv" in p for p in out["combine_raw"].details["skipped"])


def test_encoding_knows_all_tokens(results):
    _, out = results
    d = out["ingredient_encoding"].details
    assert d["rows"] == 240 and d["tokens"] > 900 and d["unknown"] == 0


def test_reports(spark, results):
    top, out = results
    assert 0.5 < out["analysis_baseline"].details["ari"] <= 1
    preds = spark.read.csv(str(top / "baseline/logreg_preds"), header=True)
    assert {"y_true", "y_pred", "y_true_parent", "y_pred_parent", "parent_match"} == set(preds.columns)
    files = sorted(p.name for p in (top / "fusion").iterdir() if p.name.endswith(".json"))
    assert files == ["fusion_Italian_Mexican.json", "fusion_Italian_Thai.json", "fusion_Mexican_Thai.json"]
    report = json.loads((top / "fusion" / files[0]).read_text())
    assert set(report) == {"pair", "bridges", "novel_from_a", "novel_from_b"} and report["pair"] == "Italian + Mexican"
    scores = [b["score"] for b in report["bridges"]]
    assert scores == sorted(scores, reverse=True) and len(scores) <= 10


def test_cleanup_keeps_artifacts(results):
    top, out = results
    paths = out["cleanup_artifacts"].details["paths"]
    assert any(p.endswith("clean.parquet") for p in paths) and not any("combined_cuisine" in p for p in paths)
    assert (top / "clean.parquet").exists()


def test_a_failing_stage_stops_the_run(spark):
    out = Runner(spark, Config({"pipeline": {}})).run(["analysis_pmi", "combine_raw"])
    assert [r.status for r in out] == ["failed"] and "data.input_path" in out[0].details["error"]


def test_configuration_helpers():
    cfg = Config({"pipeline": {"a": {"x": {"y": 1}}}}, "/w")
    assert cfg.stage("a", **{"x.y": 2, "z": 3}) == {"x": {"y": 2}, "z": 3} and cfg.stage("a") == {"x": {"y": 1}}
    assert cfg.path("d/e") == "/w/d/e" and cfg.path("s3://b/c") == "s3://b/c"
    assert flag("Yes") and not flag("0") and flag(None, True)
    with pytest.raises(ValueError, match="b.c"):
        required({}, "s", "b.c")
    assert set(ORDER) < set(STAGES)
