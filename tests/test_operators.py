"""Operators against brute force, and every query against its SQL."""

import itertools
import json
import math
import os
import random
import subprocess
import sys
from collections import Counter, deque
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagloom import inventory, queries  # noqa: F401  inventory adds its queries
from tagloom.operators import dictmap, labels, models, network, order, pairs, recommend, report, similarity, vocab
from tagloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert len(queries.QUERIES[name](spark, SF).toPandas()) > 0


def graph(seed, n=14):
    rng = random.Random(seed)
    return sorted({tuple(sorted((f"n{rng.randrange(n)}", f"n{rng.randrange(n)}"))) for _ in range(2 * n)} - {(f"n{i}", f"n{i}") for i in range(n)})


def brandes(edges):
    """By counting shortest paths between all pairs."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s):
        dist, count, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        return dist, count

    at = {v: paths(v) for v in near}
    n = len(near)
    out = {}
    for v in near:
        total = 0.0
        for s, t in itertools.permutations(sorted(set(near) - {v}), 2):
            if t in at[s][0] and v in at[s][0] and at[s][0][v] + at[v][0].get(t, math.inf) == at[s][0][t]:
                total += at[s][1][v] * at[v][1][t] / at[s][1][t]
        out[v] = total / ((n - 1) * (n - 2))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness(spark, seed):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "ingredient_a string, ingredient_b string")
    got = dict(network.betweenness(df).collect())
    want = brandes(edges)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert network.betweenness(df, samples=5).count() == len(want)
    blocks = dict(network.betweenness(df, most_rows=3 * len(want)).collect())
    assert all(abs(blocks[v] - want[v]) < 1e-9 for v in want)
    with pytest.raises(ValueError, match="edges"):
        network.betweenness(df, most_edges=3)


@pytest.mark.parametrize("least", [0.55, 0.7, 0.85, 0.95, 1.0])
def test_levenshtein_pairs_are_all_found(spark, least):
    rng = random.Random(int(least * 100))
    names = {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 25))) for _ in range(120)}
    for x in sorted(names)[:60]:
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(x) + 1)
            x = x[:k] + rng.choice(["", "a", "b", "zz"]) + x[k + rng.randint(0, 1) :]
            names.add(x)
    names |= {"A  b", "a  B", " a  b", "é" * 9, "é" * 8 + "e"}
    df = spark.createDataFrame([(x,) for x in sorted(names)] * 2 + [(None,)], "x string")
    got = {(r[0], r[1]) for r in similarity.levenshtein_pairs(df, "x", least).collect()}

    def ratio(a, b):
        a, b = a.strip().lower(), b.strip().lower()
        if not a or not b:
            return 0
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, e in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != e))
        return 1 - row[-1] / max(len(a), len(b))

    assert got == {(a, b) for a, b in itertools.combinations(sorted(names), 2) if ratio(a, b) >= least - 1e-9}


def test_segments_leave_few_candidates(spark):
    rng = random.Random(8)
    names = sorted({" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5)) for _ in range(400)})
    near = [x[:7] + "#" + x[8:] for x in names[:40]]
    rows = spark.createDataFrame([(x, x, len(x)) for x in [*names, *near]], "x string, s string, n int")
    assert 40 <= similarity.segment_candidates(rows, 0.85).count() < 1000  # of 96,580 pairs
    assert similarity.length_candidates(rows, 0.85).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_sparse_cosine_pairs_are_all_found(spark, threshold):
    rng = random.Random(int(threshold * 10))
    vectors = {i: {f"f{min(rng.randrange(40), rng.randrange(40))}": rng.choice([-0.5, 1.0, 2.0, 3.0]) for _ in range(rng.randint(1, 8))} for i in range(120)}
    vectors |= {200 + i: dict(vectors[i]) for i in range(10)}
    rows = [(i, f, w) for i, v in vectors.items() for f, w in v.items()] + [(500, "f1", 0.0), (501, None, 1.0), (None, "f1", 1.0), (502, "f2", None)]
    got = {(r[0], r[1]): r[2] for r in similarity.sparse_cosine_pairs(spark.createDataFrame(rows, "id int, feature string, weight double"), threshold).collect()}
    size = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vectors.items()}
    cosine = {(a, b): sum(w * vectors[b].get(f, 0) for f, w in vectors[a].items()) / size[a] / size[b] for a, b in itertools.combinations(sorted(vectors), 2)}
    assert {p for p, c in cosine.items() if c >= threshold + 1e-9} <= set(got) <= {p for p, c in cosine.items() if c >= threshold - 1e-9}
    assert all(abs(got[p] - cosine[p]) < 1e-9 for p in got)


def test_prefixes_leave_few_candidates(spark):
    rng = random.Random(3)
    rows = [(i, f"w{rng.randrange(2000)}", 1.0) for i in range(300) for _ in range(5)] + [(i, "the", 0.5) for i in range(300)]
    rows += [(1000 + i, f, w) for i, f, w in rows if i < 30]
    unit = spark.createDataFrame(rows, "id int, feature string, weight double").groupBy("id", "feature").agg(F.max("weight").alias("weight"))
    size = unit.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("size"))
    unit = unit.join(size, "id").select("id", "feature", (F.col("weight") / F.col("size")).alias("weight"))
    assert 30 <= similarity.sparse_candidates(unit, 0.8).count() < 600  # all 54,285 pairs share a word


def test_crowded_keys_are_split_and_lose_nothing(spark):
    from tagloom.operators.spread import crowded_join

    a = spark.createDataFrame([("hot" if i % 2 else f"k{i % 40}", i) for i in range(1200)], "w string, x int")
    b = a.withColumnRenamed("x", "y")
    want = Counter(r["w"] for r in a.collect())
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    joined = crowded_join(a, b, ["w"], "x", "y")
    assert joined.count() == sum(n * n for n in want.values()) and joined.distinct().count() == joined.count()
    parts = joined.where("w = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert len(parts) > 1


def test_first_labels_are_leftmost_then_longest(spark, monkeypatch):
    known = ["New York", "york", "Thai", "Thai Fusion", "C++", "é", "thai"]
    texts = {"in new york today": "New York", "yorkshire, York": "york", "a THAI fusion": "Thai Fusion", "thai fusions": "Thai", "using C++, maybe": None, "c++x": "C++", "cafe é": "é", "café": None, "": None, None: None, "x" * 100_000 + " thai": "Thai"}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for size in (readers.MOST_CHARACTERS, 5):
        monkeypatch.setattr(readers, "MOST_CHARACTERS", size)
        got = {r["k"]: r["hit"] for r in readers.first_labels(df, "t", known, "hit").collect()}
        assert got == dict(enumerate(texts.values()))
    assert readers.first_labels(df, "t", [], "hit").where("hit IS NOT NULL").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_leaders_equal_first_fit(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.08, 0.5)[seed % 2]]
    ranks = rng.sample(range(n), n)
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, heads = {}, []
    for v in sorted(range(n), key=lambda v: ranks[v]):
        want[v] = next((h for h in heads if h in near[v]), v)
        if want[v] == v:
            heads.append(v)
    nodes = spark.createDataFrame([(v, ranks[v]) for v in range(n)], "v int, r int")
    got = dict(similarity.leaders(nodes, spark.createDataFrame(edges, "a int, b int"), "v", "r", "a", "b").collect())
    assert got == want


def test_phrases_merge_into_leaders(spark):
    vocabulary = spark.createDataFrame([("red onion", 9), ("red onions", 3), ("red onoin", 1), ("salt", 50), ("sea salt", 2), ("Sea Salts", 1), ("beef", 4)], "token string, count bigint")
    got = {r["from"]: r["to"] for r in similarity.dedupe_phrases(vocabulary, 0.5, generic=("salt", "sea salt")).collect()}
    assert got == {"red onions": "red onion", "red onoin": "red onion"} | {k: v for k, v in got.items() if "salt" in k}
    assert all("salt" not in v or v == "sea salts" for v in got.values())


def test_numbers_follow_the_order(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    got = order.numbered(spark.createDataFrame(rows, "i int, v int").repartition(7), [F.desc("v")], "n").collect()
    assert {r["v"]: r["n"] for r in got} == {v: 1000 - v for _, v in rows}


def test_encoders(spark):
    df = spark.createDataFrame([(1, ["B", " a ", "b", ""]), (2, ["c", "a"]), (3, []), (4, None)], "row int, items array<string>")
    encoder = vocab.fit_encoder(df, "items", ["row"])
    assert {(r["id"], r["token"], r["count"]) for r in encoder.collect()} == {(1, "b", 2), (2, "a", 2), (3, "c", 1)}
    for most in (100, 0):  # sent along, and joined
        got = {r["row"]: r["ids"] for r in vocab.encode_lists(df, "items", encoder.where("id < 3"), ["row"], most_sent=most).collect()}
        assert got == {1: [1, 2, 1, 0], 2: [0, 2], 3: [], 4: []}
    got = {r["row"]: r["ids"] for r in vocab.encode_lists(df, "items", encoder, ["row"], empty_as_unknown=True).collect()}
    assert got[3] == [0] and got[4] == [0]


def test_dictionary_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"from": "Big Apple", "to": "apple"}\n\n{"from": "", "to": "x"}\n{"from": "pear", "to": "a"}\n{"from": "pear", "to": "b"}\n')
    got = dict(readers.jsonl_map(spark, str(tmp_path / "m.jsonl")).collect())
    assert got == {"Big Apple": "apple", "big apple": "apple", "pear": "b"}
    writers.jsonl_map(spark.createDataFrame([("q", "r")], "`from` string, `to` string"), str(tmp_path / "out.jsonl"))
    assert dict(readers.jsonl_map(spark, str(tmp_path / "out.jsonl")).collect()) == {"q": "r"}
    frequencies = dictmap.unigram_frequency(readers.jsonl_map(spark, str(tmp_path / "m.jsonl")))
    assert dict(frequencies.collect()) == {"apple": 2, "b": 1}


def test_lists_keep_order_and_limits(spark):
    df = spark.createDataFrame([(1, ["x", "Big Apple", "apple", "salt"]), (2, []), (3, None)], "row int, items array<string>")
    mapping = spark.createDataFrame([("big apple", "apple")], "key string, value string")
    names = dictmap.resolve_tokens(df.select(F.explode("items").alias("token")), mapping)
    got = {r["row"]: r["items"] for r in dictmap.map_lists(df, "items", names, ["row"]).collect()}
    assert got == {1: ["x", "apple"], 2: [], 3: []}
    got = {r["row"]: r["items"] for r in dictmap.map_lists(df, "items", names, ["row"], max_tokens=2, distinct=False).collect()}
    assert got[1] == ["x", "apple"]


def test_pmi_of_hand_made_baskets(spark):
    lists = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["c"],), ([],)], "items array<string>")
    got = {(r[0], r[1]): (r[2], r[3]) for r in pairs.pmi(lists, min_count=1).collect()}
    assert got[("a", "b")] == (2, pytest.approx(math.log((2 / 4) / (2 / 4 * 2 / 4))))
    assert got[("a", "c")] == (1, pytest.approx(math.log((1 / 4) / (2 / 4 * 2 / 4))))
    assert pairs.pmi(lists, min_count=9).collect() == []
    keep = spark.createDataFrame([("a",), ("c",)], "item string")
    for most in (10, 0):  # sent along, and joined
        left = sorted(r["items"] for r in pairs.among(lists, "items", keep, most).collect())
        assert [x for x in left if len(x) > 1] == [["a", "c"]]
    many = spark.createDataFrame([([f"i{k:03d}" for k in range(90)],)], "items array<string>")
    assert pairs.pair_counts(pairs.trimmed(many, "items")).count() == 60 * 59 // 2


def test_report_of_a_hand_made_table(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    got = {r["label"]: r for r in report.classification_report(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert got["a"]["precision"] == 0.75 and got["a"]["recall"] == 0.75 and got["c"]["f1"] == 0 and got["c"]["support"] == 1
    assert got["accuracy"]["f1"] == pytest.approx(5 / 7) and got["macro avg"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    same = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int")
    assert report.adjusted_rand(same, "a", "b").first()[0] == 1.0


def test_silhouette_equals_pairs(spark):
    rng = np.random.default_rng(1)
    x = [(rng.normal(c, 1, 3).tolist(), c) for c in (0, 0, 0, 3, 3, 3, 3, 9)]
    value = 0.0
    for i, (v, c) in enumerate(x):
        far = {k: np.mean([sum((p - q) ** 2 for p, q in zip(v, w, strict=True)) for j, (w, d) in enumerate(x) if d == k and j != i] or [0]) for k in (0, 3, 9)}
        a, b = far.pop(c), min(far.values())
        value += (b - a) / max(a, b) if Counter(c for _, c in x)[c] > 1 else 0
    assert report.squared_silhouette(spark.createDataFrame(x, "v array<double>, c int"), "v", "c").first()[0] == pytest.approx(value / len(x))


def test_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (60, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.9}
    assert {(r[0], r[1]) for r in similarity.cosine_pairs(df, "id", "v", 0.9, block=7).collect()} == want
    got = similarity.nearest(df, "id", "v", 4, block=7).collect()
    for i in range(60):
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-u[i] @ u[j], j))[:4]
        assert [r["neighbor"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == best


def test_fusions_of_a_small_graph(spark):
    edges = spark.createDataFrame([("basil", "lime"), ("lime", "chili"), ("basil", "chili"), ("basil", "pasta")], "ingredient_a string, ingredient_b string")
    profile = spark.createDataFrame([("A", "basil", 5), ("A", "pasta", 4), ("B", "chili", 5), ("B", "lime", 2)], "label string, item string, freq bigint")
    central = spark.createDataFrame([("basil", 0.5), ("lime", 0.0), ("chili", 0.25)], "item string, centrality double")
    row = recommend.fusions(edges, profile, recommend.label_pairs(profile), central, 0.5).first()
    assert row["pair"] == "A + B"
    assert [(b["name"], b["score"]) for b in row["bridges"]] == [("chili", 1.25), ("lime", 1.0)] or [b["name"] for b in row["bridges"]][0] in ("basil", "chili")
    assert all(b["connects_a"] and b["connects_b"] for b in row["bridges"])
    assert {n["name"] for n in row["novel_from_a"]} <= {"basil", "pasta"} and {n["strength"] for n in row["novel_from_a"]} == {1}
    assert recommend.considered(0.6) == 35 and recommend.considered(1.0) == 25


def test_parents_and_support(spark):
    tree = spark.createDataFrame([("South-Thai", "Thai"), ("lao", "Oriental")], "child string, parent string")
    df = spark.createDataFrame([("south thai",), ("Lao",), ("Other",), ("Lao",)], "l string")
    assert sorted(r["parent"] for r in labels.with_parent(df, "l", tree).collect()) == ["Asian", "Asian", "Other", "Thai"]
    assert [tuple(r) for r in labels.support(df, "l").collect()] == [("Lao", 2), ("Other", 1), ("south thai", 1)]
    assert labels.with_support(df, "l", 2, spark.createDataFrame([("x",)], "l string")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ING,Type\n\"caf\xe9 \x80\",x\n".encode("latin-1"))
    row = readers.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert row["ING"] == "café €"
    (tmp_path / "b.txt").write_text("x")
    assert readers.discovered(spark, str(tmp_path)) == [(1, f"{tmp_path}/a.csv")]
    with pytest.raises(ValueError, match="no reader"):
        readers.read_table(spark, "x.bin")
    with pytest.raises(ValueError, match="no column"):
        readers.limited(spark, str(tmp_path / "a.csv"), ["nope"])
    (tmp_path / "p.json").write_text('{"Moroccan": "Mediterranean", " ": "x", "Moroccan": "African"}')
    assert readers.json_object(spark, str(tmp_path / "p.json")).collect() == [("Moroccan", "African")]
    lines = lambda *rows: spark.createDataFrame([(bytearray(r),) for r in rows], "b binary").select(F.col("b").cast("string").alias("value"))
    assert [readers.charset(lines(b"x", r)) for r in ("é".encode(), b"\x81\xff", b"\xe9\x80")] == ["UTF-8", "ISO-8859-1", "windows-1252"]


def test_first_rows_of_folders(spark, tmp_path):
    """Later files are larger, so that Spark takes them first; files are read in parts."""
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    docs = [(i, None if i % 7 == 0 else f"{i % 4}", f"{i}" * 20) for i in range(900, 0, -1)]
    (tmp_path / "c.csv").mkdir()
    for names, rows in zip(("a b", "a!b", "a+b", "é"), (docs[:40], docs[40:90], docs[90:300], docs[300:]), strict=True):
        table = pa.table({c: list(v) for c, v in zip(("doc_id", "lang", "text"), zip(*rows, strict=True), strict=True)})
        pq.write_table(table, folder / f"{names}.parquet", row_group_size=8, compression="none")
        lines = [f"{k},{lang or ''},{text}é" for k, lang, text in rows]
        (tmp_path / "c.csv" / f"{names}.csv").write_bytes("\n".join(["doc_id,lang,text", *lines]).encode("latin-1"))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (most, "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
            want = con.sql(queries.SQL["two_column_first_rows"]).fetchall()
            assert 0 < len(want) < 120
            assert [tuple(r) for r in queries.QUERIES["two_column_first_rows"](spark, str(tmp_path)).collect()] == want
            found = readers.read_csv(spark, str(tmp_path / "c.csv"), rows=120).collect()
            assert [(int(r["doc_id"]), r["lang"], r["text"]) for r in found] == [(k, lang, f"{text}é") for k, lang, text in docs[:120]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    made = spark.createDataFrame(docs, "doc_id bigint, lang string, text string").repartition(1)
    assert len(readers.first_rows(made, 5).collect()) == 5


def test_files_of_graphs_and_encoders(spark, tmp_path):
    edges = spark.createDataFrame([("a & b", "c", 1.5)], "ingredient_a string, ingredient_b string, pmi double")
    writers.gexf(edges, str(tmp_path / "g.gexf"))
    assert "a &amp; b" in (tmp_path / "g.gexf").read_text()
    writers.encoder_json(spark.createDataFrame([(1, "é")], "id bigint, token string"), str(tmp_path / "i.json"), str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text()) == {"<UNK>": 0, "é": 1}
    odd = [(i, f'x{i} "quoted" \\ é, \n\t') for i in range(1, 300)]
    writers.encoder_json(spark.createDataFrame(odd, "id bigint, token string").repartition(7), str(tmp_path / "i.json"), str(tmp_path / "t.json"))
    assert list(json.loads((tmp_path / "i.json").read_text()).items()) == [("0", "<UNK>"), *((str(i), t) for i, t in odd)]
    assert json.loads((tmp_path / "t.json").read_text()) == {"<UNK>": 0} | {t: i for i, t in odd}
    import xml.etree.ElementTree as xml

    writers.gexf(spark.createDataFrame([(f"n{i % 50}", f'm"{i}<', i / 7) for i in range(200)], "ingredient_a string, ingredient_b string, pmi double").repartition(5), str(tmp_path / "h.xml"))
    tree = xml.parse(tmp_path / "h.xml").getroot()
    at = "{http://www.gexf.net/1.2draft}"
    assert [n.get("id") for n in tree.iter(f"{at}node")] == sorted({f"n{i % 50}" for i in range(200)} | {f'm"{i}<' for i in range(200)})
    assert [(int(e.get("id")), e.get("source"), e.get("target"), float(e.get("weight"))) for e in tree.iter(f"{at}edge")] == [(k, *x) for k, x in enumerate(sorted((f"n{i % 50}", f'm"{i}<', i / 7) for i in range(200)))]
    assert not list(tmp_path.glob("*.parts-*"))
    assert writers.cleanup(spark, [str(tmp_path / "*.gexf")], dry_run=True) and (tmp_path / "g.gexf").exists()
    assert writers.cleanup(spark, [str(tmp_path / "*.gexf")], keep=["g.gexf"]) == []
    writers.cleanup(spark, [str(tmp_path / "*.gexf")])
    assert not (tmp_path / "g.gexf").exists()


def test_models_learn_something(spark):
    rng = random.Random(1)
    rows = [(i, "fr" if i % 2 else "en", " ".join(rng.choice("chat noir lune" .split() if i % 2 else "cat black moon".split()) for _ in range(9))) for i in range(80)]
    df, words = models.tfidf_vectors(spark.createDataFrame(rows, "doc_id int, lang string, text string"), "text", 1, 2, 2, 1.0)
    train, test = models.split_by_hash(df, "doc_id")
    model = models.logistic(train, "lang", 20)
    assert models.predicted(model, test, "lang").where("y_true <> y_pred").count() == 0
    assert models.top_features(model, words, 3).where("class = 'fr'").count() == 3


def test_without_the_llm_subpackage(tmp_path):
    """The rest imports and answers when the subpackage and the pipeline aren't there."""
    top = Path(__file__).resolve().parents[1]
    for name in ("tagloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(top / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tagloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pmi_pairs' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 1009])
def test_epochs_are_permutations_dealt_to_workers(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "x")
    orders = []
    for epoch in (0, 1):
        parts = [readers.epoch_of_worker(rows, "x", n, epoch, w, 4).collect() for w in range(4)]
        assert all(r["place"] % 4 == w for w, part in enumerate(parts) for r in part)
        orders.append({r["x"]: r["place"] for part in parts for r in part})
        assert sorted(orders[-1].values()) == list(range(n)) and len(orders[-1]) == n
    assert n < 50 or sum(orders[0][x] == orders[1][x] for x in range(n)) < n / 4
    assert readers.epoch_of_worker(rows, "x", n, 0, 0, 1, most=3).count() == min(n, 3)


def test_sparse_silhouette_equals_the_dense_one(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.0, 1.0, 2.5]) + (j == i % 3) for j in range(6)], i % 3) for i in range(40)] + [(90, [0.0] * 6, 1), (91, [1.0] * 6, 7)]
    df = spark.createDataFrame(rows, "key int, v array<double>, cluster int")
    entries = models.vector_entries(df.withColumn("features", array_to_vector("v")), "key")
    want = report.squared_silhouette(df, "v", "cluster").first()[0]
    assert report.sparse_silhouette(entries, df).first()[0] == pytest.approx(want)
    sparse = spark.createDataFrame([(k, Vectors.sparse(6, {j: x for j, x in enumerate(v) if x})) for k, v, _ in rows], ["key", "features"])
    assert sorted(map(tuple, models.vector_entries(sparse, "key").collect())) == sorted((k, j, x) for k, v, _ in rows for j, x in enumerate(v) if x) == sorted(map(tuple, entries.collect()))


def test_randomised_svd_equals_the_dense_one(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((150, 40)) < 0.2) * rng.random((150, 40)) + np.outer(rng.random(150), rng.random(40)) * 0.5
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(150) for j in range(40) if a[i, j]], "key int, feature int, weight double").repartition(6)
    values, vectors, projections = models.randomised_svd(entries, 40, 5, 15, rounds=12)
    _, want, right = np.linalg.svd(a)
    assert np.allclose(values, want[:5], rtol=1e-6) and np.allclose(np.abs((vectors * right[:5]).sum(axis=1)), 1, atol=1e-4)
    got = {r["key"]: r["projection"] for r in projections.collect()}
    assert len(got) == 150 and all(np.allclose(got[i], a[i] @ vectors.T) for i in range(150))
    none = models.randomised_svd(entries.limit(0), 0, 3)
    assert none[0].size == 0 and none[2].count() == 0


def test_threads_keep_their_own_tables(spark):
    import threading

    from tagloom import storage

    mine = storage.staged(spark.range(5), "mine")
    before = storage.staged_tables()
    seen = []

    def other():
        theirs = storage.staged(spark.range(7), "theirs")
        seen.append((storage.staged_tables(), theirs.count()))
        storage.drop_staged()
        seen.append(storage.staged_tables())

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert seen == [(1, 7), 0] and storage.staged_tables() == before and mine.count() == 5
