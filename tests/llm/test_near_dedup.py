import random

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import near_dedup as N
from tagloom.llm.graph import components
from tagloom.llm.textstats import Words

from .conftest import ODD


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n):
    """Groups of copies with few and many edits, chains of edits, a passage that many share, and lone documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows, last = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and last:
            text = list(rng.choice(last))
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
        elif kind < 0.6:
            text = passage + [word() for _ in range(rng.randint(3, 40))]
        else:
            text = [word() for _ in range(rng.randint(1, 120))]
        last = (last + [text])[-6:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "seed"), [(4, 1), (5, 2)])
def test_equals_brute_force(make_docs, k, seed):
    rows = corpus(seed, 400)
    got = N.dedup(make_docs(rows), N.Setting(words=k, block=16, parts=4)).collect()
    want = brute(rows, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_bucket_without_links_is_searched(make_docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base + [f"u{i}x{j}" for j in range(rng.randint(6, 9))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in N.dedup(make_docs(rows), N.Setting(words=4, block=32, few=1, turns=2)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_odd_rows(make_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.dedup(make_docs(ODD)).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5][0] == 5
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert got[None] == (1, None, True)


def test_empty_table_and_repeated_rows(make_docs):
    assert N.dedup(make_docs([])).collect() == []
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")])
    assert sorted((r["doc_id"] or -1) for r in N.kept_documents(docs).collect()) == [-1, 1]
    assert N.kept_documents(docs).columns == docs.columns


def test_signatures_estimate_similarity(spark):
    s = N.Setting()
    a, b = np.arange(0, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(100, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.unique(a), np.unique(b)]
    sig, bits = N.signatures(N.minima(sets, s), s).tolist(), N.bitmaps(sets, s).tolist()
    df = spark.createDataFrame([(sig[0], sig[1], bits[0], bits[1], 900, 900)], "a array<bigint>, b array<bigint>, p array<bigint>, q array<bigint>, n bigint, m bigint")
    from pyspark.sql import functions as F

    row = df.select(N.similarity(F.col("a"), F.col("b"), s).alias("est"), N.can_reach(F.col("p"), F.col("q"), F.col("n"), F.col("m"), s).alias("can")).first()
    assert abs(row["est"] - 0.8) < 0.12 and row["can"]


def test_shingle_sets_are_exact():
    rows = [t for _, t in ODD] + [t for _, t in corpus(9, 60)]
    for k in (1, 4, 5):
        made = Words(pa.array(rows)).shingles(k)
        assert [len(m) for m in made] == [len(shingles(t, k)) for t in rows]
        where = {}
        for m, t in zip(made, rows, strict=True):
            want = shingles(t, k)
            assert where.setdefault(m.tobytes(), want) == want


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)] + [(1000, 1001)], "a bigint, b bigint")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_large_buckets_stars_and_copies_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr("tagloom.llm.common.LIGHT", 8)
    rows = corpus(21, 90)
    base = " ".join(f"w{i}" for i in range(60))
    rows += [(10_000 + i, base + f" tail{i}") for i in range(70)] + [(20_000 + i, base) for i in range(60)]
    got = {r["doc_id"]: r for r in N.dedup(make_docs(rows), N.Setting(words=4)).collect()}
    want = brute(rows, 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_components_of_a_star_and_a_path(spark, monkeypatch):
    monkeypatch.setattr("tagloom.llm.common.LIGHT", 16)
    star = [(7, i) for i in range(100, 5100)] + [(i, i + 1) for i in range(10_000, 10_060)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(star, "a bigint, b bigint")).collect()}
    assert all(got[i] == 7 for i in range(100, 5100)) and all(got[i] == 10_000 for i in range(10_000, 10_061))
