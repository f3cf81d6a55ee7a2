import random
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import embed_dedup, mixing, sharding

from .conftest import ODD


def test_every_slot_is_claimed_in_turns():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.lookup_table(names, 101)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1 and len(owner) == 101
    # by hand: in turns, each takes its first free slot
    import hashlib

    d = lambda k, n: int(hashlib.md5(f"{k}:{n}".encode()).hexdigest(), 16)
    orders = [[(d("offset", n) % 101 + i * (d("step", n) % 100 + 1)) % 101 for i in range(101)] for n in names]
    want = [None] * 101
    while None in want:
        for s, order in enumerate(orders):
            if None in want:
                want[next(x for x in order if want[x] is None)] = s
    assert owner == want


def test_few_slots_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 4099), sharding.lookup_table(names[:-1], 4099)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 19) / 4099 < 0.12
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 4098)
    with pytest.raises(ValueError, match="one name"):
        sharding.lookup_table(["a", "b", "a"], 101)


def test_placement(make_docs):
    names = ["a", "b", "c"]
    got = {r["doc_id"]: (r["slot"], r["shard"]) for r in sharding.place(make_docs(ODD), "doc_id", names, 101).collect()}
    owner = sharding.lookup_table(names, 101)
    assert len(got) == len(ODD) and all(s == names[owner[k]] for k, s in got.values())
    clash = make_docs(ODD).withColumnRenamed("lang", "shard")
    out = sharding.place(clash, "doc_id", names, 101)
    assert out.columns.count("shard") == 1 and {r["shard"] for r in out.collect()} <= set(names)
    assert sharding.place(make_docs([]), "doc_id", names, 101).collect() == []


def test_hot_keys_are_spread(make_docs):
    rows = [(i, "t", "en", "hot" if i % 2 else f"s{i}") for i in range(600)]
    names = [f"s{i}" for i in range(8)]
    plain = Counter(r["shard"] for r in sharding.place(make_docs(rows), "source", names, 1009).collect())
    spread = Counter(r["shard"] for r in sharding.place(make_docs(rows), "source", names, 1009, spread_hot=0.1, spread_by="doc_id").collect())
    assert max(plain.values()) >= 300 and max(spread.values()) < 150


def water_filled(sizes, weights, budget, epochs):
    """Targets round by round, as the definition says."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(budget)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= epochs * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def test_targets(spark):
    rng = random.Random(8)
    many = [rng.choice([0, 1, 5, 40, 1000, 10**6]) for _ in range(400)]
    for sizes, weights, share in (([100, 100], (5, 1), 0.75), ([10, 100], (5, 1), 1.5), ([10, 0, 10], (1, 1, 1), 5), ([0, 0], (1,), 1.5), (many, (5, 2, 1), 1.5), (many, (1, 100), 1.99), ([], (1,), 1)):
        rows = [(f"s{i:04d}", n) for i, n in enumerate(sizes[1:])] + [(None, n) for n in sizes[:1]]
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint"), weights, share, 2).collect()
        own = sorted(got, key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(sizes))) and (not own or own[-1]["source"] is None)
        want = water_filled([r["source_size"] for r in own], [weights[i % len(weights)] for i in range(len(own))], share * sum(sizes), 2)
        assert [r["target"] for r in own] == pytest.approx(want)


def test_repeated_rows_are_cut_in_one_of_them(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "FEW", 0)
    rows = [(5, "one two three", "en", "a")] * 100 + [(None, "x y", "en", "a")] * 50 + [(i, "w " * 9, "en", "b") for i in range(10, 14)]
    got = mixing.mix(make_docs(rows), weights=(1, 1)).collect()
    assert len(got) == len(rows) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(r[1].split())) for r in rows)
    taken = sum(r["taken"] for r in got if r["source"] == "a")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "a")) <= 1
    assert sum(r["taken"] not in (0, r["size"], 2 * r["size"]) for r in got) <= 2


def mixed(rows):
    sizes, by = {}, {}
    for i, t, _, s in rows:
        sizes[i] = len((t or "").encode().split())
        by.setdefault(s, []).append(i)
    order = sorted(by, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    totals = [sum(sizes[i] for i in by[s]) for s in order]
    aim = water_filled(totals, [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(totals), 2)
    return sizes, dict(zip(order, zip(totals, aim, strict=True), strict=True)), by


def test_mix_meets_its_budgets(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 50))), "en", rng.choice(["hot", "hot", "hot", "é", "a", "b", None])) for i in range(900)] + [(9999, None, "en", "empty")]
    got = {r["doc_id"]: r for r in mixing.mix(make_docs(rows)).collect()}
    sizes, plan, by = mixed(rows)
    for source, (total, aim) in plan.items():
        mine = [got[i] for i in by[source]]
        assert all(r["size"] == sizes[r["doc_id"]] and r["source_size"] == total and abs(r["target"] - aim) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - aim) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(make_docs(rows[::-1])).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mixed_documents(make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 9))), "en", rng.choice("abc")) for i in range(200)]
    docs = make_docs(rows + [rows[0]] * 3)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    _, plan, _ = mixed(rows + [(1000 + i, *rows[0][1:]) for i in range(3)])
    assert all(abs(words[s] - aim) <= 9 for s, (_, aim) in plan.items())
    assert max(Counter(r["doc_id"] for r in out.collect() if r["doc_id"] != rows[0][0]).values()) <= 2


def test_mix_of_odd_and_empty_tables(make_docs):
    assert len(mixing.mix(make_docs([(i, t, "en", None) for i, t in ODD])).collect()) == len(ODD)
    assert mixing.mix(make_docs([])).collect() == [] and mixing.mixed_documents(make_docs([])).collect() == []
    assert {r["taken"] for r in mixing.mix(make_docs([(1, None), (2, " ")])).collect()} == {0}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def clusters(rows, cosine):
    able = [(i, np.array(v, float) / np.linalg.norm(v), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for n, (i, a, g) in enumerate(able):
        for j, b, h in able[n + 1 :]:
            if g == h and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i, _, _ in rows}


@pytest.mark.parametrize("setting", [{}, {"per_cell": 20, "block": 16}, {"per_cell": 5, "block": 3, "most_pivots": 10}])
def test_metric_join_equals_brute_force(spark, setting):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        if i % 3 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, 0.05, 6)
        else:
            v = rng.normal(0, 1, 6)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, [2 * x for x in rows[0][1]], rows[0][2])]
    rows += [(2000, None, 0), (2001, [0.0] * 6, 0), (2002, [float("nan")] + [1.0] * 5, 0), (2003, [None] + [1.0] * 5, 0), (2004, rows[0][1], None), (2005, [], 0), (2006, rows[0][1][:5], rows[0][2]), (2007, [float("inf")] + [1.0] * 5, 0)]
    got = embed_dedup.dedup(vectors(spark, rows), 0.93, **setting).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == clusters(rows, 0.93)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)


def test_metric_join_of_repeats_and_empty_tables(spark):
    assert embed_dedup.dedup(vectors(spark, [])).collect() == []
    got = embed_dedup.dedup(vectors(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)])).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got) == [(-1, 0, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
