import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import packing, token_store
from tagloom.llm.tokenization import PieceEncoder, crc_of, public

from .conftest import ODD

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
TRICKY = ["a  b\n\n c\t", "don't 'S 12345 ½²'sam !'s", "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "<|endoftext|> x", "a\x1cb\x85c", "éa naïve’s — ok", "a\n ", "a \n b", "a \t \t b", "\n\n\n", "x,y, z.", "a.\n\nb.", "é, é.\né", "A b   c", " lead trail "]


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def both(request):
    return PieceEncoder(public(request.param), 50), Tokenizer.from_file(public(request.param))


def same(both, texts):
    own, library = both
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_ids_are_the_librarys(both, spark, sf):
    same(both, TRICKY + [t or "" for _, t in ODD])
    rows = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    same(both, rows)
    same(both, rows[:50])  # from the tables


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'SÉ é.,!?\n\t12 ½-<|", max_size=25), max_size=6))
def test_ids_of_any_text(both, texts):
    same(both, texts)


def test_index_is_minimal_and_refuses_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 500, 3000):
        keys = np.sort(rng.choice(1 << 40, n, replace=False))
        offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 9, n))])
        index = token_store.build_index(keys, np.zeros(n, int), offsets)
        hit, at, size = token_store.find(index, keys)
        assert hit.all() and (at == offsets[:-1]).all() and (size == np.diff(offsets)).all()
        others = rng.choice(1 << 40, 2000) + (1 << 41)
        assert token_store.find(index, others)[0].mean() < 0.01


def test_store_round_trip(make_docs):
    rows = [(i, t) for i, t in ODD] + [(4, "again"), (4, "word")]
    library = Tokenizer.from_file(public(BYTES))
    store = token_store.write(make_docs(rows), public(BYTES), shard_ids=1000)
    got = token_store.scan(store).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0])
        want.setdefault(i, []).append((len(ids), crc_of(ids)))
    assert len(got) == len(rows)
    for i, w in want.items():
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == i) == sorted(w)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    found = dict(token_store.lookup(store, [6, 8, 777]).collect())
    assert set(found) == {6, 8} and found[6] == [*library.encode("same text here for two", add_special_tokens=False).ids, 0]


def test_least_key_is_not_null_and_repeated_keys_fill_shards(make_docs):
    least = -(1 << 63)
    rows = [(None, "no key"), (None, "none either"), (least, "the least key"), (least, "the least key again"), (5, "before")] + [(7, "the same words each time")] * 400 + [((1 << 63) - 1, "the greatest")]
    store = token_store.write(make_docs(rows), public(BYTES), shard_ids=200)
    got = token_store.scan(store).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    assert store.where("first_key = 7 AND last_key = 7").count() > 3
    library = Tokenizer.from_file(public(BYTES))
    ids = lambda t: [*library.encode(t, add_special_tokens=False).ids, 0]
    found = token_store.lookup(store, [least, 5, 6, 7, (1 << 63) - 1]).collect()
    assert len(found) == 4
    found = dict(found)
    assert found[least] in (ids("the least key"), ids("the least key again")) and found[5] == ids("before") and found[7] == ids("the same words each time") and found[(1 << 63) - 1] == ids("the greatest")


def test_empty_tables(make_docs):
    assert token_store.scan(token_store.write(make_docs([]), public(BYTES))).collect() == []
    assert packing.pack(make_docs([]), public(WORDS)).collect() == []


@pytest.mark.parametrize("n", [1, 40, 400])
def test_plans_hold_exactly_the_lengths(n):
    rng = random.Random(n)
    lengths = [min(256, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(n)]
    counts = {x: lengths.count(x) for x in lengths}
    made = packing.plan(list(counts), list(counts.values()), 256).made
    held = {}
    for used, many in made:
        assert sum(k * v for k, v in used.items()) <= 256
        for k, v in used.items():
            held[k] = held.get(k, 0) + v * many
    assert held == counts
    assert sum(m for _, m in made) <= -(-sum(lengths) // 256) + 1 + 0.02 * n


def test_knapsack_is_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lengths, values, most = [rng.randint(1, 9) for _ in range(4)], [rng.random() for _ in range(4)], [rng.randint(1, 3) for _ in range(4)]
        found = packing.knapsack(lengths, values, most, 20)
        assert sum(lengths[i] * n for i, n in found.items()) <= 20 and all(n <= most[i] for i, n in found.items())
        best = max(sum(v * n for v, n in zip(values, ns, strict=True)) for ns in np.ndindex(*[m + 1 for m in most]) if sum(x * n for x, n in zip(lengths, ns, strict=True)) <= 20)
        assert abs(sum(values[i] * n for i, n in found.items()) - best) < 1e-9


def test_packing_is_gapless_and_whole(make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["cat", "sat", "mat"]) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(i, t) for i, t in ODD] + [(7, "same text here for two")]
    library = Tokenizer.from_file(public(WORDS))
    got = packing.pack(make_docs(rows), public(WORDS), capacity=64).collect()
    whole = {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1])
        for k, a in enumerate(range(0, len(ids), 64)):
            whole.setdefault((i, k, a, len(ids[a : a + 64]), crc_of(ids[a : a + 64])), []).append(1)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["piece"]) for r in got)) == sorted((k[0] is None, k[0] or 0, k[1]) for k, v in whole.items() for _ in v)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == set(whole)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.03 * -(-sum(r["length"] for r in got) // 64) + 1


def test_few_lengths_reach_the_linear_programs_optimum():
    n = 1200
    made = packing.plan([2040, 1030, 1020], [n] * 3)  # no sequence is full; best fit alone takes n / 2 + n / 3 + n / 4
    assert made.sequences == n and made.bound == n and made.best_fit == 1300 and made.share == 1
    assert packing.plan([96, 400], [1000, 10_000]).sequences == 1000
    lengths, counts = np.array([40, 250, 333, 700, 900, 1300, 1500]), np.array([500, 8000, 9000, 2000, 4000, 5000, 3000])
    found, _ = packing.solve_exactly(lengths, counts, 4096, gap=0)
    held = sum(x * np.array([used.get(i, 0) for i in range(7)]) for used, x in found)
    assert np.allclose(held, counts) and all(sum(lengths[i] * k for i, k in used.items()) <= 4096 for used, _ in found)
    assert packing.plan(lengths.tolist(), counts.tolist()).sequences <= sum(x for _, x in found) + 7


@pytest.mark.parametrize(("n", "least"), [(250_000, 0.95), (20_000, 0.85)])
def test_the_linear_program_places_most_of_a_wide_histogram(n, least):
    lengths = np.clip(np.exp(np.random.default_rng(0).normal(6, 1.1, n)).astype(int) + 1, 1, 4096)
    size, many = np.unique(lengths, return_counts=True)
    made = packing.plan(size.tolist(), many.tolist())
    assert made.share >= least and made.sequences <= made.best_fit
    assert made.bound <= made.sequences <= np.ceil(lengths.sum() / 4096) + 1


def test_plans_never_take_more_than_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(12):
        size = np.unique(rng.integers(1, 257, rng.integers(1, 120)))
        many = rng.integers(1, 200, len(size))
        made = packing.plan(size.tolist(), many.tolist(), 256)
        held = sum((n * np.bincount(list(used), list(used.values()), 257) for used, n in made.made), np.zeros(257))
        assert (held[size] == many).all() and held.sum() == many.sum()
        assert made.bound - 1e-6 <= made.sequences <= made.best_fit and 0 <= made.share <= 1


def test_values_of_rooms_are_optimal():
    rng = np.random.default_rng(7)
    for _ in range(10):
        lengths, worth = np.unique(rng.integers(2, 12, 4)), rng.random(12)
        values = np.full(31, -np.inf)
        values[lengths] = worth[lengths]
        best = np.zeros(31)
        for room in range(31):
            best[room] = max([best[room - x] + values[x] for x in lengths if x <= room], default=0.0)
        assert np.allclose(packing.room_values(values, 30), best)


def thue_morse(n, a, b):
    s = a
    for _ in range(n):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_long_words_that_differ_by_pattern_keep_their_ids(both):
    same(both, [f"q {thue_morse(10, 'a', 'b')}", f"q {thue_morse(10, 'b', 'a')}", f"{'x' * 22} {'x' * 23} {'x' * 24} y" * 2, "a\0b a\0 a"])


def test_colliding_hashes_keep_their_ids(both, monkeypatch):
    monkeypatch.setattr("tagloom.llm.tokenization.folded", lambda longs: np.asarray(longs[0] % np.uint64(3)))
    texts = [f"word{i} and number{i % 7}, then" for i in range(200)]
    same((PieceEncoder(both[0].path, 50), both[1]), texts)
    same((PieceEncoder(both[0].path), both[1]), texts + texts[::-1])
