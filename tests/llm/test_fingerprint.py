import hashlib
import re
import struct

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import fingerprint as P

from .conftest import ODD


def prints(make_docs, texts):
    return [r["fingerprint"] for r in P.fingerprints(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()]


def test_order_doesnt_matter_and_content_does(make_docs):
    a, b, c, d, e = prints(make_docs, ["One. Two! Three?\nFour", "Four\nThree? One. Two! ", "One. Two! Three", "One. One. Two! Three?\nFour", None])
    assert a == b and len({a, c, d, e}) == 4


def test_sentence_ends_count(make_docs):
    assert len(set(prints(make_docs, ["a b! c d? e", "a b. c d. e", "a b. c d? e"]))) == 3


def hashed(*values):
    """xxhash64 of ints (bigint above 32 bits marked as a tuple) and strings, one seeding the next."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, int) else struct.pack("<Q", v[0])
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def by_hand(text):
    """The vector's definition, paragraph by paragraph."""
    parts = [p.strip(" ") for p in re.split(r"(?<=[.!?])\s+|[\r\n]+", text or "")]
    wide, levels, n = [0] * P.WIDE, [0] * (P.WIDTH * P.LEVELS), 0
    for p in filter(None, parts):
        a, b = hashed(p), hashed(1, p)
        n += 1
        for k in range(P.WIDE):
            wide[k] = (wide[k] + (hashed(k, (a,), (b,)) >> 3)) & P.MASK
        for level in range(P.LEVELS):
            if level and (a >> (20 + P.SAMPLED * (level - 1))) & 7:
                break
            shift = 44 if level else 0
            lane = ((a >> shift) & 7) * 4 + ((a >> (shift + 8)) & 3)
            levels[P.WIDTH * level + lane] = (levels[P.WIDTH * level + lane] + (a >> 3)) & P.MASK
    return [*wide, *levels, n]


def test_vectors_equal_brute_force(make_docs, spark, sf):
    texts = [t for _, t in ODD] + ["One. Two! Three?\r\nFour  \n\n five", ". ! ?", "é. ü! " * 400]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    got = {r["doc_id"]: r["vector"] for r in P.fingerprints(make_docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert got[i] == by_hand(text), text


def test_add_and_remove(make_docs):
    df = P.fingerprints(make_docs([(0, "One. Two. Three."), (1, "Four. Five"), (2, "One. Two. Three. Four. Five"), (3, "")])).select("doc_id", "vector")
    v = {r["doc_id"]: r["vector"] for r in df.collect()}
    one = df.sparkSession.createDataFrame([(v[0], v[1], v[2])], "a array<bigint>, b array<bigint>, c array<bigint>")
    row = one.select(P.add(F.col("a"), F.col("b")).alias("sum"), P.add(F.col("c"), F.col("b"), -1).alias("less"), P.add(F.col("a"), F.col("a"), -1).alias("none")).first()
    assert row["sum"] == v[2] and row["less"] == v[0] and row["none"] == v[3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Alpha", "Beta", "Gamma", "Delta"]), max_size=12), min_size=2, max_size=12))
def test_equal_exactly_for_equal_multisets(make_docs, lists):
    got = prints(make_docs, ["".join(f"{p}. " for p in x) for x in lists])
    for x, p in zip(lists, got, strict=True):
        for y, q in zip(lists, got, strict=True):
            assert (p == q) == (sorted(x) == sorted(y))


def edited(rows):
    """The contract by hand: descending distinct ids as a ring."""
    ids = sorted({r[0] for r in rows}, reverse=True)
    by = {i: min((r[1] or "" for r in rows if r[0] == i), key=lambda t: hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    after = {i: ids[(n + 1) % len(ids)] for n, i in enumerate(ids)}
    out = []
    for i, t in rows:
        t = t or ""
        h = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - h] + by[after[i]][:h]).encode()).hexdigest()))
    return sorted(out)


def test_edits_of_odd_and_repeated_rows(make_docs):
    rows = [r for r in ODD if r[0] is not None]
    for table in (rows, [*rows, (4, "another"), (4, "word")], [(3, "only one here")]):
        got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in P.edited_against_next(make_docs(table)).collect())
        assert got == edited(table)
    assert P.edited_against_next(make_docs([])).collect() == []
    assert P.edited_against_next(make_docs(ODD)).count() == len(ODD)


def test_keys_of_very_many_rows_are_dealt_over_tasks(spark, make_docs):
    rows = [(None, f"no id {i}. And more of it.") for i in range(3000)] + [(5, f"repeated {i % 700}") for i in range(2000)] + [(i, f"single {i}. Here.") for i in range(10, 30)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = P.edited_against_next(make_docs(rows)).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in found))
    low = -(1 << 63) - 1  # null sorts last
    assert got == sorted((i != low, i if i != low else 0, n, sha) for i, n, sha in edited([(low if i is None else i, t) for i, t in rows]))
    assert len({r["part"] for r in found if r["doc_id"] is None}) > 1 and len({r["part"] for r in found if r["doc_id"] == 5}) > 1


def test_likeness(make_docs):
    many = [f"Sentence number {i} stands here" for i in range(1200)]
    rows = [(4, ". ".join(many[:40])), (3, ". ".join(many[40:80])), (2, ". ".join(many[:400])), (1, ""), (0, None)]
    got = {r["doc_id"]: r for r in P.edited_against_next(make_docs(rows)).collect()}
    assert 0.2 < got[4]["near_edited"] < 0.5 and got[4]["near_next"] < 0.15  # half of the paragraphs stay: 1/3
    assert got[3]["near_next"] < 0.35  # 40 of 400 shared: 0.1
    assert got[1]["near_next"] == 1.0 and got[1]["near_edited"] == 1.0  # both without paragraphs
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))


def test_likeness_of_very_long_texts(make_docs):
    text = lambda first, n: ". ".join(f"Sentence number {i} stands here" for i in range(first, first + n))
    cases = [  # of both texts first sentence and number, and the likeness
        ((0, 5_000), (900_000, 40), 0), ((0, 10_000), (900_000, 40), 0), ((0, 10_000), (900_000, 10_000), 0),
        ((0, 10_000), (5_000, 10_000), 1 / 3), ((0, 100_000), (50_000, 100_000), 1 / 3), ((0, 100_000), (900_000, 100_000), 0),
        ((0, 10_000), (0, 20_000), 1 / 2), ((0, 10_000), (0, 10_001), 10_000 / 10_001), ((0, 100_000), (2_000, 100_000), 98 / 102),
    ]
    docs = P.fingerprints(make_docs([(2 * i + k, text(*case[k])) for i, case in enumerate(cases) for k in (0, 1)])).select("doc_id", "vector")
    pairs = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("vector").alias("v")).join(docs, "doc_id")
    got = {r[0]: r[1] for r in pairs.select("doc_id", P.likeness(F.col("v"), F.col("vector"))).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert abs(got[2 * i + 1] - want) < 0.2, (i, got[2 * i + 1], want)
