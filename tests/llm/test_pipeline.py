import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tagloom.llm import near_dedup, quality, queries, toxicity
from tagloom.llm.common import read
from tagloom.llm.tokenization import crc_of, public

from .test_near_dedup import brute
from .test_placing import water_filled


def mixed_by_hand(docs):
    """How often each document is taken: sources one by one, documents in order of their keys."""
    marks = docs.select("doc_id", "text", "source", F.xxhash64(*docs.columns).alias("mark")).collect()
    rows = [(r["source"], int(hashlib.md5(f"17:{r['doc_id']}:{r['mark']}".encode()).hexdigest()[:15], 16), r["doc_id"], len((r["text"] or "").encode().split())) for r in marks]
    order = sorted({r[0] for r in rows}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    sizes = [sum(r[3] for r in rows if r[0] == s) for s in order]
    aims = water_filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes), 2)
    out = Counter()
    for s, size, aim in zip(order, sizes, aims, strict=True):
        whole = min(2, int(aim // size)) if size else 0
        rest = round(aim) - whole * size if whole < 2 else 0
        for _, _, i, n in sorted(r for r in rows if r[0] == s):
            taken = whole * n + max(0, min(n, rest))
            rest -= n
            out[i] += (2 * taken + n) // (2 * max(n, 1))
    return out


def test_run_equals_brute_force(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    only = lambda ids: docs.where(F.col("doc_id").isin(sorted(ids)))
    good = quality.learn(docs, labels)
    kept = {i for i, t in text.items() if good.score(quality.features(pa.array([t], pa.string())))[0] >= 0.5}
    scorer = toxicity.learn(only(kept), labels)
    w = scorer.coefficients

    def harmless(t):
        words = toxicity.fold(t or "").split()
        hits = [x for word in words for term, x in scorer.lexicon.weights.items() if (word == term.strip() if term.endswith(" ") else word.startswith(term.strip()) and len(word) >= len(term) - 1)]
        n, many = len(words), len(hits)
        odds = w[0] + w[1] * np.log1p(sum(hits)) + w[2] * np.log1p(100 * sum(hits) / (n + 20)) + w[3] * min(many, 3) + w[4] * np.log1p(100 * many / (n + 20))
        return 1 / (1 + np.exp(-odds)) < 0.5

    kept = {i for i in kept if harmless(text[i])}
    kept = {i for i, (_, root) in brute([(i, text[i]) for i in kept], 5).items() if root == i}
    library = Tokenizer.from_file(public("word_bpe_49k.json"))
    want = Counter()
    for i, copies in mixed_by_hand(only(kept)).items():
        ids = np.array([*library.encode(text[i] or "", add_special_tokens=False).ids, 1])
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), crc_of(ids[a : a + 4096])] += copies
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == +want
    tokens = sum(k[3] * n for k, n in want.items())
    assert len({r["sequence_id"] for r in rows}) <= -(-tokens // 4096) + 1


def test_stages_in_order_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "packing"]
    docs = read(spark, sf, "documents")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen and ids
        if name != "mixing":
            assert len(ids) == len(set(ids))
        seen = set(ids)


def test_stage_decisions_equal_the_operators(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    from tagloom.llm import quality, toxicity

    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(corpus_pipeline.keep_quality(spark, docs, sf)) == ids(quality.score(docs, labels).where("predicted = 1"))
    assert ids(corpus_pipeline.drop_toxic(spark, docs, sf)) == ids(toxicity.score(docs, labels).where("predicted = 0"))
    assert ids(corpus_pipeline.drop_near_copies(spark, docs, sf)) == ids(near_dedup.dedup(docs).where("kept"))


def test_run_packs_all_that_is_left(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_every_query_is_registered():
    import __spark_entry__

    own = __spark_entry__.queries()
    assert [n for n in sorted(own) if n.startswith("op")] == sorted(queries.QUERIES) and "pipeline" in own
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
