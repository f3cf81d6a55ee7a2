"""Repeated passages against a list of all windows, on the given table, made-up and odd texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import suffix_dedup as S
from tagloom.llm.common import read

from .conftest import ODD


def by_hand(texts, length):
    """(bytes, removed runs, kept bytes) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]]))).tolist()
        out.append((len(r), list(zip(edges[::2], [b - a for a, b in zip(edges[::2], edges[1::2], strict=True)], strict=True)), bytes(np.frombuffer(r, np.uint8)[~flags])))
    return out


def compare(make_docs, texts, setting):
    docs = make_docs(list(enumerate(texts))).repartition(5)
    found = {r["doc_id"]: r for r in S.without_repeats(docs, setting).collect()}
    for i, (size, spans, kept) in enumerate(by_hand(texts, setting.length)):
        assert (found[i]["n_bytes"], [tuple(s) for s in found[i]["spans"]], bytes(found[i]["kept"])) == (size, spans, kept), (i, texts[i])
    assert len(found) == len(texts)


def passages(seed, n):
    """Texts that share passages, whole, cut and edited."""
    rng = random.Random(seed)
    text = lambda size: "".join(rng.choice("abcdefghij é🙂") for _ in range(size))
    shared = [text(rng.randint(20, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(shared)
            kind = rng.random()
            if kind < 0.3:
                p = text(rng.randint(0, 60))
            elif kind < 0.5:
                p = p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)]
            elif kind < 0.6:
                k = rng.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            parts.append(p)
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("setting", [S.Setting(20, 6), S.Setting(12, 3)])
def test_shared_passages(make_docs, setting):
    compare(make_docs, passages(setting.word, 120), setting)


def test_many_phrases_of_one_trigger(make_docs, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    compare(make_docs, passages(9, 120), S.Setting(20, 6))


def test_low_entropy(make_docs):
    rng = random.Random(4)
    texts = ["a" * n for n in (19, 20, 21, 300)] + ["ab" * 40, "ba" * 30, "abc" * 25 + "d" + "abc" * 9, "", None, "x" * 10]
    texts += ["".join(rng.choice("ab") for _ in range(200)) for _ in range(12)]
    compare(make_docs, texts, S.Setting(20, 6))


def test_one_text_repeats_itself_and_copies_go(make_docs):
    once = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(60))
    compare(make_docs, [once + "!" + once, "unlike " * 3 + "anything else here at all", "twice the same text, long enough", "twice the same text, long enough"], S.Setting(20, 6))


def test_windows_of_exactly_the_length(make_docs):
    p = "".join(random.Random(1).choice("abcdefgh") for _ in range(20))
    compare(make_docs, ["1" * 9 + p + "2" * 9, "3" * 9 + p, p + "4" * 9, "5" * 9 + p[:19], p[1:] + "6" * 9], S.Setting(20, 6))


def test_odd_texts(make_docs):
    rows = [*ODD, (1, "again 1"), (None, None)]
    docs = make_docs(rows).selectExpr("*", "1 AS key", "2 AS pack", "3 AS runs", "4 AS trigger", "5 AS n")
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.digests(docs).collect())
    want = []
    for (i, _), (size, spans, kept) in zip(rows, by_hand([t for _, t in rows], 200), strict=True):
        want.append((i is None, i or 0, size, sum(n for _, n in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    assert found == sorted(want)


def test_empty_table(make_docs):
    assert S.digests(make_docs([])).collect() == []


def test_pieces_change_nothing():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    ends = np.array([700, 700, 701, 2500, 5000])
    whole = S.parse(raw, ends, S.Setting(40, 9))
    before, S.PIECE = S.PIECE, 64
    try:
        small = S.parse(raw, ends, S.Setting(40, 9))
    finally:
        S.PIECE = before
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    covered = sum(int(b) - int(a) + 1 for _, a, b in zip(*whole, strict=True))
    assert covered == sum(max(0, n - 39) for n in (700, 0, 1, 1799, 2500))


def test_the_given_table(spark, sf):
    docs = read(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in S.digests(docs).collect()}
    for r, (size, spans, kept) in zip(rows, by_hand([r["text"] for r in rows], 200), strict=True):
        f = found[r["doc_id"]]
        assert (f["n_bytes"], f["n_removed"], f["n_spans"], f["kept_sha256"]) == (size, sum(n for _, n in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_neighbours_are_compared_to_the_length():
    flags = S.equal_neighbours([b"abcdefgh", b"xbcdefgy", b"cdefg"], 5)
    assert [f.tolist() for f in flags] == [[False, True, True, False], [False, True, True, False], [True]]
