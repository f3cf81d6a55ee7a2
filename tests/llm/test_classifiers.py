import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import langid, quality, toxicity
from tagloom.llm.learning import logistic

from .conftest import ODD


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def texts(rng, n, junk):
    words = ["harbor", "light", "stone", "river", "meadow", "winter", "letter", "garden"]
    out = []
    for i in range(n):
        ws = [rng.choice(words) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(20, 80))]
        out.append((i, " ".join(w.upper() + "!!" for w in ws) if junk(i) else " ".join(ws).capitalize() + "."))
    return out


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(3)
    rows = texts(rng, 300, lambda i: i % 5 == 0)
    rows = [(i, t + (" you idiot moron" if i % 7 == 0 else "")) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(300)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return make_docs(rows), labels


def test_quality_of_held_out_rows(labelled):
    got = {r["doc_id"]: r for r in quality.score(*labelled).collect()}
    assert len(got) == 300 and all(r["held_out"] == (held(i, 3) == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    wrong = [i for i, r in got.items() if r["held_out"] and r["predicted"] != int(i % 5 != 0)]
    assert not wrong


def test_toxicity_of_held_out_rows(labelled):
    got = {r["doc_id"]: r for r in toxicity.score(*labelled).collect()}
    assert all(r["held_out"] == (held(i, 5) == 0) for i, r in got.items())
    assert [i for i, r in got.items() if r["held_out"] and r["predicted"] != int(i % 7 == 0)] == []


def test_filters_keep_rows_whole(labelled):
    docs, labels = labelled
    good = quality.accepted(docs, labels)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i in range(300) if i % 5}
    calm = toxicity.accepted(docs, labels)
    assert {r["doc_id"] for r in calm.collect()} == {i for i in range(300) if i % 7}


def test_odd_rows_and_no_labels(spark, make_docs, labelled):
    docs, none = make_docs(ODD), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}
        assert len(module.score(docs, labelled[1]).collect()) == len(ODD)
        assert module.score(make_docs([]), labelled[1]).collect() == []
    ones = spark.createDataFrame([(i, 1, 0) for i, _ in ODD if i], "doc_id bigint, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in quality.score(docs, ones).collect())


def test_features_of_empty_texts():
    x = quality.features(pa.array([None, "", " ", "One two. Two ONE!\none two. two one!", "a" * 300_000]))
    assert np.isfinite(x).all() and not x[0].any() and not x[1].any()
    assert x[3][quality.FEATURES.index("repeated_lines")] == 0.5


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    assert ((quality.fit(x, y).score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("text", ["you Idiot", "1d10t", "ID|OT!", "ідіоt", "і​diot", "ïdïöt", "𝐢𝐝𝐢𝐨𝐭", "@n idi0t."])
def test_disguises(text):
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 2.0})
    assert lexicon.measures(text)[0] == 2.0


def test_words_stems_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 1.0, " gru": 3.0})
    assert lexicon.measures("the trash can")[0] == 0 and lexicon.measures("trash can trash")[0] == 1.0
    assert lexicon.measures("trashy")[0] == 0 and lexicon.measures("gruffly Grue")[:2] == (6.0, 2.0)
    assert lexicon.measures("")[:2] == (0.0, 0.0)
    assert toxicity.fold("Price $5, 28 pages!!!").split() == ["price", "s", "pages"] or "pages" in toxicity.fold("Price $5, 28 pages!!!")


def test_logistic_edges():
    assert logistic(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]
    assert logistic(np.ones((4, 1)), np.ones(4))[0] > 1


LANGS = {"en": "the and of to in that which with from this", "de": "der die und das nicht ein ich zu mit sich", "fr": "le la et les des que une dans pour est"}


def language_rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(6, 40))), lang) for i in range(n) for lang in [sorted(LANGS)[i % 3]]]


def test_languages_of_held_out_rows(make_docs):
    rows = language_rows(240) + [(1000, "12 345 ² !!", "en"), (1001, None, "de"), (1002, "the and of", None)]
    got = {r["doc_id"]: r for r in langid.predict(make_docs(rows)).collect()}
    assert all(r["held_out"] == (held(i, 3) == 1) for i, r in got.items())
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:240] if got[i]["held_out"])
    assert (got[1000]["lang_pred"], got[1001]["lang_pred"], got[1002]["lang_pred"]) == ("und", "und", "en")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == 0


def test_language_edges(make_docs):
    assert {r["lang_pred"] for r in langid.predict(make_docs([(i, t, None) for i, t in ODD])).collect()} == {"und"}
    assert langid.predict(make_docs([])).collect() == []


def test_vectors_equal_plain_binding():
    e = langid.Encoder(dims=64)
    text = langid.letters("Abc ab")
    want = np.zeros(64)
    for i in range(len(text) - 2):
        v = np.ones(64)
        for place, c in enumerate(text[i : i + 3]):
            v *= np.roll(e.letter_vector(ord(c)), place)
        want += v
    assert (e.vectors(["Abc ab"])[0] == want).all()
    small = langid.Encoder(dims=64, most_grams=4)
    assert (small.vectors(["Abc ab", "other words"]) == e.vectors(["Abc ab", "other words"])).all()


def test_known_and_new_grams_at_the_cap():
    e = langid.Encoder(dims=64)
    texts = ["Abc ab", "abc other words", "ab", "words abc ab and yet more of them", "Abc ab"]
    for most in (1, 4, 9, 14, 20):
        small = langid.Encoder(dims=64, most_grams=most)
        for text in [*texts, *texts[::-1]]:
            assert (small.vectors([text]) == e.vectors([text])).all()
            assert len(small.codes) == len(small.table) <= most


def test_rare_and_many_languages_are_learned(make_docs):
    rows = [(i, "the and of to in that", "en") for i in range(3000)] + [(5000 + i, "der die und das nicht ein", "de") for i in range(8)]
    assert langid.learn(make_docs(rows), most_rows=60)[0] == ["de", "en"]
    many = [(i, f"word{chr(97 + i % 26)}", f"x{i:04d}") for i in range(1800)]
    langs = langid.learn(make_docs(many), encoder=langid.Encoder(dims=8))[0]
    assert langs == [lang for i, _, lang in many if held(i, 3) != 1] and len(langs) > 1000
    assert [langid.even(x, 10) for x in ([], [3], [2, 100], [1, 4, 50], [20, 20])] == [0, 3, 8, 5, 5]


def test_rare_toxic_words_are_terms_and_copies_are_not(spark):
    toxic = [f"plain number{chr(97 + i % 26)} idiot here{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    toxic = [t + (" vermin" if i % 300 == 0 else "") for i, t in enumerate(toxic)] + ["copied sentence about harmless gardens"] * 30
    rows = [(t, 1) for t in toxic] + [(f"plain text of row{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", 0) for i in range(2000)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert lexicon.measures("vermin")[1] and lexicon.measures("idiot")[1]
    assert not lexicon.measures("gardens")[1]


def test_words_with_other_letters_are_not_matched(spark):
    rows = [(f"you fail number{chr(97 + i % 26)}{chr(97 + i // 26)}", 1) for i in range(100)]
    rows += [(f"leaves fall in autumn{chr(97 + i % 26)}{chr(97 + i // 26)}", 0) for i in range(300)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert lexicon.measures("they fall")[1] == 0 and lexicon.measures("they fail")[1] and lexicon.measures("they fa1l f@il FAIL")[1] == 3


def test_exceptions_are_learned(spark):
    number = lambda i: f"x{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(f"you clown {number(i)}", 1) for i in range(200)] + [(f"a clown fish swims {number(i)}", 0) for i in range(12)] + [(f"plain {number(i)}", 0) for i in range(600)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), exceptions=())
    assert "clown fish" in {x.strip() for x in lexicon.exceptions}
    assert lexicon.measures("the clown fish")[1] == 0 and lexicon.measures("a clown")[1] == 1
    assert lexicon.measures("what a clown you are")[1] == lexicon.measures("you")[1] + 1


@pytest.mark.parametrize("article", ["a", "the", "that", "this"])
def test_articles_excuse_nothing(spark, article):
    number = lambda i: f"x{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(f"you clown {number(i)}", 1) for i in range(200)] + [(f"{article} clown fish swims {number(i)}", 0) for i in range(30)] + [(f"plain {article} row {number(i)}", 0) for i in range(40)] + [(f"plain {number(i)}", 0) for i in range(600)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), exceptions=())
    assert {x.strip() for x in lexicon.exceptions} == {"clown fish"}
    assert lexicon.measures(f"what {article} clown you are")[1] == lexicon.measures("you")[1] + 1 and lexicon.measures(f"{article} clown fish")[1] == 0


def test_a_phrase_with_the_words_own_rate_is_no_exception(spark):
    number = lambda i: f"x{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(f"sad clown {number(i)}", 1) for i in range(100)] + [(f"clown {number(i)}", 1) for i in range(100)] + [(f"sad clown harm{number(i)}", 0) for i in range(6)] + [(f"plain {number(i)}", 0) for i in range(600)]
    assert toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), exceptions=()).exceptions == ()


def test_few_toxic_rows_teach_terms_too(spark):
    number = lambda i: f"x{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(f"you scoundrel {number(i)}", 1) for i in range(4)] + [(f"odd {number(40 + i)}", 1) for i in range(6)] + [(f"plain {number(i)}", 0) for i in range(80)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), exceptions=())
    assert lexicon.measures("a scoundrel")[1] == 1 and lexicon.measures("odd plain row")[1] <= 1



def test_vowel_signs_belong_to_their_words():
    assert langid.letters("कार, हिन्दी 12") == " कार हिन्दी "
    assert langid.letters("́ ²") == ""


def test_filters_on_empty_tables_and_odd_texts(spark, make_docs, labelled):
    for module in (quality, toxicity):
        empty = module.accepted(make_docs([]), labelled[1])
        assert empty.collect() == []
        odd = module.accepted(make_docs(ODD), labelled[1]).collect()
        assert {(r["doc_id"], r["text"]) for r in odd} <= set(ODD)


def test_samples_are_bounded_by_rows(spark, make_docs):
    from pyspark.sql import functions as F

    from tagloom.llm.learning import labelled as chosen

    docs = make_docs([(1, f"text {i}") for i in range(3000)] + [(2, "same")] * 500 + [(i, "x") for i in range(3, 60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    got = chosen(docs, labels, "quality", F.lit(True), 300).collect()
    assert 100 < len(got) < 500 and len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    # copies of a row count once whatever the bound is, and don't crowd out others
    few = make_docs([(1, "same")] * 50 + [(2, "other")])
    two = labels.where("doc_id IN (1, 2)")
    assert all(sorted((r["doc_id"], r["text"]) for r in chosen(few, two, "quality", F.lit(True), most).collect()) == [(1, "same"), (2, "other")] for most in (20, 1000))


def plain_prediction(rows, texts, dims=512):
    """Prototypes and cosines n-gram by n-gram, without tables or batches."""
    e = langid.Encoder(dims=dims)

    def vector(text):
        s = langid.letters(text)
        s = s + " " * max(0, 3 - len(s)) if s else s
        v = np.zeros(dims)
        for i in range(len(s) - 2):
            g = np.ones(dims)
            for place, c in enumerate(s[i : i + 3]):
                g *= np.roll(e.letter_vector(ord(c)), place)
            v += g
        return v / (np.linalg.norm(v) or 1)

    sums = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and held(i, 3) != 1:
            sums[lang] = sums.get(lang, 0) + vector(text)
    table = {lang: v / (np.linalg.norm(v) or 1) for lang, v in sums.items()}
    out = []
    for text in texts:
        v = vector(text)
        cos = sorted(((float(v @ p), lang) for lang, p in table.items()), key=lambda x: (-x[0], x[1]))
        out.append((cos[0][1], max(0.0, cos[0][0])) if v.any() and cos else ("und", 0.0))
    return out


def test_predictions_equal_brute_force(make_docs):
    rows = language_rows(90, seed=4) + [(500 + i, t, "en" if i % 2 else None) for i, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in langid.predict(make_docs(rows)).collect()}
    for (i, _, _), (lang, score) in zip(rows, plain_prediction(rows, [t for _, t, _ in rows]), strict=True):
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4, i


def test_quality_scores_equal_plain_additions():
    rng = np.random.default_rng(2)
    x = rng.random((400, 4))
    model = quality.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    cells = [[sum(row[k] >= edge for edge in model.edges[k]) for k in range(4)] for row in x]
    for row, c, p in zip(x, cells, model.score(x), strict=True):
        odds = model.start + sum(float(model.tables[k][c[k]]) for k in range(4)) + sum(float(t[model.coarse[i][c[i]], model.coarse[j][c[j]]]) for (i, j), t in model.pairs.items())
        assert abs(1 / (1 + np.exp(-odds)) - p) < 1e-6, row


def test_toxicity_scores_equal_a_plain_scan(labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels)
    terms = model.lexicon.weights
    for r in docs.limit(80).collect():
        words = toxicity.fold(r["text"] or "").split()
        hits = [w for word in words for term, w in terms.items() if (term.strip() == word if term.endswith(" ") else len(word) >= len(term) - 1 and word.startswith(term.strip()))]
        total, many, n = model.lexicon.measures(r["text"] or "")
        assert abs(total - sum(hits)) < 1e-9 and many == len(hits) and n == len(words)
