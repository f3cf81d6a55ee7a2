"""Column expressions against plain Python written from the rules."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import parse, text, tokens


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        (None, []), ("", []), ("  ", []), ("[]", []), ('["a","b"]', ["a", "b"]), ("['a', \"b's\"]", ["a", "b's"]), ("('a','b')", ["a", "b"]), ("['a',]", ["a"]), ("[None, 'a']", ["None", "a"]), ("[1, 2]", ["1", "2"]), ("a, b", ["a, b"]), ("[a", ["[a"]), ("['a,None,b']", ["a,None,b"]), ("['', 'x']", ["x"]),
    ],
)
def test_listish(spark, cell, want):
    assert one(spark, parse.listish, cell) == want


@pytest.mark.parametrize(("cell", "want"), [(None, []), ("a, b ,,c", ["a", "b", "c"]), ("[' a ', 'b']", ["a", "b"]), ("(a, b)", ["a", "b"]), ("[a, b", ["a", "b"]), ("one", ["one"])])
def test_listlike(spark, cell, want):
    assert one(spark, parse.listlike, cell) == want


@pytest.mark.parametrize(
    ("cell", "want"),
    [("American, Italian", ["American", "Italian"]), ("['Thai', 'Goan recipes']", ["Thai", "Goan"]), ("American & Italian", ["American", "Italian"]), ("South Indian Recipes", ["Indian"]), ("Northern-Style Thai", ["Style Thai"]), ("[American]", ["American"]), ("east recipes", []), ("A and B", ["A", "B"]), ("nan", ["Nan"])],
)
def test_split_labels(spark, cell, want):
    assert one(spark, parse.split_labels, cell) == want


def test_missing_labels(spark):
    for cell in (None, "", "nan", "None", "[]", " null "):
        assert one(spark, parse.labels_of, cell) == [] and one(spark, parse.first_label, cell) == ""
        assert one(spark, lambda c: parse.source_label(c, "unknown"), cell) == "unknown"
    assert one(spark, lambda c: parse.source_label(c, "unknown"), "['Thai']") == "Thai"
    assert one(spark, lambda c: parse.source_label(c, "unknown"), "['Thai', 'Lao']") == "['Thai', 'Lao']"


@pytest.mark.parametrize(("cell", "want"), [("mediteranean", "Mediterranean"), ("American, Kerala", "Indian"), ("kid friendly, Thai", "Thai"), ("friendly", "friendly"), ("['American']", "American"), ("middle-eastern", "Middle Eastern"), (None, "")])
def test_single_label(spark, cell, want):
    assert one(spark, parse.single_label, cell) == want


@pytest.mark.parametrize("name", ["o'brien A&b", "thai", "école du ÉTÉ", "a1b2 c-d", ""])
def test_titled_is_pythons(spark, name):
    assert one(spark, text.titled, name) == name.title()


def test_strip_is_pythons(spark):
    for s in (" a\t", " b ", "　c\n", "d"):
        assert one(spark, text.strip, s) == s.strip()


@pytest.mark.parametrize(("cell", "want"), [("Spinach (frozen)", "Spinach"), ("Brand® LLC beans", "Brand beans"), ("Acme corporation tea ( x ) y", "Acme tea y"), ("Company", ""), ("Brand Co. beans", "Brand Co. beans")])
def test_raw_text(spark, cell, want):
    assert one(spark, text.raw_text, cell) == want  # a suffix with a full stop ends at a word boundary


def test_last_item_is_split(spark):
    split = lambda v: one(spark, parse.split_last_and, v, "array<string>")
    assert split(["a", "salt and pepper"]) == ["a", "salt", "pepper"]
    assert split(["a and b", "c"]) == ["a and b", "c"] and split([]) == [] and split(["x and y and z"]) == ["x and y", "z"]


@pytest.mark.parametrize(
    ("token", "want"),
    [("salt salt", None), ("chicken slices", "chicken"), ("flour cup", "flour"), ("1/2 cup", "1/2"), ("28-ounce", None), ("onion onion soup mix", "onion"), ("a b c d e", None), ("pepper pepper", "pepper"), ("2 tbsp olive oil", "olive oil"), ("  ", None), ("tomato", "tomato")],
)
def test_token_pipeline(spark, token, want):
    assert one(spark, tokens.with_map, token) == want


def test_lookups_before_and_after(spark):
    table = F.create_map(F.lit("roma tomatoes"), F.lit("tomato"), F.lit("olive oil"), F.lit("oil"))
    assert one(spark, lambda c: tokens.with_map(c, table), "Roma Tomatoes") == "tomato"
    assert one(spark, lambda c: tokens.with_map(c, table), "2 cups olive oil") == "oil"
    frequency = F.create_map(F.lit("tomato"), F.lit(5).cast("bigint"), F.lit("red"), F.lit(1).cast("bigint"))
    assert one(spark, lambda c: tokens.with_map(c, None, frequency), "red tomato") == "tomato"
    assert one(spark, lambda c: tokens.with_map(c, canonicalizer=F.upper), "tea") == "TEA"


@pytest.mark.parametrize(("phrase", "want"), [("apples", "apples"), ("tomatoes", "tomato"), ("green onions", "onion"), ("chickens", "chicken"), ("onion powder", "onion powder"), ("carrots", "carrot"), ("plums", "plums")])
def test_canonical(spark, phrase, want):
    names = F.array(F.lit("tomato"), F.lit("carrot"))
    assert one(spark, lambda c: tokens.canonical(c, names), phrase) == want


@pytest.mark.parametrize(("phrase", "want"), [("2 cups chopped fresh basil leaves", "basil leaves"), ("large egg", "egg"), ("1 cup", None), ("extra virgin olive oil", "olive oil")])
def test_head_words(spark, phrase, want):
    assert one(spark, tokens.head_words, phrase) == want


@pytest.mark.parametrize(("phrase", "want"), [
    ("2 cups chopped fresh basil leaves", "basil leaves"), ("3 cups of all-purpose flour", "all purpose flour"), ("smoked powder", "smoked powder"), ("chopped powder", "powder"),
    ("tomato paste", "tomato paste"), ("chicken thighs, cut in pieces", "chicken thighs"), ("roasted red peppers in olive oil", "red peppers"), ("salt and pepper", "salt"), ("1 cup", None), ("", None), (None, None),
    ("with", "with"), ("aged cheese of france", "aged cheese"), ("freshly squeezed", "freshly squeezed"),
])
def test_head_phrase(spark, phrase, want):
    assert one(spark, tokens.head_phrase, phrase) == want


def test_similarity_of_phrases(spark):
    both = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.levenshtein_ratio(F.col("a"), F.col("b")), text.should_merge(F.col("a"), F.col("b"))).first()
    assert both("tomato", "tomatoe") == (1 - 1 / 7, True) and both("", "x") == (0.0, False)
    assert both("sea salt", "table salt")[1] is False and both("red bean", "bean soup")[1] is True


@pytest.mark.parametrize(("token", "junk"), [(None, True), ("400 g", True), ("16oz", True), ("28-ounce", True), ("basil", False), ("teacups", True), ("salt", True)])
def test_junk(spark, token, junk):
    assert one(spark, text.is_junk, token) is junk
