"""Queries over the tables of a folder, one for each operator, and the SQL that states the same result.

SQL is DuckDB's, over views named as the tables.  Lists are compared as joined
strings, doubles rounded to six digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .functions import lexicon, parse, text
from .operators import dictmap, entities, labels, models, network, pairs, recommend, report, sets, similarity, vocab
from .sources import readers
from .storage import shared_dir, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(column: str, items) -> str:
    return f"{column} IN ({', '.join(chr(39) + x + chr(39) for x in items)})"


def _parts(column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in lexicon.DROP_SUBSTRINGS) + ")"


def _dropped(column: str) -> str:
    return f"({column} = '' OR {_in(column, lexicon.DROP_TOKENS)} OR {_parts(column)})"


# --- vocabularies, encoders, dictionaries ---------------------------------------------------------------------------

_WORDS = r"SELECT doc_id, lang, unnest(string_split_regex(text, '\s+')) AS token FROM documents"


@query(f"SELECT token, count(*) AS count FROM ({_WORDS}) WHERE token <> '' GROUP BY token")
def vocab_counts(spark, sf_dir):
    return vocab.vocabulary(table(spark, sf_dir, "documents").select(text.words(F.col("text")).alias("words")), "words")


@query(f"SELECT token, count(*) AS count FROM ({_WORDS}) WHERE token <> '' GROUP BY token HAVING count(*) >= 20")
def vocab_min_freq(spark, sf_dir):
    return vocab.vocabulary(table(spark, sf_dir, "documents").select(text.words(F.col("text")).alias("words")), "words", 20)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("words"))


_TURNS = r"""turns AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS words FROM conversations),
tokens AS (SELECT conv_id, turn, unnest(words) AS raw, generate_subscripts(words, 1) AS pos FROM turns),
firsts AS (SELECT lower(raw) AS token, count(*) AS count, min({'a': conv_id, 'b': turn, 'c': pos}) AS f FROM tokens GROUP BY 1),
encoder AS (SELECT row_number() OVER (ORDER BY f) AS id, token, count FROM firsts)"""


@query(f"WITH {_TURNS} SELECT id, token, count FROM encoder")
def encode_ids_first_seen(spark, sf_dir):
    return vocab.fit_encoder(_turns(spark, sf_dir), "words", ["conv_id", "turn"])


@query(f"""WITH {_TURNS}, kept AS (SELECT * FROM encoder WHERE count >= 5),
lists AS (SELECT conv_id, turn, string_agg(coalesce(k.id, 0)::VARCHAR, ',' ORDER BY pos) AS ids FROM tokens t LEFT JOIN kept k ON k.token = lower(t.raw) GROUP BY 1, 2)
SELECT t.conv_id, t.turn, coalesce(l.ids, '0') AS ids FROM turns t LEFT JOIN lists l USING (conv_id, turn)""")
def encode_lists(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    encoder = vocab.fit_encoder(turns, "words", ["conv_id", "turn"]).where("count >= 5")
    return vocab.encode_lists(turns, "words", encoder, ["conv_id", "turn"], empty_as_unknown=True).select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {_TURNS}, kept AS (SELECT * FROM encoder WHERE count >= 5)
SELECT (SELECT count(*) FROM turns) AS rows, count(*) AS tokens, count(*) FILTER (k.id IS NULL) AS unknown FROM tokens t LEFT JOIN kept k ON k.token = lower(t.raw)""")
def encode_counters(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    encoder = vocab.fit_encoder(turns, "words", ["conv_id", "turn"]).where("count >= 5")
    return vocab.encode_counters(vocab.encode_lists(turns, "words", encoder, ["conv_id", "turn"]), "ids")


_DICTIONARY = (("the", "article"), ("a", "article"), ("an", "article"), ("and", "conjunction"), ("or", "conjunction"), ("for", "preposition"), ("le", "article"), ("la", "article"), ("der", "article"), ("de", "preposition"))
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _DICTIONARY)


def _mapping(spark: SparkSession) -> DataFrame:
    return dictmap.lookup_table(spark.createDataFrame(_DICTIONARY, "`from` string, `to` string"))


_NAMED = f"""map(k, v) AS (VALUES {_VALUES}),
words AS (SELECT DISTINCT token FROM ({_WORDS}) WHERE token <> ''),
once AS (SELECT token, coalesce(m.v, l.v, token) AS x FROM words LEFT JOIN map m ON m.k = token LEFT JOIN map l ON l.k = lower(token)),
twice AS (SELECT o.token, trim(coalesce(m.v, l.v, o.x)) AS name FROM once o LEFT JOIN map m ON m.k = o.x LEFT JOIN map l ON l.k = lower(o.x)),
names AS (SELECT token, name FROM twice WHERE NOT {_dropped('lower(name)')})"""


@query(f"WITH {_NAMED} SELECT token, name FROM names")
def dict_map_apply(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("token"))
    return dictmap.resolve_tokens(words, _mapping(spark))


@query(f"""WITH {_NAMED},
rows AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:120] AS w FROM documents),
cells AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM rows),
firsts AS (SELECT doc_id, name, min(pos) AS pos FROM cells JOIN names USING (token) GROUP BY 1, 2),
lists AS (SELECT doc_id, string_agg(name, ' ' ORDER BY pos) AS names FROM firsts GROUP BY 1)
SELECT doc_id, coalesce(names, '') AS names FROM documents LEFT JOIN lists USING (doc_id)""")
def dict_map_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("words"))
    names = dictmap.resolve_tokens(rows.select(F.explode("words").alias("token")), _mapping(spark))
    return dictmap.map_lists(rows, "words", names, ["doc_id"]).select("doc_id", F.array_join("words", " ").alias("names"))


@query(r"""WITH turns AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
firsts AS (SELECT conv_id, turn, t, min(p) AS p FROM (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM turns) GROUP BY 1, 2, 3),
lists AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY p) AS distinct_words FROM firsts GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(distinct_words, '') AS distinct_words FROM turns LEFT JOIN lists USING (conv_id, turn)""")
def order_preserving_dedupe(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_distinct("words"), " ").alias("distinct_words"))


_MERGED = "map AS (SELECT p_name AS k, CASE WHEN min(p_size) % 5 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS v FROM part GROUP BY 1)"


def _merged_names(spark, sf_dir):
    """from, to: names of parts, most of them merged into their first word."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("from")).agg(F.min("p_size").alias("size"))
    return names.select("from", F.when(F.col("size") % 5 == 0, F.col("from")).otherwise(F.split_part("from", F.lit(" "), F.lit(1))).alias("to"))


@query(f"WITH {_MERGED} SELECT count(*) AS entries, count(*) FILTER (k = v) AS identities, count(*) FILTER (k <> v) AS merges, count(DISTINCT v) AS targets FROM map")
def dedupe_summary(spark, sf_dir):
    return dictmap.summary(_merged_names(spark, sf_dir))[0]


@query(f"WITH {_MERGED} SELECT v AS \"to\", count(*) AS variants FROM map WHERE k <> v GROUP BY v ORDER BY variants DESC, v LIMIT 50")
def dedupe_top_targets(spark, sf_dir):
    return dictmap.summary(_merged_names(spark, sf_dir))[1]


# --- text functions ---------------------------------------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)', '', 'g'), '[®™©]', '', 'g'),
'\b(Inc\.|LLC|Ltd\.|Corp\.|Corporation|Company|Co\.)\b', '', 'gi'), '\s+', ' ', 'g')) AS clean FROM conversations""")
def clean_raw_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.raw_text(F.col("text")).alias("clean"))


_CELLS = """cells AS (SELECT n_nationkey, '[Southern-' || replace(n_name, '_', ' ') || ' Recipes]' AS one, replace(n_name, '_', ' ') || ' & west ' || r_name || ' recipe' AS two FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


def _label_cells(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = F.translate("n_name", "_", " ")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("[Southern-"), name, F.lit(" Recipes]")).alias("one"), F.concat(name, F.lit(" & west "), "r_name", F.lit(" recipe")).alias("two"))


@query(f"WITH {_CELLS}, names AS (SELECT n_nationkey, replace(replace(one, '[Southern-', ''), ' Recipes]', '') AS x FROM cells) SELECT n_nationkey, {_TITLE.format('x')} AS label FROM names")
def clean_label(spark, sf_dir):
    return _label_cells(spark, sf_dir).select("n_nationkey", text.label_name(F.col("one")).alias("label"))


@query(f"""WITH {_CELLS}, parts AS (SELECT n_nationkey, unnest(string_split(two, ' & ')) AS p, generate_subscripts(string_split(two, ' & '), 1) AS pos FROM cells),
clean AS (SELECT n_nationkey, pos, trim(regexp_replace(lower(p), '\\b(west|east|recipe)\\b *', '', 'g')) AS x FROM parts)
SELECT n_nationkey, pos - 1 AS pos, {_TITLE.format('x')} AS label FROM clean""")
def split_labels(spark, sf_dir):
    return _label_cells(spark, sf_dir).select("n_nationkey", F.posexplode(parse.split_labels(F.col("two"))).alias("pos", "label")).select("n_nationkey", F.col("pos").cast("bigint").alias("pos"), "label")


@query("""WITH cells AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ', ' || p_type ELSE p_name || '|' || p_brand END AS c FROM part)
SELECT p_partkey, replace(c, ', ', '|') AS items FROM cells""")
def parse_listlike(spark, sf_dir):
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(", "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("["), q(F.col("p_name")), F.lit(", "), q(F.col("p_brand")), F.lit("]"))).otherwise(F.concat(F.lit("("), q(F.col("p_name")), F.lit(", "), q(F.col("p_brand")), F.lit(",)")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.listlike(cell), "|").alias("items"))


@query(f"""WITH forms AS (SELECT p_partkey, p_name || 's' AS x, (SELECT list(DISTINCT p_name) FROM part WHERE p_size > 25) AS names FROM part)
SELECT p_partkey, CASE WHEN x LIKE '%es' AND list_contains(names, x[:-3]) THEN x[:-3] WHEN x NOT LIKE '%es' AND list_contains(names, x[:-2]) THEN x[:-2] ELSE x END AS name
FROM forms WHERE NOT {_in("string_split(x, ' ')[2]", lexicon.STOP_SUFFIXES)}""")
def canonical_plural(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.concat("p_name", F.lit("s")).alias("token")).where(~F.split("token", " ")[1].isin(*lexicon.STOP_SUFFIXES))
    found = dictmap.canonical_names(rows, part.where("p_size > 25").select(F.col("p_name").alias("name")))
    return rows.join(found, "token").select("p_partkey", "name")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_NAMES = "names AS (SELECT DISTINCT p_name AS x FROM part)"
_RATIO = "round(1 - levenshtein(lower(a.x), lower(b.x)) / greatest(length(a.x), length(b.x)), 6)"


@query(f"WITH {_NAMES} SELECT a.x AS name_a, b.x AS name_b, {_RATIO} AS ratio FROM names a JOIN names b ON a.x < b.x WHERE {_RATIO} >= 0.6")
def levenshtein_pairs(spark, sf_dir):
    return similarity.levenshtein_pairs(table(spark, sf_dir, "part"), "p_name", 0.6).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_NAMES} SELECT a.x AS name_a, b.x AS name_b FROM names a JOIN names b ON a.x < b.x
WHERE {_RATIO} >= 0.7 OR len(list_intersect(string_split(a.x, ' '), string_split(b.x, ' '))) > 0""")
def mergeable_pairs(spark, sf_dir):
    return similarity.mergeable_pairs(table(spark, sf_dir, "part"), "p_name")


# --- co-occurrence ----------------------------------------------------------------------------------------------------


def _baskets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return pairs.baskets(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_name")


_BASKETS = """raw AS (SELECT DISTINCT l_orderkey AS k, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT k, item FROM raw QUALIFY row_number() OVER (PARTITION BY k ORDER BY item) <= 60),
items AS (SELECT item, count(*) AS n FROM b GROUP BY 1),
pair AS (SELECT x.item AS ingredient_a, y.item AS ingredient_b, count(*) AS count FROM b x JOIN b y ON x.k = y.k AND x.item < y.item GROUP BY 1, 2)"""
_PMI = f"""{_BASKETS}, total AS (SELECT count(DISTINCT k) AS t FROM raw),
scored AS (SELECT ingredient_a, ingredient_b, count, ln(count * t::DOUBLE / (a.n * c.n)) AS pmi FROM pair JOIN items a ON a.item = ingredient_a JOIN items c ON c.item = ingredient_b, total WHERE count >= 3 AND a.n >= 3 AND c.n >= 3),
edges AS (SELECT * FROM scored WHERE pmi >= 0.000001),
near AS (SELECT ingredient_a AS node, ingredient_b AS other FROM edges UNION SELECT ingredient_b, ingredient_a FROM edges)"""


@query(f"WITH {_BASKETS} SELECT item, n FROM items")
def item_freq(spark, sf_dir):
    return pairs.item_counts(_baskets(spark, sf_dir))


@query(f"WITH {_BASKETS} SELECT ingredient_a, ingredient_b, count FROM pair")
def pair_counts(spark, sf_dir):
    return pairs.pair_counts(_baskets(spark, sf_dir))


def _edges(spark, sf_dir):
    return pairs.pmi(staged(_baskets(spark, sf_dir), "baskets"), min_count=3, min_pmi=0.000001)


@query(f"WITH {_PMI} SELECT ingredient_a, ingredient_b, count, round(pmi, 6) AS pmi FROM edges")
def pmi_pairs(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {_PMI} SELECT ingredient_a, ingredient_b, round(pmi, 6) AS pmi FROM edges ORDER BY round(pmi, 6) DESC, ingredient_a, ingredient_b LIMIT 20")
def pmi_top(spark, sf_dir):
    return _edges(spark, sf_dir).select("ingredient_a", "ingredient_b", F.round("pmi", 6).alias("pmi")).orderBy(F.desc("pmi"), "ingredient_a", "ingredient_b").limit(20)


@query(f"WITH {_PMI}, d AS (SELECT node AS ingredient, count(*) AS degree FROM near GROUP BY 1) SELECT ingredient, degree, round(degree / greatest((SELECT count(*) FROM d) - 1, 1), 6) AS degree_centrality FROM d")
def degree_centrality(spark, sf_dir):
    return network.degrees(_edges(spark, sf_dir)).withColumn("degree_centrality", F.round("degree_centrality", 6))


#: Counts of walks by length: the least length with one is the distance, and its count that of the shortest paths.
_PATHS = f"""{_PMI}, nodes AS (SELECT DISTINCT node FROM near),
walks AS (SELECT 0 AS k, node AS s, node AS t, 1::DOUBLE AS w FROM nodes UNION ALL SELECT * FROM (SELECT k + 1 AS k, s, other AS t, sum(w) AS w FROM walks JOIN near ON t = node WHERE k < 7 GROUP BY 1, 2, 3)),
short AS (SELECT s, t, min(k) AS d, arg_min(w, k) AS paths FROM walks GROUP BY 1, 2), size AS (SELECT count(*) AS n FROM nodes),
sources AS (SELECT node FROM nodes ORDER BY md5(node || ':42'), node LIMIT {{samples}}),
through AS (SELECT a.t AS node, sum(a.paths * b.paths / c.paths) AS b FROM short a JOIN sources ON a.s = sources.node JOIN short b ON a.t = b.s JOIN short c ON c.s = a.s AND c.t = b.t WHERE a.d + b.d = c.d AND a.d > 0 AND b.d > 0 GROUP BY 1),
central AS (SELECT node, round(coalesce(b, 0) * n / (SELECT count(*) FROM sources) / greatest((n - 1) * (n - 2), 1), 9) AS betweenness FROM nodes LEFT JOIN through USING (node), size)"""
_WALKS = f"{_PATHS} SELECT node, betweenness FROM central"


@query("WITH RECURSIVE " + _WALKS.format(samples=1_000_000))
def betweenness(spark, sf_dir):
    return network.betweenness(staged(_edges(spark, sf_dir), "edges")).withColumn("betweenness", F.round("betweenness", 9))


@query("WITH RECURSIVE " + _WALKS.format(samples=20))
def betweenness_sampled(spark, sf_dir):
    return network.betweenness(staged(_edges(spark, sf_dir), "edges"), samples=20).withColumn("betweenness", F.round("betweenness", 9))


@query(f"""WITH {_PMI}, clean AS (SELECT lower(ingredient_a) AS a, lower(ingredient_b) AS b, pmi FROM edges)
SELECT a, b, round(pmi, 6) AS pmi FROM clean WHERE NOT {_dropped('a')} AND NOT {_dropped('b')} AND a NOT LIKE '%ed' AND b NOT LIKE '%ed' AND length(a) > 2 AND length(b) > 2 AND a <> b
ORDER BY round(pmi, 6) DESC, a, b LIMIT 600""")
def ingredient_network(spark, sf_dir):
    rows = _edges(spark, sf_dir).select(text.network_name(F.col("ingredient_a")).alias("a"), text.network_name(F.col("ingredient_b")).alias("b"), F.round("pmi", 6).alias("pmi"))
    return rows.where("a is not null and b is not null and a <> b").orderBy(F.desc("pmi"), "a", "b").limit(600)


# --- labels, profiles, networks of labels -----------------------------------------------------------------------------


@query("SELECT lang, count(*) AS count FROM documents GROUP BY 1")
def label_support(spark, sf_dir):
    return labels.support(table(spark, sf_dir, "documents"), "lang")


@query("SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 120)")
def min_support_semi(spark, sf_dir):
    return labels.with_support(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 120).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) <= 50")
def downsample_per_label(spark, sf_dir):
    return labels.downsampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 50, [F.md5(F.col("doc_id").cast("string"))])


@query("SELECT r_name AS parent, count(*) AS count, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM (SELECT n_name FROM nation n2 WHERE n2.n_regionkey = r_regionkey ORDER BY n_name LIMIT 12)) AS labels FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def parent_rollup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("count"))
    named = counts.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return labels.parent_support(named, "n_name", "count", "r_name").select(F.col("r_name").alias("parent"), F.col("count").cast("bigint").alias("count"), F.array_join("labels", ",").alias("labels"))


@query("SELECT c_custkey, CASE r_name WHEN 'ASIA' THEN 'Asian' WHEN 'EUROPE' THEN 'Continental' ELSE r_name END AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def parent_lookup_alias(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("child"), F.col("r_name").alias("parent"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return labels.with_parent(rows, "n_name", tree, aliases={"asia": "Asian", "europe": "Continental"}).select("c_custkey", "parent")


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS label FROM documents")
def label_corrections(spark, sf_dir):
    cell = F.concat(F.lit("['American', '"), "lang", F.lit("']"))
    unquoted = F.regexp_replace(cell, "'", "")
    return table(spark, sf_dir, "documents").select("doc_id", parse.single_label(unquoted, {"fr": "French", "de": "German"}).alias("label"))


def _sold(spark, sf_dir, label: str):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", *([label] if label.startswith("p_") else []))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if not label.startswith("p_"):
        people = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(people, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col(label).alias("label"), F.col("p_name").alias("item"))


def _profile(spark, sf_dir, label="p_type"):
    return labels.profiles(_sold(spark, sf_dir, label), "label", "item")


_PROFILE = "profile AS (SELECT p_type AS label, p_name AS item, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {_PROFILE} SELECT * FROM profile")
def profile_counts(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(f"WITH {_PROFILE} SELECT label, item, freq, row_number() OVER (PARTITION BY label ORDER BY freq DESC, item) AS rank FROM profile QUALIFY rank <= 5")
def top_items_per_label(spark, sf_dir):
    return labels.top_items(_profile(spark, sf_dir), "label", "item", 5).withColumn("rank", F.col("rank").cast("bigint"))


_VOCAB = f"v AS (SELECT DISTINCT lang, lower(token) AS token FROM ({_WORDS}) WHERE token <> '')"


def _lang_words(spark, sf_dir, lang):
    return table(spark, sf_dir, "documents").where(F.col("lang") == lang).select(F.explode(text.words(F.lower("text"))).alias("token"))


@query(f"WITH {_VOCAB} SELECT token FROM v WHERE lang = 'fr' EXCEPT SELECT token FROM v WHERE lang = 'de'")
def novel_items_anti(spark, sf_dir):
    return sets.only_in_first(_lang_words(spark, sf_dir, "fr"), _lang_words(spark, sf_dir, "de"), "token")


@query(f"WITH {_VOCAB} SELECT token FROM v WHERE lang = 'fr' INTERSECT SELECT token FROM v WHERE lang = 'es'")
def shared_terms_intersect(spark, sf_dir):
    return sets.in_both(_lang_words(spark, sf_dir, "fr"), _lang_words(spark, sf_dir, "es"), "token")


@query("SELECT 1::INTEGER AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 2::INTEGER, s_suppkey, s_name FROM supplier")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return sets.numbered_union(a, b)


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def except_items(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return sets.only_in_first(table(spark, sf_dir, "part"), sold, "p_partkey")


_BRANDS = "w AS (SELECT p_brand AS label, p_name AS term, count(*) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY w DESC, term) <= 15)"


@query(f"""WITH {_BRANDS}, both_ AS (SELECT a.label AS label_a, b.label AS label_b, a.term, a.w + b.w AS t FROM w a JOIN w b ON a.term = b.term AND a.label < b.label)
SELECT label_a, label_b, count(*) AS shared, CAST(sum(t) AS BIGINT) AS score, array_to_string(list(term ORDER BY t DESC, term)[1:10], ',') AS terms FROM both_ GROUP BY 1, 2 HAVING count(*) >= 4""")
def label_similarity_edges(spark, sf_dir):
    out = network.shared_terms(_profile(spark, sf_dir, "p_brand"), "label", "item", "freq", min_shared=4, top=15)
    return out.withColumn("terms", F.array_join("terms", ","))


_NATIONS = "p AS (SELECT n_name AS label, r_name AS parent, p_name AS item, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"


@query(f"""WITH {_NATIONS}, u AS (SELECT parent, item, sum(freq) AS f FROM p GROUP BY 1, 2)
SELECT a.parent AS label_a, b.parent AS label_b, count(*) AS shared, CAST(sum(a.f + b.f) AS BIGINT) AS score FROM u a JOIN u b ON a.item = b.item AND a.parent < b.parent GROUP BY 1, 2 HAVING count(*) >= 2""")
def parent_similarity_edges(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    up = network.rolled_up(_profile(spark, sf_dir, "n_name"), "label", "item", "freq", tree, "n_name", "r_name")
    return network.shared_terms(up, "parent", "item", "freq").drop("terms")


_JUNK = r"({0} = '' OR {1} OR {2} OR regexp_matches({0}, '\b\d+\s*(oz|ounce|ounces|g|gram|grams|ml|litre|liter)\b') OR regexp_matches({0}, '\d+-\s*ounce'))"


def _junk(c: str) -> str:
    return _JUNK.format(c, _in(c, lexicon.DROP_TOKENS), _parts(c))


_TOP = f"top AS (SELECT label, item FROM profile QUALIFY row_number() OVER (PARTITION BY label ORDER BY freq DESC, item) <= 25)"


@query(f"""WITH {_PMI}, {_PROFILE}, {_TOP},
links AS (SELECT label, node AS name, list(DISTINCT other ORDER BY other) AS items FROM near JOIN top ON other = item WHERE NOT {_junk('item')} AND NOT {_junk('node')} GROUP BY 1, 2),
r AS (SELECT a.label AS label_a, b.label AS label_b, a.name, CAST(len(a.items) * len(b.items) AS DOUBLE) AS score, array_to_string(a.items[1:3], ',') AS connects_a, array_to_string(b.items[1:3], ',') AS connects_b FROM links a JOIN links b ON a.name = b.name AND a.label < b.label)
SELECT label_a, label_b, name, score, connects_a, connects_b FROM r QUALIFY row_number() OVER (PARTITION BY label_a, label_b ORDER BY score DESC, name) <= 10""")
def bridge_items(spark, sf_dir):
    profile = staged(_profile(spark, sf_dir), "profile")
    found = recommend.bridges(_edges(spark, sf_dir), profile, recommend.label_pairs(profile), top_n=25)
    return found.select("label_a", "label_b", "name", "score", F.array_join("connects_a", ",").alias("connects_a"), F.array_join("connects_b", ",").alias("connects_b"))


@query(f"""WITH {_PMI}, {_PROFILE}, {_TOP},
deg AS (SELECT node, count(*) AS d FROM near GROUP BY 1), n AS (SELECT count(*) AS n FROM deg),
cent AS (SELECT node, d / greatest(n - 1, 1) AS c FROM deg, n),
mine AS (SELECT label, item, c FROM top JOIN cent ON node = item),
cut AS (SELECT label, quantile_cont(c, 0.5) AS q FROM mine GROUP BY 1),
partner AS (SELECT m.label, item, c FROM mine m JOIN cut USING (label) WHERE c >= q),
r AS (SELECT t.label AS label_a, p.label AS label_b, t.item AS name, p.item AS pairs_with, c FROM top t JOIN near e ON e.node = t.item JOIN partner p ON e.other = p.item WHERE t.label < p.label AND NOT {_junk('t.item')} AND NOT EXISTS (SELECT 1 FROM top x WHERE x.label = p.label AND x.item = t.item))
SELECT label_a, label_b, name, pairs_with FROM r QUALIFY row_number() OVER (PARTITION BY label_a, label_b ORDER BY c DESC, name, pairs_with) <= 10""")
def novel_items(spark, sf_dir):
    profile = staged(labels.top_items(_profile(spark, sf_dir), "label", "item", 25).drop("rank"), "profile")
    edges = staged(_edges(spark, sf_dir), "edges")
    central = network.degrees(edges).select(F.col("ingredient").alias("item"), F.col("degree_centrality").alias("centrality"))
    return recommend.novel(edges, profile, recommend.label_pairs(profile), central, 25).select("label_a", "label_b", "name", "pairs_with")


@query(f"""WITH RECURSIVE {_PATHS.format(samples=500)}, {_PROFILE},
p AS (SELECT label, item FROM profile QUALIFY row_number() OVER (PARTITION BY label ORDER BY freq DESC, item) <= 30),
links AS (SELECT label, node AS name, list(DISTINCT other ORDER BY other) AS items FROM near JOIN p ON other = item WHERE NOT {_junk('item')} AND NOT {_junk('node')} GROUP BY 1, 2),
r AS (SELECT a.label AS label_a, b.label AS label_b, a.name, len(a.items) * len(b.items) * (1 + coalesce(betweenness, 0)) AS score, array_to_string(a.items[1:3], ',') AS ca, array_to_string(b.items[1:3], ',') AS cb FROM links a JOIN links b ON a.name = b.name AND a.label < b.label LEFT JOIN central ON node = a.name),
bridge AS (SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY score DESC, name) AS k FROM r QUALIFY k <= 10),
bridged AS (SELECT label_a, label_b, string_agg(name || ':' || round(score * 1000)::BIGINT || ':' || ca || ':' || cb, ';' ORDER BY k) AS bridges FROM bridge GROUP BY 1, 2),
mine AS (SELECT label, item, betweenness AS c FROM p JOIN central ON node = item), cut AS (SELECT label, quantile_cont(c, 0.5) AS q FROM mine GROUP BY 1),
partner AS (SELECT label, item, c FROM mine JOIN cut USING (label) WHERE c >= q),
f AS (SELECT t.label AS label_a, x.label AS label_b, t.item AS name, x.item AS pairs_with, c FROM p t JOIN near e ON e.node = t.item JOIN partner x ON e.other = x.item WHERE t.label <> x.label AND NOT {_junk('t.item')} AND NOT EXISTS (SELECT 1 FROM p y WHERE y.label = x.label AND y.item = t.item)),
novel AS (SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY c DESC, name, pairs_with) AS k FROM f QUALIFY k <= 10),
fresh AS (SELECT label_a, label_b, string_agg(name || ':' || pairs_with || ':1', ';' ORDER BY k) AS items FROM novel GROUP BY 1, 2), names AS (SELECT DISTINCT label FROM p)
SELECT a.label || ' + ' || b.label AS pair, coalesce(bridges, '') AS bridges, coalesce(x.items, '') AS novel_from_a, coalesce(y.items, '') AS novel_from_b
FROM names a JOIN names b ON a.label < b.label LEFT JOIN bridged g ON g.label_a = a.label AND g.label_b = b.label LEFT JOIN fresh x ON x.label_a = a.label AND x.label_b = b.label LEFT JOIN fresh y ON y.label_a = b.label AND y.label_b = a.label""")
def fusion_pairs(spark, sf_dir):
    profile = staged(labels.top_items(_profile(spark, sf_dir), "label", "item", 30).drop("rank"), "profile")
    edges = staged(_edges(spark, sf_dir), "edges")
    central = staged(network.betweenness(edges, samples=500).select(F.col("node").alias("item"), F.round("betweenness", 9).alias("centrality")), "central")
    out = recommend.fusions(edges, profile, recommend.label_pairs(profile), central, 0.6)
    bridge = F.transform("bridges", lambda b: F.concat_ws(":", b["name"], F.round(b["score"] * 1000).cast("bigint").cast("string"), F.array_join(b["connects_a"], ","), F.array_join(b["connects_b"], ",")))
    novel = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["pairs_with"], x["strength"].cast("string"))), ";").alias(c)
    return out.select("pair", F.array_join(bridge, ";").alias("bridges"), novel("novel_from_a"), novel("novel_from_b"))


@query(f"""WITH {_PMI}, {_PROFILE}, deg AS (SELECT node AS item, count(*) AS d FROM near GROUP BY 1),
f AS (SELECT label, item FROM profile QUALIFY row_number() OVER (PARTITION BY label ORDER BY freq DESC, item) <= 20)
SELECT label, item, row_number() OVER (PARTITION BY label ORDER BY d DESC, item) AS rank FROM f JOIN deg USING (item) QUALIFY rank <= 10""")
def top_central_items(spark, sf_dir):
    central = network.degrees(_edges(spark, sf_dir)).select(F.col("ingredient").alias("item"), F.col("degree_centrality").alias("centrality"))
    return recommend.top_central(_profile(spark, sf_dir), central, 10).select("label", "item", F.col("rank").cast("bigint").alias("rank"))


# --- reports ----------------------------------------------------------------------------------------------------------


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return report.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


_CLASSES = """c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), names AS (SELECT t AS l FROM c UNION SELECT p FROM c),
r AS (SELECT l, coalesce(sum(n) FILTER (t = l), 0) AS s, coalesce(sum(n) FILTER (p = l), 0) AS g, coalesce(sum(n) FILTER (t = l AND p = l), 0) AS h FROM names, c GROUP BY l),
m AS (SELECT l::VARCHAR AS label, CASE WHEN g > 0 THEN h / g ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS re, s, h FROM r),
k AS (SELECT label, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, s, h FROM m)"""


@query(f"""WITH {_CLASSES} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, CAST(s AS BIGINT) AS support FROM k
UNION ALL SELECT 'accuracy', round(sum(h) / sum(s), 6), round(sum(h) / sum(s), 6), round(sum(h) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(s) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(sum(pr * s) / sum(s), 6), round(sum(re * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM k""")
def classification_report(spark, sf_dir):
    out = report.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM c),
r AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM c GROUP BY lang)), k AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM c GROUP BY source))
SELECT round((b.x - r.x * k.x / (t * (t - 1) / 2)) / ((r.x + k.x) / 2 - r.x * k.x / (t * (t - 1) / 2)), 6) AS ari FROM b, r, k""")
def adjusted_rand(spark, sf_dir):
    return report.adjusted_rand(table(spark, sf_dir, "documents"), "lang", "source").select(F.round("ari", 6).alias("ari"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1")
def cluster_pivot(spark, sf_dir):
    return report.pivoted(table(spark, sf_dir, "documents"), "source", "lang")


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) AS k FROM n a, n b GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, max(s / greatest(k - 1, 1)) FILTER (own = c) AS a, min(s / k) FILTER (own <> c) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def squared_silhouette(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label")
    return report.squared_silhouette(rows, "v", "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 6) AS median FROM customer GROUP BY 1")
def median_threshold(spark, sf_dir):
    return report.quantile(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", 0.5, "median").withColumn("median", F.round("median", 6))


@query("""WITH c AS (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1), s AS (SELECT r_name, n / sum(n) OVER () AS share FROM c)
SELECT r_name, round(share, 6) AS share, round(sum(share) OVER (ORDER BY r_name), 6) AS cumulative FROM s""")
def cumulative_share(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counts = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    out = models.cumulative_share(counts.crossJoin(F.broadcast(total)).select("r_name", (F.col("n") / F.col("t")).alias("share")), "share", "r_name")
    return out.select("r_name", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


# --- similarity -------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.3")
def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3, "label").withColumn("cosine", F.round("cosine", 6))


@query(f"SELECT a.vec_id AS id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY rank <= 3")
def topk_neighbors(spark, sf_dir):
    return similarity.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, "label").select("id", "neighbor", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH RECURSIVE n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
low AS (SELECT a.vec_id, list(b.vec_id) AS nb FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE {_COS} >= 0.3 GROUP BY 1),
o AS (SELECT n.vec_id, i, coalesce(nb, []) AS nb FROM n LEFT JOIN low USING (vec_id)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders UNION ALL SELECT o.i, CASE WHEN list_has_any(leaders, nb) THEN leaders ELSE list_append(leaders, o.vec_id) END FROM r JOIN o ON o.i = r.i + 1),
f AS (SELECT leaders FROM r ORDER BY i DESC LIMIT 1)
SELECT vec_id, CASE WHEN list_contains(leaders, vec_id) THEN vec_id ELSE list_min(list_intersect(leaders, nb)) END AS leader FROM o, f""")
def leader_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    near = similarity.cosine_pairs(rows, "vec_id", "embedding", 0.3, "label")
    return similarity.leaders(rows.select("vec_id", F.col("vec_id").alias("rank")), near, "vec_id", "rank", "id_a", "id_b")


@query(f"""WITH RECURSIVE t AS (SELECT lower(p_name) AS token, count(*) AS count FROM part GROUP BY 1), n AS (SELECT token, row_number() OVER (ORDER BY count DESC, length(token), token) AS i, ' ' || token || ' ' AS s FROM t),
g AS (SELECT token, (unicode(s[p]) * 961 + unicode(s[p + 1]) * 31 + unicode(s[p + 2])) % 256 AS d FROM (SELECT token, s, unnest(range(1, length(s) - 1)) AS p FROM n)),
c AS (SELECT token, d, count(*) AS k FROM g GROUP BY 1, 2), z AS (SELECT token, sqrt(sum(k * k)) AS z FROM c GROUP BY 1),
dots AS (SELECT a.token AS x, b.token AS y, sum(a.k * b.k) AS dot FROM c a JOIN c b ON a.d = b.d AND a.token <> b.token GROUP BY 1, 2),
low AS (SELECT u.i, list(v.i) AS nb FROM dots JOIN n u ON u.token = x JOIN n v ON v.token = y JOIN z zx ON zx.token = x JOIN z zy ON zy.token = y WHERE v.i < u.i AND dot / (zx.z * zy.z) >= 0.613 AND len(list_intersect(string_split(x, ' '), string_split(y, ' '))) > 0 GROUP BY 1),
o AS (SELECT n.i, token, coalesce(nb, []) AS nb FROM n LEFT JOIN low USING (i)),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders UNION ALL SELECT o.i, CASE WHEN list_has_any(leaders, nb) THEN leaders ELSE list_append(leaders, o.i) END FROM r JOIN o ON o.i = r.i + 1),
f AS (SELECT leaders FROM r ORDER BY i DESC LIMIT 1),
m AS (SELECT i, token, CASE WHEN list_contains(leaders, i) THEN i ELSE list_min(list_intersect(leaders, nb)) END AS leader FROM o, f),
best AS (SELECT leader, arg_min(token, i) AS name FROM m WHERE NOT {_in('token', lexicon.GENERIC)} GROUP BY 1)
SELECT token AS "from", name AS "to" FROM m JOIN best USING (leader) WHERE token <> name""")
def phrase_dedupe(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("token")).agg(F.count("*").alias("count"))
    return similarity.dedupe_phrases(names, 0.613, generic=lexicon.GENERIC)


@query()
def word2vec_dedupe(spark, sf_dir):
    lists = _baskets(spark, sf_dir)
    phrases = vocab.vocabulary(lists, "items", 3)
    words = lists.select(F.flatten(F.transform("items", lambda x: F.split(F.lower(x), " "))).alias("words"))
    vectors = models.phrase_vectors(words, "words", phrases, dims=16)
    return similarity.dedupe_phrases(phrases, 0.6, vectors=vectors, levenshtein=0.7, identities=True)


# --- sources and entities ---------------------------------------------------------------------------------------------


@query("""SELECT 1::INTEGER AS "Dataset_ID", p_partkey AS "index", p_name AS ingredients, p_type AS cuisine FROM part
UNION ALL SELECT 2::INTEGER, item_id, text, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'the' ELSE 'unknown' END FROM benchmark WHERE regexp_matches(text, '(?i)\\bthe\\b')""")
def combine_raw(spark, sf_dir):
    a = readers.unified(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("Ingredients"), F.col("p_type").alias("Type")), 1, row_index="p_partkey")
    b = readers.unified(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ingredient")), 2, known_labels=["the"], row_index="item_id")
    return a.unionByName(b)


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS x FROM benchmark), known AS (SELECT x FROM w WHERE length(x) > 4),
d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS x, generate_subscripts(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), 1) AS pos FROM documents)
SELECT doc_id, arg_min(x, pos) AS hit FROM d SEMI JOIN known USING (x) GROUP BY 1""")
def vocabulary_scan(spark, sf_dir):
    """The first word of the benchmark's vocabulary, or name of a part, in every document: thousands of labels in one pass."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("x")).where(F.length("x") > 4)
    known = [r["x"] for r in words.union(table(spark, sf_dir, "part").select("p_name")).distinct().collect()]  # a vocabulary: its size is checked where it is sent
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return readers.first_labels(docs, "text", known, "hit").where("hit IS NOT NULL").select("doc_id", F.lower("hit").alias("hit"))


@query(r"""SELECT doc_id, lower(regexp_extract(text, '(?i)\b(trash|idiot|clown)\b', 1)) AS hit FROM documents WHERE regexp_matches(text, '(?i)\b(trash|idiot|clown)\b')""")
def regex_vocab_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ingredients"))
    return readers.unified(rows, 1, known_labels=["trash", "idiot", "clown"], row_index="doc_id").select(F.col("index").alias("doc_id"), F.col("cuisine").alias("hit"))


def _menu(spark, sf_dir):
    cell = F.concat(F.lit("Fresh "), "p_name", F.lit(" (boxed), 2 cups "), "p_type", F.lit(" and "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("text"))


def _entities(spark, sf_dir):
    names = spark.createDataFrame([("red ring", "ring"), ("economy", "cheap")], "key string, value string")
    encoder = spark.createDataFrame([(1, "ring"), (2, "cheap"), (3, "blue bolt")], "id int, token string")
    return entities.tall(_menu(spark, sf_dir), "p_partkey", "text", names, encoder)


@query(f"""WITH i AS (SELECT p_partkey, unnest(['Fresh ' || p_name, '2 cups ' || p_type, p_brand]) AS e, unnest([0, 1, 2]) AS pos FROM part),
t AS (SELECT *, list_filter(regexp_extract_all(lower(e), '[a-z0-9]+'), lambda x: NOT ({_in('x', lexicon.DESCRIPTIVE)} OR {_in('x', lexicon.UNITS)} OR regexp_matches(x, '^\\d+$'))) AS w FROM i),
n AS (SELECT p_partkey, pos, e, CASE WHEN len(w) = 0 THEN lower(e) ELSE array_to_string(w[-2:], ' ') END AS norm FROM t),
c AS (SELECT *, CASE norm WHEN 'red ring' THEN 'ring' WHEN 'economy' THEN 'cheap' ELSE norm END AS canonical FROM n)
SELECT p_partkey AS row_id, pos::INTEGER AS pos, e AS ent_text, length(e)::INTEGER AS "end", norm, canonical, CASE canonical WHEN 'ring' THEN 1 WHEN 'cheap' THEN 2 WHEN 'blue bolt' THEN 3 ELSE 0 END::BIGINT AS id FROM c""")
def ner_tall(spark, sf_dir):
    return _entities(spark, sf_dir).select("row_id", "pos", "ent_text", "end", "norm", "canonical", "id")


_WIDE = f"""i AS (SELECT p_partkey, unnest(['Fresh ' || p_name, '2 cups ' || p_type, p_brand]) AS e, unnest([0, 1, 2]) AS pos FROM part),
t AS (SELECT *, list_filter(regexp_extract_all(lower(e), '[a-z0-9]+'), lambda x: NOT ({_in('x', lexicon.DESCRIPTIVE)} OR {_in('x', lexicon.UNITS)} OR regexp_matches(x, '^\\d+$'))) AS w FROM i),
n AS (SELECT p_partkey, pos, e, CASE WHEN len(w) = 0 THEN lower(e) ELSE array_to_string(w[-2:], ' ') END AS norm FROM t),
c AS (SELECT *, CASE norm WHEN 'red ring' THEN 'ring' WHEN 'economy' THEN 'cheap' ELSE norm END AS canonical FROM n),
k AS (SELECT *, CASE canonical WHEN 'ring' THEN 1 WHEN 'cheap' THEN 2 WHEN 'blue bolt' THEN 3 ELSE 0 END AS id FROM c)"""


@query(f"""WITH {_WIDE}, f AS (SELECT p_partkey, canonical, min(pos) AS p FROM k GROUP BY 1, 2), u AS (SELECT p_partkey, string_agg(canonical, '|' ORDER BY p) AS clean FROM f GROUP BY 1),
s AS (SELECT p_partkey, string_agg(e, '|' ORDER BY pos) AS raw, string_agg(id::VARCHAR, '|' ORDER BY pos) AS ids, '[' || string_agg('{{"raw":"' || e || '","start":0,"end":' || length(e) || ',"label":"INGREDIENT","norm":"' || norm || '","canonical":"' || canonical || '","id":' || id || '}}', ',' ORDER BY pos) || ']' AS spans FROM k GROUP BY 1)
SELECT p_partkey AS row_id, raw, clean, ids, spans AS spans_json FROM s JOIN u USING (p_partkey)""")
def ner_wide(spark, sf_dir):
    out = entities.wide(_menu(spark, sf_dir), "p_partkey", "text", _entities(spark, sf_dir))
    return out.select("row_id", F.array_join("NER_raw", "|").alias("raw"), F.array_join("NER_clean", "|").alias("clean"), F.array_join(F.col("Ingredients").cast("array<string>"), "|").alias("ids"), "spans_json")


@query(f"WITH {_WIDE} SELECT round(count(*) FILTER (id = 0) / count(*), 6) AS zero_id_share, 0.0::DOUBLE AS single_id_share FROM k")
def ner_diagnostics(spark, sf_dir):
    out = entities.diagnostics(entities.wide(_menu(spark, sf_dir), "p_partkey", "text", _entities(spark, sf_dir)))
    return out.withColumn("zero_id_share", F.round("zero_id_share", 6))


# --- models -----------------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark),
tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * max(n)),
w AS (SELECT item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), s AS (SELECT item_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1)
SELECT item_id, term, round(w / s, 6) AS weight FROM w JOIN s USING (item_id)""")
def tfidf_weights(spark, sf_dir):
    return models.tfidf_weights(table(spark, sf_dir, "benchmark"), "item_id", "text", min_df=2).withColumn("weight", F.round("weight", 6))


def _features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return models.tfidf_vectors(docs, "text")


@query()
def logreg_report(spark, sf_dir):
    rows, _ = _features(spark, sf_dir)
    rows = staged(rows.select("doc_id", "lang", "features"), "features")
    train, test = models.split_by_hash(rows, "doc_id")
    return report.classification_report(models.predicted(models.logistic(train, "lang"), test, "lang"), "y_true", "y_pred")


@query()
def kmeans_clusters(spark, sf_dir):
    rows, _ = _features(spark, sf_dir)
    return models.clustered(staged(rows.select("doc_id", "lang", "features"), "features")).select("doc_id", "lang", "cluster")


@query()
def random_forest(spark, sf_dir):
    rows, _ = _features(spark, sf_dir)
    rows = staged(rows.select("doc_id", "lang", "features"), "features")
    train, test = models.split_by_hash(rows, "doc_id")
    return models.predicted(models.forest(train, "lang"), test, "lang").select("doc_id", "y_true", "y_pred")


def _svd(spark, sf_dir):
    weights = staged(models.tfidf_weights(table(spark, sf_dir, "documents"), "doc_id", "text"), "weights")
    entries, terms = models.indexed_terms(weights, "doc_id")
    return *models.randomised_svd(entries, len(terms), 10), entries, terms


@query()
def svd_terms(spark, sf_dir):
    values, vectors, _, entries, terms = _svd(spark, sf_dir)
    total = entries.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 1.0
    found = models.component_terms(vectors.tolist(), terms, 10)
    return spark.createDataFrame([(*r, float(values[r[0]]) ** 2 / total) for r in found], "component int, direction string, rank int, term string, weight double, share double")


@query()
def svd_projections(spark, sf_dir):
    return _svd(spark, sf_dir)[2].withColumnRenamed("key", "doc_id")


# --- streaming --------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    """Event-time windows over the table as a stream of files, run until all files are read."""
    schema = table(spark, sf_dir, "events").schema
    stream = readers.stream_parquet(spark, f"{sf_dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streaming.windowed_counts(stream, "ts", "event_type", "1 day").select("start", "event_type", "n")
    where = f"{shared_dir(spark)}/tagloom-daily-{uuid.uuid4().hex}"
    streaming.run_to_table(counts, f"{where}/rows", f"{where}/state")
    return spark.read.schema(counts.schema).parquet(f"{where}/rows")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item pairs by pointwise mutual information."""
    return QUERIES["pmi_pairs"](spark, sf_dir)

