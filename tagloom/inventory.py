"""Further queries, one or more for each source, sink, function and operator that `queries` doesn't run by itself, with their SQL.

Files are written to the shared folder and read back by the library's readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon, parse, text, tokens
from .operators import dictmap, entities, labels, models, multilabel, network, order, recommend, report, tagging, vocab
from .queries import _CELLS, _PMI, _TITLE, _dropped, _edges, _in, _label_cells, _profile, _turns, query, table
from .sources import readers, writers
from .storage import shared_dir, staged


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tagloom-{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str, header: str) -> str:
    """One file of a header and the lines `value` in order of k."""
    head = df.sparkSession.createDataFrame([(None, header)], "k bigint, value string")
    head.union(df.select("k", "value")).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


def _hash(*parts: str) -> str:
    """The first 32 bits of an MD5 digest, as the library splits and orders by."""
    return f"('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8))::BIGINT"


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ' é' AS p_name FROM part")
def csv_windows_charset(spark, sf_dir):
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(","), "p_name", F.lit(" é"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.encode(line, "ISO-8859-1").cast("string").alias("value"))
    return readers.read_csv(spark, _lines(rows, _place(spark, "charset"), "p_partkey,p_name"))


@query("""SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role || '
"' || role || '"' AS role FROM conversations""")
def csv_quoted_lines(spark, sf_dir):
    quoted = F.concat("role", F.lit('\n"'), "role", F.lit('"'))
    path = _place(spark, "quoted")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", quoted.alias("role")).write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.read_csv(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type FROM part WHERE p_partkey % 3 <> 0")
def csv_malformed_lines(spark, sf_dir):
    cells = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_type", F.lit("one"), F.lit("more"))).otherwise(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", "p_type"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), cells.alias("value"))
    return readers.read_csv(spark, _lines(rows, _place(spark, "malformed"), "p_partkey,p_name,p_type"), drop_malformed=True)


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def two_column_scan(spark, sf_dir):
    return readers.limited(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"])


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part ORDER BY part.p_partkey LIMIT 150")
def csv_first_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    return readers.read_csv(spark, _lines(rows, _place(spark, "first"), "p_partkey,p_name"), rows=150)


@query("SELECT doc_id, lang FROM (SELECT * FROM documents LIMIT 120) WHERE lang IS NOT NULL")
def two_column_first_rows(spark, sf_dir):
    return readers.limited(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"], rows=120)


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def appended_table(spark, sf_dir):
    path = _place(spark, "appended")
    writers.parquet(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), path)
    writers.parquet(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), path, append=True)
    return spark.read.parquet(path)


@query("SELECT p_name FROM part WHERE p_size > 40")
def pruned_scan(spark, sf_dir):
    return readers.read_table(spark, f"{sf_dir}/part.parquet").where("p_size > 40").select("p_name")


@query("SELECT count(*)::BIGINT AS rows, sum(len(string_split(p_name, ' ')))::BIGINT AS items FROM part")
def list_column_scan(spark, sf_dir):
    path = _place(spark, "lists") + ".csv"
    items = F.split("p_name", " ")
    table(spark, sf_dir, "part").select(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")).alias("items")).write.csv(path, header=True, escape='"')
    return readers.list_column(spark, path, "items").agg(F.count("*").alias("rows"), F.sum(F.size("items")).cast("bigint").alias("items"))


@query("""WITH m AS (SELECT upper(p_name) AS k, p_type AS v FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1)
SELECT k AS key, v AS value FROM m UNION ALL SELECT lower(k), v FROM m""")
def jsonl_map_files(spark, sf_dir):
    path = _place(spark, "map")
    rows = table(spark, sf_dir, "part").groupBy(F.upper("p_name").alias("from")).agg(F.max_by("p_type", "p_partkey").alias("to"))
    writers.jsonl_map(rows, path)
    return readers.jsonl_map(spark, path)


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
k AS (SELECT conv_id, turn, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM t)
SELECT row_number() OVER (ORDER BY min({'a': conv_id, 'b': turn, 'c': pos})) AS id, lower(raw) AS token FROM k GROUP BY lower(raw)""")
def encoder_json_files(spark, sf_dir):
    paths = [_place(spark, "ids") + ".json", _place(spark, "tokens") + ".json"]
    writers.encoder_json(vocab.fit_encoder(_turns(spark, sf_dir), "words", ["conv_id", "turn"]), *paths)
    return readers.encoder_json(spark, *paths)


@query("SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def parent_map_file(spark, sf_dir):
    path = _place(spark, "parents") + ".json"
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()  # 25 names
    writers._text(spark, path, json.dumps({f" {k} ": v for k, v in rows} | {"": "none", "blank": " "}))
    return readers.json_object(spark, path, "child", "parent")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def allowed_labels_file(spark, sf_dir):
    path = _place(spark, "allowed") + ".json"
    n = table(spark, sf_dir, "nation")
    writers._text(spark, path, json.dumps([r[0] for r in n.where("n_regionkey in (1, 3)").select("n_name").collect()]))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return labels.with_support(rows, "n_name", 1, readers.allowed_labels(spark, path, "n_name"))


@query("SELECT lang, count(*)::VARCHAR AS count FROM documents GROUP BY 1")
def csv_report_files(spark, sf_dir):
    path = _place(spark, "report") + ".csv"
    writers.csv_report(labels.support(table(spark, sf_dir, "documents"), "lang"), path)
    return readers.read_table(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, 'parquet' AS kind FROM part UNION ALL SELECT s_suppkey::VARCHAR, s_name, 'csv' FROM supplier")
def tables_by_suffix(spark, sf_dir):
    base = _place(spark, "tables")
    writers.parquet(table(spark, sf_dir, "part").select("p_partkey", "p_name"), f"{base}.parquet")
    writers.csv_report(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_name")), f"{base}.csv")
    both = [readers.read_table(spark, f"{base}.{kind}").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", F.lit(kind).alias("kind")) for kind in ("parquet", "csv")]
    return both[0].unionByName(both[1])


_REGIONS = "pairs AS (SELECT a.r_name AS label_a, b.r_name AS label_b FROM region a JOIN region b ON a.r_name < b.r_name)"


@query(f"WITH {_REGIONS} SELECT label_a || ' + ' || label_b AS pair, replace(label_a, ' ', '') AS one, replace(label_b, ' ', '') AS two, 1::BIGINT AS bridges FROM pairs")
def fusion_report_files(spark, sf_dir):
    folder = _place(spark, "fusions")
    bridge = F.array(F.struct(F.lit("x").alias("name"), F.lit(1.5).alias("score"), F.array(F.lit("p")).alias("connects_a"), F.array(F.lit("q")).alias("connects_b")))
    novel = F.from_json(F.lit("[]"), "array<struct<name:string,pairs_with:string,strength:bigint>>")
    found = recommend.label_pairs(table(spark, sf_dir, "region").select(F.col("r_name").alias("label")))
    writers.fusion_files(found.select(F.concat_ws(" + ", "label_a", "label_b").alias("pair"), "label_a", "label_b", bridge.alias("bridges"), novel.alias("novel_from_a"), novel.alias("novel_from_b")), folder)
    writers._text(spark, f"{folder}/fusion_bad_file.json", "{not json")
    back = readers.fusion_reports(spark, f"{folder}/fusion_*.json")
    return back.select("pair", F.col("labels")[0].alias("one"), F.col("labels")[1].alias("two"), F.size("bridges").cast("bigint").alias("bridges"))


_TRAIN = f"d AS (SELECT p_partkey, pos - 1 AS pos, x AS text, CASE WHEN {_hash('42', 'p_partkey', '(pos - 1)')} < 858993459 THEN 'valid' ELSE 'train' END AS split FROM (SELECT p_partkey, unnest([p_name, p_type]) AS x, unnest([1, 2]) AS pos FROM part))"


def _training(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", "p_type").alias("items"))
    path = _place(spark, "train")
    writers.shards(entities.training_documents(rows, "p_partkey", "items"), path, rows=100)
    return spark.read.parquet(path)


@query(f"""WITH {_TRAIN} SELECT p_partkey, pos::INTEGER AS pos, text, 0::INTEGER AS start, length(text)::INTEGER AS "end", 'INGREDIENT' AS label, split FROM d""")
def training_shards(spark, sf_dir):
    return _training(spark, sf_dir).withColumn("split", F.col("split").cast("string"))


@query(f"WITH {_TRAIN} SELECT split, count(*) AS count FROM d GROUP BY 1")
def training_metadata(spark, sf_dir):
    return readers.training_metadata(_training(spark, sf_dir).withColumn("split", F.col("split").cast("string")), "split", ["p_partkey", "pos"])[0]


@query(f"WITH {_TRAIN} SELECT p_partkey, pos::INTEGER AS pos, text, split FROM d ORDER BY md5(text), text, p_partkey, pos LIMIT 10")
def training_sample(spark, sf_dir):
    return readers.training_metadata(_training(spark, sf_dir).withColumn("split", F.col("split").cast("string")), "split", ["p_partkey", "pos"])[1]


@query(f"WITH {_TRAIN} SELECT p_partkey, pos::INTEGER AS pos, row_number() OVER (ORDER BY md5('45:' || p_partkey || ':' || pos), p_partkey, pos) AS place FROM d QUALIFY place <= 150")
def training_epoch(spark, sf_dir):
    return readers.training_epoch(_training(spark, sf_dir), ["p_partkey", "pos"], 3, most=150).select("p_partkey", "pos", F.col("place").cast("bigint").alias("place"))


def _walk(n: str, seed: int) -> str:
    """SQL of the keyed permutation of x among n rows, on a grid of a lines and b columns."""
    digest = lambda k, v: f"('0x' || substr(md5('{seed}:{k}:' || ({v})::VARCHAR), 1, 8))::BIGINT"

    def moved(x: str) -> str:
        line, column = f"({x} // b)", f"({x} % b)"
        for k in (0, 2):
            line = f"(({line} + {digest(k, column)}) % a)"
            column = f"(({column} + {digest(k + 1, line)}) % b)"
        return f"({line} * b + {column})"

    return f"list_reduce(list_concat([{moved('x')}], range(0, 64)), lambda x, step: CASE WHEN x < {n} THEN x ELSE {moved('x')} END)"


@query(f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS x FROM part), g AS (SELECT n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM (SELECT count(*) AS n FROM part)),
p AS (SELECT p_partkey, {_walk("n", 45)} AS place FROM r, g)
SELECT p_partkey, place % 3 AS worker, place FROM p""")
def epoch_by_worker(spark, sf_dir):
    rows = order.numbered(table(spark, sf_dir, "part").select("p_partkey"), [F.col("p_partkey")], "x", 0)
    n = rows.count()
    parts = [readers.epoch_of_worker(rows, "x", n, 3, worker, 3).select("p_partkey", F.lit(worker).cast("bigint").alias("worker"), "place") for worker in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PHRASES = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '2 cups of ' || p_name WHEN 1 THEN p_type || ' with ' || p_name WHEN 2 THEN 'Finely chopped ' || p_name || ' Oil' WHEN 3 THEN '3 large ' || split_part(p_name, ' ', 1) || 'ed powder, ' || p_type ELSE '2 tbsp' END AS t FROM part"


def _list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


@query(rf"""WITH p AS ({_PHRASES}), w AS (SELECT p_partkey, regexp_extract_all(lower(t), '([a-z0-9]+|,)', 1) AS ws FROM p),
t AS (SELECT *, array_to_string(list_transform(ws, lambda x: CASE WHEN x = 'of' THEN 'O' WHEN x IN (',', {_list(lexicon.FUNCTION_WORDS)}) THEN 'F' WHEN x IN ({_list(lexicon.UNITS)}) OR regexp_matches(x, '^\d+$') THEN 'U' WHEN x IN ({_list(lexicon.DESCRIPTIVE)}) THEN 'D' WHEN regexp_matches(x, '^(.{{3,}}ed|.{{4,}}ing|.{{3,}}ly)$') THEN 'M' ELSE 'W' END), '') AS tags FROM w),
c AS (SELECT *, regexp_extract(tags, '^[^FO]*') AS one, regexp_extract(tags, '^[^FO]*O([^FO]*)', 1) AS two FROM t),
d AS (SELECT *, CASE WHEN contains(one, 'W') THEN one ELSE two END AS part, CASE WHEN contains(one, 'W') THEN 0 ELSE length(one) + 1 END AS start FROM c),
r AS (SELECT *, length(regexp_extract(part, '(W+)[^W]*$', 1)) AS run, start + length(regexp_extract(part, '^(.*?)W+[^W]*$', 1)) AS spot FROM d),
b AS (SELECT *, length(regexp_extract(substr(tags, start + 1, spot - start), 'M[^M]*$')) AS before, list_filter(ws, lambda x: x <> ',' AND NOT (x IN ({_list(lexicon.DESCRIPTIVE)}) OR x IN ({_list(lexicon.UNITS)}) OR regexp_matches(x, '^\d+$'))) AS kept FROM r)
SELECT p_partkey, CASE WHEN run = 0 THEN CASE WHEN len(kept) > 0 THEN array_to_string(kept[greatest(len(kept) - 1, 1):], ' ') END WHEN run = 1 AND ws[spot + 1] IN ({_list(lexicon.GENERIC_HEADS)}) AND before > 0 THEN ws[spot - before + 1] || ' ' || ws[spot + 1] ELSE array_to_string(ws[spot + 1:spot + run], ' ') END AS head FROM b""")
def head_phrases(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    k = F.col("p_size") % 5
    text = F.when(k == 0, F.concat(F.lit("2 cups of "), name)).when(k == 1, F.concat(kind, F.lit(" with "), name)).when(k == 2, F.concat(F.lit("Finely chopped "), name, F.lit(" Oil"))).when(k == 3, F.concat(F.lit("3 large "), first, F.lit("ed powder, "), kind)).otherwise("2 tbsp")
    return table(spark, sf_dir, "part").select("p_partkey", tokens.head_phrase(text).alias("head"))


@query(f"""WITH kept AS (SELECT p_type FROM part GROUP BY 1 HAVING count(*) >= 30)
SELECT p_partkey, (pos - 1)::INTEGER AS pos, x AS text, p_type, CASE WHEN {_hash('42', 'p_partkey', '(pos - 1)')} < 858993459 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS x, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) JOIN kept USING (p_type)""")
def classifier_documents(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kept = part.groupBy("p_type").agg(F.count("*").alias("n")).where("n >= 30")
    return entities.classifier_documents(part.select("p_partkey", "p_type", F.split("p_name", " ").alias("items")), "p_partkey", "items", "p_type", kept)


def _described_parts(spark, sf_dir):
    """p_partkey, text, spans: descriptions of parts in three wordings, with the places of their names, types and brands."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    wordings = ((("", "p_brand", "BRAND"), (" of ", "p_name", "NAME"), (", ", "p_type", "TYPE")), (("", "p_name", "NAME"), (" (", "p_type", "TYPE"), (") by ", "p_brand", "BRAND")), (("the ", "p_type", "TYPE"), (": ", "p_name", "NAME")))
    texts, spans = F.lit(None), F.lit(None)
    for k, wording in enumerate(wordings):
        text, found = F.lit(""), []
        for before, column, label in wording:
            text = F.concat(text, F.lit(before))
            found.append(F.struct(F.length(text).alias("start"), (F.length(text) + F.length(column)).alias("end"), F.lit(label).alias("label")))
            text = F.concat(text, column)
        chosen = F.pmod(F.xxhash64("p_partkey"), F.lit(len(wordings))) == k
        texts, spans = F.when(chosen, text).otherwise(texts), F.when(chosen, F.array(*found)).otherwise(spans)
    return part.select("p_partkey", texts.alias("text"), spans.cast(tagging.SPANS).alias("spans"))


@query()
def span_tagger_report(spark, sf_dir):
    """Precision, recall and F1 of a tagger that learned where parts' names, types and brands are, on other parts."""
    train, valid = models.split_by_hash(_described_parts(spark, sf_dir), "p_partkey")
    return tagging.evaluated(valid, tagging.train(train, valid, ["p_partkey"]))


@query()
def multilabel_report(spark, sf_dir):
    """Precision, recall and F1 of languages and marks of documents, learned from other documents' words."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("marks"))
    docs = table(spark, sf_dir, "documents").join(marks, "doc_id").select("doc_id", models.terms(F.col("text")).alias("words"), F.concat("marks", F.array_compact(F.array("lang"))).alias("cats"))
    train, valid = models.split_by_hash(staged(docs, "marked"), "doc_id")
    return multilabel.evaluated(valid, multilabel.train(train, valid, ["doc_id"], "words", "cats"), "words", "cats")


@query(f"WITH {_PMI} SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM edges) AS links, round((SELECT sum(pmi) FROM edges), 4) AS weight FROM near")
def gexf_file(spark, sf_dir):
    path = _place(spark, "graph") + ".gexf"
    writers.gexf(_edges(spark, sf_dir), path)
    lines = spark.read.text(path)
    weight = F.regexp_extract("value", r'weight="([^"]+)"', 1).try_cast("double")
    return lines.agg(F.count_if(F.col("value").startswith("<node id")).alias("nodes"), F.count_if(F.col("value").startswith("<edge id")).alias("links"), F.round(F.sum(weight), 4).alias("weight"))


_VARIANTS = "m AS (SELECT p_name || ' ' || p_brand AS k, CASE WHEN p_size % 4 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS v FROM (SELECT DISTINCT p_name, p_brand, p_size FROM part) QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size) = 1)"


def _variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_size").alias("s"))
    name = F.concat_ws(" ", "p_name", "p_brand")
    return rows.select(name.alias("from"), F.when(F.col("s") % 4 == 0, name).otherwise(F.col("p_name")).alias("to"))


@query(f"WITH {_VARIANTS} SELECT count(*) AS entries, count(*) FILTER (k = v) AS identities, count(*) FILTER (k <> v) AS merges, count(DISTINCT v) AS targets, least(count(DISTINCT v) FILTER (k <> v), 50) AS listed, least(count(*) FILTER (k <> v), 20) AS examples FROM m")
def summary_file(spark, sf_dir):
    path = _place(spark, "summary") + ".json"
    writers.summary_json(_variants(spark, sf_dir), path)
    back = spark.read.json(path, multiLine=True)
    return back.select("entries", "identities", "merges", "targets", F.size("top_targets").cast("bigint").alias("listed"), F.size("examples").cast("bigint").alias("examples"))


@query(f"""WITH {_VARIANTS} SELECT v AS "to", count(*) AS variants FROM m WHERE k <> v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def dictionary_top_targets(spark, sf_dir):
    return dictmap.summary(_variants(spark, sf_dir))[1]


# --- filters, sampling, columns ---------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('benchmark', 'text', NULL), ('conversations', 'text', 'role'), ('part', 'p_name', 'p_type')) AS t(name, record, label)")
def detected_columns(spark, sf_dir):
    rows = []
    for name in ("benchmark", "conversations", "part"):
        columns = table(spark, sf_dir, name).columns
        rows.append((name, readers.found_column(columns, ("p_name", "TEXT")), readers.found_column(columns, ("role", "kind"), "P_TYPE")))
    return spark.createDataFrame(rows, "name string, record string, label string")


@query("SELECT p_partkey, p_name, p_name AS ner FROM part")
def vocabulary_column(spark, sf_dir):
    return readers.with_column(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "ner", ("items", "P_NAME"))


_FLAGGED = "cells AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Kid Friendly' WHEN 1 THEN '[' || c_mktsegment WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE c_mktsegment END AS label FROM customer)"


def _flagged(spark, sf_dir):
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, F.lit("Kid Friendly")).when(k == 1, F.concat(F.lit("["), "c_mktsegment")).when(k == 2, F.lit("  ")).when(k == 4, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))


@query(f"WITH {_FLAGGED} SELECT c_custkey, label FROM cells WHERE c_custkey % 5 = 4")
def usable_labels(spark, sf_dir):
    return labels.usable(_flagged(spark, sf_dir), "label")


@query(f"""WITH {_CELLS} SELECT {_TITLE.format("replace(replace(one, '[Southern-', ''), ' Recipes]', '')")} AS "from", (SELECT upper(r_name[1]) || lower(r_name[2:]) FROM region JOIN nation n ON n_regionkey = r_regionkey WHERE n.n_nationkey = cells.n_nationkey AND r_name <> 'MIDDLE EAST') AS "to" FROM cells
WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'MIDDLE EAST')""")
def label_mapping(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = _label_cells(spark, sf_dir).join(n, "n_nationkey").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    target = F.when(F.col("r_name") == "MIDDLE EAST", F.lit("friendly")).otherwise(F.col("r_name"))
    mapping = rows.select(F.col("n_nationkey").alias("line"), F.col("one").alias("from"), target.alias("to"))
    same = rows.select((F.col("n_nationkey") - 100).alias("line"), F.col("one").alias("from"), F.col("one").alias("to"))
    return dictmap.label_mapping(mapping.union(same), "line")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) BETWEEN 21 AND 70")
def sample_slice(spark, sf_dir):
    return order.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", start=20, stop=70)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 60")
def sample_rows(spark, sf_dir):
    return order.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", n=60)


@query(f"SELECT doc_id, lang FROM documents WHERE {_hash('42', 'doc_id')} < 429496729")
def sample_share(spark, sf_dir):
    return order.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", share=0.1)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 30")
def sample_head(spark, sf_dir):
    return order.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", head=30)


@query(f"SELECT doc_id, CASE WHEN {_hash('42', 'doc_id')} < 858993459 THEN 'test' ELSE 'train' END AS split FROM documents")
def train_test_split(spark, sf_dir):
    train, test = models.split_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("split", F.lit("train")).union(test.withColumn("split", F.lit("test")))


@query("SELECT quality::VARCHAR AS label, count(*) AS support FROM labels GROUP BY 1 UNION ALL SELECT toxic::VARCHAR, 0 FROM labels WHERE toxic NOT IN (SELECT quality FROM labels) GROUP BY 1")
def report_label_rows(spark, sf_dir):
    out = report.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return report.without_averages(out).select("label", F.col("support").cast("bigint").alias("support"))


@query("SELECT a.r_name AS label_a, b.r_name AS label_b FROM region a JOIN region b ON a.r_name < b.r_name WHERE a.r_name <> 'ASIA' AND b.r_name <> 'ASIA'")
def pair_scenarios(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("label"))
    return recommend.pair_scenarios(recommend.label_pairs(region), region.where("label <> 'ASIA'"))


# --- joins and aggregates ---------------------------------------------------------------------------------------------


@query("""WITH cells AS (SELECT c_custkey, [lower(n_name), lower(r_name), 'none'] AS l FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, string_agg(CASE x WHEN 'asia' THEN 'east' WHEN 'europe' THEN 'west' ELSE x END, ',' ORDER BY pos) AS names, string_agg(CASE x WHEN 'asia' THEN '1' WHEN 'europe' THEN '2' ELSE '0' END, ',' ORDER BY pos) AS ids
FROM (SELECT c_custkey, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM cells) GROUP BY 1""")
def labels_mapped_and_encoded(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("c_custkey", F.array(F.lower("n_name"), F.lower("r_name"), F.lit("none")).alias("l"))
    names = spark.createDataFrame([("asia", "east"), ("europe", "west")], "token string, name string")
    mapped = dictmap.map_lists(rows, "l", names, ["c_custkey"], keep_unmapped=True)
    encoder = spark.createDataFrame([(1, "east"), (2, "west")], "id int, token string")
    out = vocab.encode_lists(mapped, "l", encoder, ["c_custkey"], any_case=False)
    return out.select("c_custkey", F.array_join("l", ",").alias("names"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("""SELECT c_custkey, replace(lower(n_name), '_', ' ') AS key, r_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def parent_by_label_key(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(text.label_key(F.col("n_name")).alias("child"), F.col("r_name").alias("parent"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.label_key(F.concat(F.lit("['"), F.upper("n_name"), F.lit("']"))).alias("key"))
    return labels.with_parent(rows, "key", tree, aliases={}).select("c_custkey", "key", "parent")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS inferred, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS encoded FROM part""")
def attached_by_row(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wide = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("row_id"), F.array("p_name").alias("NER_clean"), F.array(F.col("p_size").cast("bigint")).alias("Ingredients"))
    out = entities.attached(part.select("p_partkey"), wide, "p_partkey")
    return out.select("p_partkey", F.array_join("inferred_ingredients", ",").alias("inferred"), F.array_join(F.col("encoded_ingredients").cast("array<string>"), ",").alias("encoded"))


@query("SELECT DISTINCT r_name AS parent, n_name AS child FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hierarchy_edges(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return network.hierarchy_edges(rows, "n_name", tree, "n_name", "r_name")


@query("WITH m AS (SELECT p_name AS k, p_type AS v FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1) SELECT unnest(string_split_regex(lower(v), '\\s+')) AS word, count(*) AS n FROM m GROUP BY 1")
def unigram_frequency(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("from"), F.col("p_type").alias("to"), "p_partkey")
    return dictmap.unigram_frequency(dictmap.lookup_table(rows, "p_partkey"))


@query("""WITH f(w, n) AS (VALUES ('red', 3), ('ring', 5), ('bolt', 2)),
w AS (SELECT DISTINCT p_name AS token, string_split(p_name, ' ') AS l FROM part), s AS (SELECT token, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM w),
k AS (SELECT token, x, pos, coalesce(n, 0) AS n FROM s LEFT JOIN f ON w = lower(x)), b AS (SELECT *, max(n) OVER (PARTITION BY token) AS best FROM k)
SELECT token, string_agg(x, ' ' ORDER BY pos) AS name FROM b WHERE n = best GROUP BY 1""")
def frequent_words_kept(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("token")).distinct()
    mapping = spark.createDataFrame([(f"k{i}", w) for i, w in enumerate(["red"] * 3 + ["ring"] * 5 + ["bolt"] * 2)], "key string, value string")
    return dictmap.resolve_tokens(rows, mapping, use_frequency=True)


@query("SELECT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS label, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def merged_label_counts(spark, sf_dir):
    variant = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("["), F.lower("c_mktsegment"), F.lit(" recipes]"))).otherwise(F.concat(F.lit("Northern-"), "c_mktsegment"))
    counts = table(spark, sf_dir, "customer").groupBy(variant.alias("label")).agg(F.count("*").alias("n"))
    return labels.merged_counts(counts, "label", "n")


@query("SELECT count(*) AS rows, count(*) FILTER (a.c_nationkey = b.c_nationkey OR x.n_regionkey = y.n_regionkey) AS matched FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation x ON x.n_nationkey = a.c_nationkey JOIN nation y ON y.n_nationkey = b.c_nationkey")
def parent_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = rows.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("t"), F.col("n_regionkey").alias("tp"))
    b = rows.select((F.col("c_custkey") - 1).alias("k"), F.col("c_nationkey").alias("p"), F.col("n_regionkey").alias("pp"))
    return report.parent_match(a.join(b, "k"), "t", "p", "tp", "pp").agg(F.count("*").alias("rows"), F.count_if("parent_match").alias("matched"))


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS s, count(*) AS k FROM n a, n b GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, max(s / greatest(k - 1, 1)) FILTER (own = c) AS a, min(s / k) FILTER (own <> c) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def euclidean_silhouette(spark, sf_dir):
    out = report.euclidean_silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select(F.round("silhouette", 6).alias("silhouette"))


@query("SELECT string_split(p_name, ' ')[1] AS node, max(p_size) AS degree, max(p_retailprice) AS betweenness FROM part GROUP BY 1 HAVING NOT (node LIKE '%ed' OR length(node) <= 2)")
def merged_metrics(spark, sf_dir):
    cell = F.concat(F.lit("'("), F.upper(F.split("p_name", " ")[0]), F.lit(") 12.'"))
    rows = table(spark, sf_dir, "part").select(cell.alias("ingredient"), F.col("p_size").alias("degree"), F.col("p_retailprice").alias("betweenness"))
    return network.merged_metrics(rows, text.network_name(F.col("ingredient")), "degree", "betweenness")


@query("""WITH t AS (SELECT list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)
SELECT count(*) AS rows, count(*) FILTER (len(w) > 0) AS filled, count(DISTINCT array_to_string(w, ' ')) AS distinct FROM t""")
def probe_statistics(spark, sf_dir):
    return vocab.probe(_turns(spark, sf_dir), "words")


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 3 = 0) AS several FROM customer")
def rows_with_several_labels(spark, sf_dir):
    one = F.array("c_mktsegment")
    cell = F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment", "c_name")).when(F.col("c_custkey") % 3 == 1, one).otherwise(F.slice(one, 1, 0))
    return labels.with_several(table(spark, sf_dir, "customer").select(cell.alias("l")), "l")


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM conversations),
tokens AS (SELECT conv_id, turn, unnest(words) AS raw, generate_subscripts(words, 1) AS pos FROM t),
kept AS (SELECT lower(raw) AS token, row_number() OVER (ORDER BY min({'a': conv_id, 'b': turn, 'c': pos})) AS id FROM tokens GROUP BY 1),
lists AS (SELECT conv_id, turn, string_agg(k.id::VARCHAR, ',' ORDER BY pos) AS ids FROM tokens x JOIN kept k ON k.token = lower(raw) GROUP BY 1, 2)
SELECT 7::INTEGER AS "Dataset ID", row_number() OVER (ORDER BY t.conv_id, t.turn) - 1 AS "Index", coalesce(ids, '0') AS "Ingredients" FROM t LEFT JOIN lists USING (conv_id, turn)""")
def encoded_dataset(spark, sf_dir):
    rows = staged(_turns(spark, sf_dir), "turns")
    encoder = vocab.fit_encoder(rows, "words", ["conv_id", "turn"])
    out = vocab.encoded_dataset(rows, "words", encoder, ["conv_id", "turn"], 7)
    return out.withColumn("Ingredients", F.array_join(F.col("Ingredients").cast("array<string>"), ","))


@query("SELECT count(*) AS rows, count(*) AS with_prediction, round(avg(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END), 6) AS mean_size FROM part")
def described_predictions(spark, sf_dir):
    found = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name"))
    return entities.described(table(spark, sf_dir, "part").select(found.alias("NER_clean")))[0].withColumn("mean_size", F.round("mean_size", 6))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def frequent_predictions(spark, sf_dir):
    return entities.described(table(spark, sf_dir, "part").select(F.array("p_name").alias("NER_clean")))[1]


# --- functions --------------------------------------------------------------------------------------------------------


def _cell_kinds(spark, sf_dir):
    """Cells of five kinds from part: JSON, Python list, tuple, plain text with comma, missing."""
    kind, q = F.col("p_partkey") % 5, lambda c, s: F.concat(F.lit(s), c, F.lit(s))
    cell = (
        F.when(kind == 0, F.concat(F.lit("["), q(F.col("p_name"), '"'), F.lit(", "), q(F.col("p_type"), '"'), F.lit("]")))
        .when(kind == 1, F.concat(F.lit("["), q(F.col("p_name"), "'"), F.lit(", "), q(F.col("p_type"), "'"), F.lit("]")))
        .when(kind == 2, F.concat(F.lit("("), q(F.col("p_name"), "'"), F.lit(", "), q(F.col("p_type"), "'"), F.lit(")")))
        .when(kind == 3, F.concat("p_name", F.lit(" , "), "p_type"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN p_name || ' , ' || p_type WHEN 4 THEN '' ELSE p_name || '|' || p_type END AS items FROM part")
def parse_listish(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", F.array_join(parse.listish(F.col("cell")), "|").alias("items"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN p_name || '|' || p_type END AS items FROM part")
def parse_literal_list(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", F.array_join(parse.literal_list(F.col("cell")), "|").alias("items"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN replace(p_name || ' , ' || p_type, ' ', '|') WHEN 4 THEN '' ELSE p_name || '|' || p_type END AS items FROM part")
def parse_words_or_list(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", F.array_join(parse.words_or_list(F.col("cell")), "|").alias("items"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN p_name || ' , ' || p_type WHEN 4 THEN '' ELSE p_name END AS label FROM part")
def parse_first_label(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", parse.first_label(F.col("cell")).alias("label"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE {_TITLE.format('p_name')} || '|' || {_TITLE.format('p_type')} END AS labels FROM part")
def parse_labels(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", F.array_join(parse.labels_of(F.col("cell")), "|").alias("labels"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN p_name || ' , ' || p_type WHEN 4 THEN 'unknown' ELSE '[''' || p_name || ''', ''' || p_type || ''']' END AS label FROM part")
def parse_source_label(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", parse.source_label(F.col("cell"), "unknown").alias("label"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS items FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN [] ELSE [p_name, p_type] END AS list_distinct_ordered FROM part)")
def parse_items_in_order(spark, sf_dir):
    items = F.array_distinct(F.concat(parse.listlike(F.col("cell")), parse.listlike(F.col("cell"))))
    return _cell_kinds(spark, sf_dir).select("p_partkey", F.array_join(items, "|").alias("items"))


@query("SELECT n_nationkey, replace(n_name, '_', ' ') AS clean, replace(lower(n_name), '_', ' ') AS key, regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS slug FROM nation")
def label_forms(spark, sf_dir):
    name = F.col("n_name")
    dirty = F.concat(F.lit("﻿​ "), F.translate(name, "_", " "), F.lit("  "))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.visible(dirty).alias("clean"), text.label_key(F.concat(F.lit("{"), name, F.lit("}"))).alias("key"), text.slug(name).alias("slug"))


@query(f"SELECT s_suppkey, {_TITLE.format('s_name')} AS title FROM (SELECT s_suppkey, replace(replace(s_name, '#', ' '), '0', '') AS s_name FROM supplier)")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.titled(F.upper(F.translate("s_name", "#0", " "))).alias("title"))


_NAMED_ITEM = "CASE p_name WHEN 'red ring' THEN 'ring' ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN NOT ({_dropped('lower(x)')} OR {_in('lower(x)', lexicon.PREPARATION)} OR lower(x) LIKE '%ed') THEN x END AS name FROM (SELECT p_partkey, {_NAMED_ITEM} AS x FROM part)")
def profile_names(spark, sf_dir):
    cell = F.concat(F.lit(" \"'"), "p_name", F.lit(",;'\""))
    mapped = F.when(text.item_key(cell) == "red ring", F.lit("ring"))
    return table(spark, sf_dir, "part").select("p_partkey", text.profile_name(cell, mapped).alias("name"))


@query(f"SELECT p_partkey, CASE WHEN NOT {_dropped('lower(x)')} THEN x END AS term FROM (SELECT p_partkey, {_NAMED_ITEM} AS x FROM part)")
def mapped_terms(spark, sf_dir):
    cell = F.concat(F.lit(" "), "p_name", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", text.map_term(cell, F.when(F.col("p_name") == "red ring", F.lit("ring"))).alias("term"))


@query("SELECT p_partkey, p_name || ', ' || p_type AS text, '0-' || length(p_name) || ' ' || (length(p_name) + 2) || '-' || (length(p_name) + 2 + length(p_type)) AS spans FROM part")
def joined_with_offsets(spark, sf_dir):
    j = text.with_offsets(F.array("p_name", "p_type"))
    spans = F.array_join(F.transform(j["spans"], lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return table(spark, sf_dir, "part").select("p_partkey", j["text"].alias("text"), spans.alias("spans"))


@query(f"""WITH t AS (SELECT p_partkey, list_filter(regexp_extract_all(lower('3 ' || p_type || ' ' || p_name), '[a-z0-9]+'), lambda x: NOT ({_in("x", lexicon.DESCRIPTIVE)} OR {_in("x", lexicon.UNITS)} OR regexp_matches(x, '^\\d+$'))) AS w FROM part)
SELECT p_partkey, CASE WHEN len(w) > 0 THEN array_to_string(w[-2:], ' ') END AS name FROM t""")
def head_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tokens.head_words(F.concat(F.lit("3 "), "p_type", F.lit(" "), "p_name")).alias("name"))


@query(f"""WITH x AS (SELECT p_partkey, p_name AS n FROM part) SELECT p_partkey, CASE WHEN NOT {_dropped('lower(n)')} THEN n END AS name FROM x""")
def token_pipeline(spark, sf_dir):
    cell = F.concat(F.lit(" "), F.split("p_name", " ")[0], F.lit(" "), F.split("p_name", " ")[1], F.lit(" 12 cups "))
    return table(spark, sf_dir, "part").select("p_partkey", tokens.with_map(cell).alias("name"))


@query("SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part")
def joined_documents(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parse.listlike(F.concat_ws(", ", "p_name", "p_type", "p_brand")), " ").alias("text"))


# --- graph state ------------------------------------------------------------------------------------------------------


@query(f"WITH {_PMI} SELECT node, string_agg(other, ',' ORDER BY other) AS near FROM near GROUP BY 1")
def adjacency_lists(spark, sf_dir):
    near = network.adjacency(_edges(spark, sf_dir)).groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("near"))
    return near


@query("""WITH p AS (SELECT n_name, p_name AS term, count(*) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, p_name) <= 8),
s AS (SELECT n_name, r_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
l AS (SELECT s.n_name AS node, 'label' AS kind, r_name AS parent, c AS support, coalesce((SELECT string_agg(term, ', ' ORDER BY w DESC, term) FROM p WHERE p.n_name = s.n_name), '') AS preview FROM s),
u AS (SELECT r_name AS node, 'parent' AS kind, r_name AS parent, sum(c)::BIGINT AS support, array_to_string(list(n_name ORDER BY n_name)[1:12], ', ') AS preview FROM s GROUP BY 1)
SELECT node, kind, parent, support, round(ln(1 + support), 6) AS size, preview FROM (SELECT * FROM l UNION ALL SELECT * FROM u)""")
def label_network_nodes(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    support = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("c"))
    terms = _profile(spark, sf_dir, "n_name").select("label", F.col("item").alias("term"), F.col("freq").alias("weight"))
    return network.label_nodes(support, "label", "c", terms, tree, "n_name", "r_name").withColumn("size", F.round("size", 6))


@query("SELECT DISTINCT lower(p_name) AS term FROM part")
def term_list_file(spark, sf_dir):
    path = _place(spark, "terms") + ".json"
    names = [r[0] for r in table(spark, sf_dir, "part").select("p_name").collect()]
    writers._text(spark, path, json.dumps({"terms": [f" {x.upper().replace(' ', '  ')} " for x in names] + ["", " "]}))
    return readers.term_list(spark, path)


@query("""WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 31) % 256 AS b FROM part)
SELECT p_partkey, printf('#%02x%02x%02x', (r + (255 - r) // 2)::BIGINT, (g + (255 - g) // 2)::BIGINT, (b + (255 - b) // 2)::BIGINT) AS light, printf('#%02x%02x%02x', (r + 0) // 2, (g + 128) // 2, (b + 255) // 2) AS mixed, '#6b7280' AS none FROM c""")
def color_forms(spark, sf_dir):
    k = F.col("p_partkey")
    color = F.concat(F.lit("#"), *[F.lpad(F.hex((k * m % 256).cast("bigint")), 2, "0") for m in (1, 7, 31)])
    return table(spark, sf_dir, "part").select("p_partkey", text.lighter(color, 0.5).alias("light"), text.blended(color, F.lit("#0080ff")).alias("mixed"), text.blended(color, F.lit("none")).alias("none"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN '' WHEN 0 THEN p_name || chr(34) || '|' || chr(34) || p_type WHEN 1 THEN p_name || chr(39) || '|' || chr(39) || p_type WHEN 2 THEN '(' || chr(39) || p_name || chr(39) || '|' || chr(39) || p_type || chr(39) || ')' ELSE p_name || '|' || p_type END AS items FROM part")
def parse_comma_items(spark, sf_dir):
    return _cell_kinds(spark, sf_dir).select("p_partkey", F.array_join(parse.comma_items(F.col("cell")), "|").alias("items"))


# --- stages -----------------------------------------------------------------------------------------------------------
