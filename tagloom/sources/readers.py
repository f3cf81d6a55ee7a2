"""Readers: tables of any kind, dictionaries, encoders, hierarchies, discovery of sources."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon
from ..functions.parse import listish, source_label
from ..functions.text import is_missing, normalized
from ..storage import map_batches


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def modified(spark: SparkSession, path: str) -> int:
    where, fs = _fs(spark, path)
    return fs.getFileStatus(where).getModificationTime()


def stream_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    where, fs = _fs(spark, path)
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


WINDOWS = "windows-1252"
#: Bytes that windows-1252 doesn't define.
_UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"


def charset(lines: DataFrame) -> str:
    """Of a file's lines (column value, raw bytes): UTF-8 where all are, else windows-1252 where it defines all their bytes, else ISO-8859-1.

    All lines are looked at, over all tasks.
    """
    other = lines.where(~F.is_valid_utf8("value"))
    if not other.limit(1).count():
        return "UTF-8"
    plain = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return "ISO-8859-1" if lines.where(plain.rlike(_UNDEFINED)).limit(1).count() else WINDOWS


def read_csv(spark: SparkSession, path: str, rows: int | None = None, drop_malformed: bool = False) -> DataFrame:
    """All columns as strings, in the file's charset, quoted fields over lines.

    Only a file with a line of unpaired quotes is read as a whole; others are split over tasks.
    """
    lines = spark.read.text(path)
    found = charset(lines)
    quotes = F.length(F.col("value").cast("binary")) - F.length(F.replace("value", F.lit('"'), F.lit("")).cast("binary"))
    across = bool(lines.where(quotes % 2 == 1).limit(1).count())
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="ISO-8859-1" if found == WINDOWS else found, multiLine=across, escape='"', mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE")
    if found == WINDOWS:  # differs from ISO-8859-1 in 27 characters; Spark has no reader for it
        codes = [(chr(i), bytes([i]).decode("cp1252", "ignore")) for i in range(0x80, 0xA0)]
        old, new = ("".join(x) for x in zip(*[c for c in codes if c[1]], strict=True))
        df = df.select(*[F.translate(f"`{c}`", old, new).alias(c.translate(str.maketrans(old, new))) for c in df.columns])
    return df if rows is None else first_rows(df, rows)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a file or of a folder's files by name, in their order: the same ones at every run, and no sort of all rows.

    Spark deals the parts of files to tasks by size, so a row's place is its
    file's path, its part's start, and its order within the part.
    """
    path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))  # it is encoded, but for +
    place = F.struct(path, F.input_file_block_start(), F.monotonically_increasing_id())
    return df.withColumn("__nth", place).orderBy("__nth").limit(n).drop("__nth")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, CSV or Excel file by its suffix."""
    low = path.lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".txt")):
        return read_csv(spark, path)
    if low.endswith((".xlsx", ".xls")):
        import pandas as pd  # a driver-side read: Excel sheets are small; needs an Excel engine

        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    raise ValueError(f"no reader for {path}")


def limited(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """The columns of the first rows, without nulls."""
    df = read_table(spark, path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no column {missing}")
    df = df.select(*columns)
    return (df if rows is None else first_rows(df, rows)).dropna()


def list_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One list<string> column out of any table; passed through where it is one already."""
    df = read_table(spark, path)
    if column not in df.columns:
        raise ValueError(f"{path} has no column {column}")
    kind = df.schema[column].dataType.simpleString()
    return df.select(column if kind == "array<string>" else listish(F.col(column).cast("string")).alias(column))


def jsonl_map(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a file of {"from", "to"} lines; keys also in lower case; the later line counts (order within a file)."""
    from ..operators.dictmap import lookup_table

    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.from_json("value", "struct<`from`:string,`to`:string>").alias("r"))
    return lookup_table(rows.select("line", "r.from", "r.to"), "line")


def json_object(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """key, value of a JSON object of strings, both trimmed, blank ones left out; of repeated keys the last counts."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"))
    pairs = entries.select(F.trim("e.key").alias(key), F.trim("e.value").alias(value), F.monotonically_increasing_id().alias("__n")).where(f"{key} <> '' and {value} <> ''")
    return pairs.groupBy(key).agg(F.max_by(value, "__n").alias(value))


def encoder_maps(spark: SparkSession, path: str) -> DataFrame:
    """id, token of an encoder table."""
    return spark.read.parquet(path).select("id", "token")


def encoder_json(spark: SparkSession, id_to_token: str, token_to_id: str) -> DataFrame | None:
    """id, token of an encoder's two JSON objects, without the unknown token; None where a file is missing, an error where they disagree."""
    if not (exists(spark, id_to_token) and exists(spark, token_to_id)):
        return None
    sides = [json_object(spark, p, "id", "token") for p in (id_to_token, token_to_id)]
    forward = sides[0].select(F.col("id").cast("bigint").alias("id"), "token")
    backward = sides[1].select(F.col("token").cast("bigint").alias("id"), F.col("id").alias("token"))
    if forward.exceptAll(backward).limit(1).count() or backward.exceptAll(forward).limit(1).count():
        raise ValueError("the encoder's two files disagree")
    return forward.where("id <> 0")


def allowed_labels(spark: SparkSession, path: str, column: str = "label") -> DataFrame:
    """The distinct values of a JSON object, or items of a JSON list."""
    cell = spark.read.text(path, wholetext=True)
    values = F.coalesce(F.map_values(F.from_json("value", "map<string,string>")), F.from_json("value", "array<string>"))
    return cell.select(F.explode(values).alias(column)).where(f"{column} is not null").distinct()


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """term: the distinct normalised terms of a JSON list, or of the list "terms" of a JSON object; none where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "term string")
    cell = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "terms array<string>")["terms"])
    return cell.select(F.explode(items).alias("t")).select(normalized(F.col("t")).alias("term")).where("term <> ''").distinct()


def with_column(df: DataFrame, wanted: str, candidates: tuple[str, ...]) -> DataFrame:
    """df with the wanted column: itself, or a copy of the first candidate that is there."""
    if wanted in df.columns:
        return df
    found = found_column(df.columns, candidates)
    if found is None:
        raise ValueError(f"no column {wanted}, and none of {candidates}")
    return df.withColumn(wanted, F.col(f"`{found}`"))


def training_metadata(docs: DataFrame, label: str, key: list[str], sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """Of training documents: label, count; and the first by their texts' digest, then by key, with it."""
    first = docs.orderBy(F.md5("text"), "text", *key).limit(sample).select(*key, "text", label)
    return docs.groupBy(label).agg(F.count("*").alias("count")), first


def training_epoch(docs: DataFrame, key: list[str], epoch: int, seed: int = 42, most: int | None = None) -> DataFrame:
    """docs with their place in an epoch's order, which is another for every epoch and the same at every run; the first `most`."""
    order = F.md5(F.concat_ws(":", F.lit(seed + epoch), *[F.col(k).cast("string") for k in key]))
    from ..operators.order import numbered

    out = numbered(docs.withColumn("__o", order), [F.col("__o"), *map(F.col, key)], "place").drop("__o")
    return out if most is None else out.where(F.col("place") <= most)


def epoch_of_worker(docs: DataFrame, number: str, n: int, epoch: int, worker: int, workers: int, seed: int = 42, most: int | None = None) -> DataFrame:
    """The rows that one of several workers reads in an epoch, with their place in its order; each epoch has another order, the same at every run.

    number: a column that numbers docs' n rows from 0.  The place comes from the
    number by a keyed permutation, so nothing is sorted, and workers agree without
    speaking to each other.  most: rows of the epoch at most, over all workers.
    """
    from ..operators.order import permuted

    place = permuted(F.col(number), n, seed + epoch)
    out = docs.withColumn("place", place).where(F.pmod("place", F.lit(workers)) == worker)
    return out if most is None else out.where(F.col("place") < most)


def discovered(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ()) -> list[tuple[int, str]]:
    """(number, path) of the CSV and Parquet files of a folder by name; excluded ones keep their number."""
    where, fs = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    names = [n for n in names if n.endswith((".csv", ".parquet"))]
    return [(i, f"{folder.rstrip('/')}/{n}") for i, n in enumerate(names, 1) if n not in excluded]


def found_column(columns: list[str], candidates: tuple[str, ...], wanted: str | None = None) -> str | None:
    """The wanted column, or the first candidate that is there, in any case."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return next((by_name[c.lower()] for c in ((wanted,) if wanted else ()) + candidates if c.lower() in by_name), None)


#: Characters of the labels that one automaton has: it is sent to every worker.  More labels are looked for in further passes.
MOST_CHARACTERS = 4_000_000


def first_labels(df: DataFrame, column: str, known: list[str], out: str) -> DataFrame:
    """df with the first known label that stands as a word in a text column, whatever its case: the leftmost, of these the longest; null without one.

    All labels are found in one pass over a text, by an automaton that every worker
    builds once; labels equal but for case are the first of them.
    """
    names: dict[str, str] = {}
    for x in known:
        if x:
            names.setdefault(x.lower(), x)
    blocks, size = [[]], 0
    for low in names:
        if blocks[-1] and size + len(low) > MOST_CHARACTERS:
            blocks.append([])
            size = 0
        blocks[-1].append(low)
        size += len(low)
    rows, places = df, []
    for k, block in enumerate(blocks):
        rows = _placed(rows, column, {low: names[low] for low in block}, f"__{out}{k}")
        places.append(F.col(f"__{out}{k}"))
    first = F.least(*places) if len(places) > 1 else places[0]
    return rows.withColumn(out, first["label"]).drop(*[f"__{out}{k}" for k in range(len(blocks))])


_AUTOMATA: dict[str, object] = {}


def _placed(df: DataFrame, column: str, names: dict[str, str], out: str) -> DataFrame:
    """df with place, minus length and label of the first match; null without one."""
    sent = df.sparkSession.sparkContext.broadcast(names)  # of MOST_CHARACTERS at most
    number = uuid.uuid4().hex

    def automaton():
        if number not in _AUTOMATA:
            import ahocorasick

            _AUTOMATA.clear()
            made = ahocorasick.Automaton()
            for low, name in sent.value.items():
                made.add_word(low, (len(low), name))
            made.make_automaton()
            _AUTOMATA[number] = made
        return _AUTOMATA[number]

    def first(text: str | None) -> dict | None:
        low = (text or "").lower()
        inside = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        best = None
        if low and sent.value:
            for end, (size, name) in automaton().iter(low):
                start = end - size + 1
                # a boundary is where a word's letter and another character meet
                if inside(start - 1) != inside(start) and inside(end) != inside(end + 1) and (best is None or (start, -size) < best[:2]):
                    best = (start, -size, name)
        return best and {"place": best[0], "size": best[1], "label": best[2]}

    def run(batches):
        kind = pa.struct([("place", pa.int32()), ("size", pa.int32()), ("label", pa.string())])
        for batch in batches:
            found = pa.array([first(t) for t in batch.column(column).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StructType([T.StructField("place", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("label", T.StringType())]))])
    return map_batches(df, run, schema)


def unified(df: DataFrame, dataset_id: int, default: str = "unknown", known_labels: list[str] | None = None, row_index: str | None = None) -> DataFrame:
    """Dataset_ID, index, ingredients, cuisine of one source; rows without a label are dropped.

    Without a label column, the first known label (leftmost, then longest) that
    stands as a word in a text column is taken, columns in their order.
    row_index: a column that numbers the rows; else the reader's order.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    record = found_column(df.columns, lexicon.RECORD_COLUMNS)
    if record is None:
        raise ValueError("no column of records")
    label = found_column(df.columns, lexicon.LABEL_COLUMNS)
    if label is not None:
        cuisine = source_label(F.col(label).cast("string"), default)
    elif known_labels:
        texts = [c for c, k in df.dtypes if k == "string"]
        for k, c in enumerate(texts):
            df = first_labels(df, c, known_labels, f"__hit{k}")
        cuisine = F.coalesce(*[F.col(f"__hit{k}") for k in range(len(texts))], F.lit(default))
    else:
        cuisine = F.lit(default)
    index = F.col(f"`{row_index}`").cast("bigint") if row_index else F.monotonically_increasing_id()
    out = df.select(F.lit(dataset_id).cast("int").alias("Dataset_ID"), index.alias("index"), F.col(f"`{record}`").cast("string").alias("ingredients"), cuisine.alias("cuisine"))
    return out.where((F.col("cuisine") != default) & ~is_missing(F.col("cuisine")))


def fusion_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Fusion files with the pair of labels in their names, in order; malformed files are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern).withColumn("file", F.input_file_name())
    pair = F.array_sort(F.array(F.regexp_extract("file", r"fusion_([^_/]+)_([^_/]+)\.json$", 1), F.regexp_extract("file", r"fusion_([^_/]+)_([^_/]+)\.json$", 2)))
    return rows.withColumn("labels", pair).where(F.col("labels")[0] != "").drop("file")

