"""Writers: Parquet, JSON lines, JSON objects, CSV reports, graphs, fusion files; cleaning up."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..storage import staged
from .readers import _fs


def parquet(df: DataFrame, path: str, append: bool = False) -> None:
    """A table over what is there, or, with append, behind it."""
    df.write.mode("append" if append else "overwrite").option("compression", "zstd").parquet(path)


def jsonl_map(mapping: DataFrame, path: str) -> None:
    """{"from", "to"} lines in files that `sources.readers.jsonl_map` reads."""
    mapping.select("from", "to").write.mode("overwrite").json(path)


def _text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _joined(lines: DataFrame, order: list, path: str, head: str, between: str, tail: str) -> None:
    """One text of head, the column `value` in order, and tail.

    Tasks write sorted parts; then these are copied behind one another, stream to
    stream, so no row comes to the driver's memory whatever their number.
    """
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.option("lineSep", between).text(parts)
    folder, fs = _fs(spark, parts)
    where, target = _fs(spark, path)
    files = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
    out = target.create(where, True)
    try:
        out.write(bytearray(head.encode()))
        for i, (name, size) in enumerate(files):
            # what stands behind the last line goes
            size -= len(between.encode()) if i == len(files) - 1 else 0
            source = fs.open(_fs(spark, f"{parts}/{name}")[0])
            try:
                spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
            finally:
                source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
        fs.delete(folder, True)


def _quoted(column: str) -> Column:
    """A string column as a JSON string."""
    cell = F.to_json(F.struct(F.col(column).cast("string").alias("x")))
    return F.substring(cell, F.lit(6), F.length(cell) - 6)


def encoder_json(encoder: DataFrame, id_to_token: str, token_to_id: str) -> None:
    """An encoder as two JSON objects, <UNK> first; tokens by id."""
    rows = encoder.select("id", "token").where("token IS NOT NULL").unionByName(encoder.sparkSession.createDataFrame([(0, "<UNK>")], "id bigint, token string"))
    order = [F.col("id"), F.col("token")]
    _joined(rows.withColumn("value", F.concat(_quoted("id"), F.lit(": "), _quoted("token"))), order, id_to_token, "{", ", ", "}")
    _joined(rows.withColumn("value", F.concat(_quoted("token"), F.lit(": "), F.col("id").cast("string"))), order, token_to_id, "{", ", ", "}")


def csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _attribute(column: str) -> Column:
    """A string column as a quoted XML attribute."""
    out = F.col(column).cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def gexf(edges: DataFrame, path: str, a: str = "ingredient_a", b: str = "ingredient_b", weight: str = "pmi") -> None:
    """A GEXF file of a graph: nodes by name, then edges by their ends."""
    rows = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).cast("double").alias("w")), "edges")
    nodes = rows.select(F.col("a").alias("n")).union(rows.select("b")).distinct()
    texts = nodes.select(F.lit(1).alias("kind"), F.col("n").alias("a"), F.lit("").alias("b"), F.concat(F.lit("<node id="), _attribute("n"), F.lit(" label="), _attribute("n"), F.lit("/>")).alias("value"))
    listed = numbered(rows, [F.col("a"), F.col("b"), F.col("w")], "i", 0)
    edge = F.concat(F.lit('<edge id="'), F.col("i").cast("string"), F.lit('" source='), _attribute("a"), F.lit(" target="), _attribute("b"), F.lit(' weight="'), F.col("w").cast("string"), F.lit('"/>'))
    texts = texts.union(listed.select(F.lit(3), "a", F.concat("b", F.lpad(F.col("i").cast("string"), 20, "0")), edge))
    # a line between the two lists
    texts = texts.union(rows.sparkSession.createDataFrame([(2, "", "", "</nodes>\n<edges>")], "kind int, a string, b string, value string"))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected">\n<nodes>\n'
    _joined(texts, [F.col("kind"), F.col("a"), F.col("b")], path, head, "\n", "\n</edges>\n</graph></gexf>")


def fusion_files(fusions: DataFrame, folder: str) -> list[str]:
    """A JSON file for every pair, named by the labels' letters and digits; pairs of one name share a file, the first by labels.

    Tasks write the files, each in a folder of its own; the driver only moves them.
    """
    spark = fusions.sparkSession
    slug = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit("label"))
    rows = fusions.select(F.concat(F.lit("fusion_"), slug(F.col("label_a")), F.lit("_"), slug(F.col("label_b"))).alias("file"), F.to_json(F.struct("pair", "bridges", "novel_from_a", "novel_from_b")).alias("value"), F.struct("label_a", "label_b").alias("k"))
    parts = f"{folder.rstrip('/')}/parts-{uuid.uuid4().hex}"
    rows.groupBy("file").agg(F.min_by("value", "k").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(parts)
    where, fs = _fs(spark, parts)
    out = []
    for status in fs.globStatus(_fs(spark, f"{parts}/file=*/part-*")[0]) or []:
        name = unquote(status.getPath().getParent().getName().removeprefix("file="))
        out.append(f"{folder.rstrip('/')}/{name}.json")
        target = _fs(spark, out[-1])[0]
        fs.delete(target, False)
        fs.rename(status.getPath(), target)
    fs.delete(where, True)
    return sorted(out)


def shards(df: DataFrame, path: str, rows: int = 2000, by: str = "split") -> None:
    """Training documents by split, in files of at most `rows` records."""
    df.write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", rows).parquet(path)


def summary_json(mapping: DataFrame, path: str, top: int = 50, examples: int = 20) -> None:
    """A dictionary's counts, targets with most variants and first merges as one JSON object."""
    from ..operators.dictmap import summary

    counts, targets = summary(mapping, top)
    first = mapping.where("`from` <> `to`").orderBy("from", "to").limit(examples)
    listed = lambda rows, *names: [dict(zip(names, r, strict=True)) for r in rows.collect()]
    found = listed(counts, *counts.columns)[0] | {"top_targets": listed(targets, "to", "variants"), "examples": listed(first.select("from", "to"), "from", "to")}
    _text(mapping.sparkSession, path, json.dumps(found, ensure_ascii=False))


def cleanup(spark: SparkSession, patterns: list[str], keep: list[str] = (), dry_run: bool = False, suffixes: tuple[str, ...] = ()) -> list[str]:
    """Delete what the patterns match (with one of the suffixes, if any are given), but for paths that hold one of keep; returns the paths."""
    done = []
    for pattern in patterns:
        where, fs = _fs(spark, pattern)
        for status in fs.globStatus(where) or []:
            path = status.getPath()
            if any(k in path.toString() for k in keep) or (suffixes and not path.getName().endswith(tuple(suffixes))):
                continue
            done.append(path.toString())
            if not dry_run:
                fs.delete(path, True)
    return done


def publish(spark: SparkSession, pattern: str, folder: str) -> list[str]:
    """Copies the files that the pattern matches to a folder, over what is there; returns their names."""
    where, fs = _fs(spark, pattern)
    names = []
    for status in fs.globStatus(where) or []:
        if status.isFile():
            target, other = _fs(spark, f"{folder.rstrip('/')}/{status.getPath().getName()}")
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, status.getPath(), other, target, False, True, spark.sparkContext._jsc.hadoopConfiguration())
            names.append(status.getPath().getName())
    return sorted(names)
