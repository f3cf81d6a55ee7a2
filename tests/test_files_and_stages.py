"""What works on files, settings and stages alone, without a given table."""

import uuid

import duckdb
import pytest

from tagloom.plans import stages
from tagloom.plans.config import Config
from tagloom.plans.runner import STAGES, Context, Runner, StageResult
from tagloom.sources import readers, writers
from tagloom.storage import shared_dir


def _place(spark, name):
    return f"{shared_dir(spark)}/tagloom-{name}-{uuid.uuid4().hex}"


def discovered_sources(spark):
    folder = _place(spark, "raw")
    for name in ("d.csv", "b.csv", "notes.md", "c.parquet", "a.csv"):
        writers._text(spark, f"{folder}/{name}", "x\n1\n")
    found = readers.discovered(spark, folder, ("b.csv",))
    return spark.createDataFrame([(i, p.rsplit("/", 1)[1]) for i, p in found], "number bigint, name string")


def cleanup_files(spark):
    folder = _place(spark, "clean")
    for name in ("a.parquet", "keep_me.parquet", "map.json"):
        writers._text(spark, f"{folder}/{name}", "x")
    planned = writers.cleanup(spark, [f"{folder}/*"], ["keep_me"], dry_run=True, suffixes=(".parquet",))
    done = writers.cleanup(spark, [f"{folder}/*"], ["keep_me"], suffixes=(".parquet",))
    names = ("a.parquet", "keep_me.parquet", "map.json")
    return spark.createDataFrame([(n, planned == done and not readers.exists(spark, f"{folder}/{n}")) for n in names], "name string, deleted boolean")


def config_values(spark):
    path = _place(spark, "config") + ".yaml"
    writers._text(spark, path, "pipeline:\n  download:\n    raw_dir: data/raw\n  pmi:\n    min_count: 15\n    min_pmi: 1.0\n")
    found = Config.parsed(spark.read.text(path, wholetext=True).first()[0])
    rows = [(s, k, str(v)) for s, over in (("download", {}), ("pmi", {"min_pmi": 2.0})) for k, v in found.stage(s, **over).items()]
    return spark.createDataFrame(rows, "stage string, key string, value string")


def outputs_kept_and_redone(spark):
    """Rows that a stage's output has after writing 1, 2, 3 and 4 rows where it is absent, fresh, forced, and older than its input."""
    source, target = _place(spark, "in"), _place(spark, "out")
    rows = []
    for n, (state, force) in enumerate((("absent", False), ("fresh", False), ("forced", True), ("stale", False)), 1):
        if state in ("absent", "stale"):
            writers.parquet(spark.range(10), source)
        stages._write(Context(spark, Config({"force": force})), spark.read.parquet(source).limit(n), target)
        rows.append((state, spark.read.parquet(target).count()))
    return spark.createDataFrame(rows, "state string, rows bigint")


def runner_results(spark):
    held = dict(STAGES)
    try:
        STAGES["two"] = STAGES["four"] = lambda ctx, **_: StageResult("", "success")
        STAGES["three"] = lambda ctx, **_: 1 / 0
        found = Runner(spark, Config()).run(["one", "two", "three", "four"], stop_on_failure=False)
    finally:
        STAGES.clear()
        STAGES.update(held)
    return spark.createDataFrame([(n, r.status) for n, r in zip(("one", "two", "three", "four"), found, strict=True)], "stage string, status string")


def published_files(spark):
    folder, public = _place(spark, "viz"), _place(spark, "public")
    for name in ("a.html", "b.html", "c.csv"):
        writers._text(spark, f"{folder}/{name}", "x")
    done = writers.publish(spark, f"{folder}/*.html", public)
    return spark.createDataFrame([(n,) for n in done if readers.exists(spark, f"{public}/{n}")], "name string")


WANTED = {
    discovered_sources: "SELECT * FROM (VALUES (1::BIGINT, 'a.csv'), (3, 'c.parquet'), (4, 'd.csv')) AS t(number, name)",
    cleanup_files: "SELECT * FROM (VALUES ('a.parquet', true), ('keep_me.parquet', false), ('map.json', false)) AS t(name, deleted)",
    config_values: "SELECT 'download' AS stage, 'raw_dir' AS key, 'data/raw' AS value UNION ALL SELECT 'pmi', 'min_count', '15' UNION ALL SELECT 'pmi', 'min_pmi', '2.0'",
    outputs_kept_and_redone: "SELECT * FROM (VALUES ('absent', 1::BIGINT), ('fresh', 1), ('forced', 3), ('stale', 4)) AS t(state, rows)",
    runner_results: "SELECT * FROM (VALUES ('one', 'skipped'), ('two', 'success'), ('three', 'failed'), ('four', 'success')) AS t(stage, status)",
    published_files: "SELECT * FROM (VALUES ('a.html'), ('b.html')) AS t(name)",
}


@pytest.mark.parametrize("made", WANTED, ids=lambda f: f.__name__)
def test_result(spark, made):
    want = duckdb.sql(WANTED[made])
    got = made(spark)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
