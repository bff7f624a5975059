"""Every registered query against its SQL, plans, and the entry points without the llm folders."""

import math
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from gridloom import catalog, sheet
from gridloom.errors import InvalidOption
from gridloom.functions import cells
from gridloom.operators import columns, edits, sorting
from gridloom.plans import ordinals
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(name, spark, data, oracle):
    got = catalog.QUERIES[name](spark, data)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, data):
    assert "StringContains(p_name,ring)" in plan(catalog.QUERIES["filter_contains"](spark, data))
    text = plan(catalog.QUERIES["filter_equals"](spark, data))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "o_totalprice" not in text


def test_no_python_in_the_catalogue(spark, data):
    for name in ("replace_all", "split_remainder", "sort_text_asc", "serialize_csv", "search_first"):
        assert "Python" not in plan(catalog.QUERIES[name](spark, data)) and "Arrow" not in plan(catalog.QUERIES[name](spark, data))


@pytest.mark.parametrize("descending", [False, True])
def test_ordinals_by_ranges(spark, monkeypatch, descending):
    df = spark.range(1000).select((F.col("id") % 37).cast("string").alias("k"), F.col("id")).union(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    want = ordinals.with_ordinal(df, ["k", "id"], "n", descending).collect()
    monkeypatch.setattr(ordinals, "ROWS", 100)
    got = ordinals.with_ordinal(df, ["k", "id"], "n", descending)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and "_range" in plan(got)


def test_ordinals_of_one_key_use_many_ranges(spark, monkeypatch):
    df = spark.range(4000).select(F.lit("same").alias("k"), F.col("id"))
    monkeypatch.setattr(ordinals, "ROWS", 500)
    got = ordinals.with_ordinal(df, ["k", "id"], "n", True)
    assert all(r["n"] == r["id"] for r in got.collect())
    sizes = [r["count"] for r in got.groupBy(F.expr("n div 500")).count().collect()]
    assert len(sizes) == 8
    placed = ordinals.with_ordinal(df, ["k", "id"], "n")
    assert placed.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_ordinals_of_few_long_rows_use_many_ranges(spark, monkeypatch):
    """Rows are far fewer than ROWS, but their bytes are more than a task should get."""
    monkeypatch.setattr(ordinals, "BYTES", 100_000)
    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(16))
    for long in (text, F.array(text), F.struct(text.alias("t")), text.cast("binary")):
        df = spark.range(1000).select("id", long.alias("long"), F.lit(None).cast("string").alias("none"))
        got = ordinals.with_ordinal(df, ["id"], "n")
        assert len(got.inputFiles()) >= 8
        assert all(r["n"] == r["id"] for r in got.collect())
    assert "_range" not in plan(ordinals.with_ordinal(spark.range(1000), ["id"], "n"))


@pytest.mark.parametrize("name", ["sort_whole_text", "file_index", "file_export", "file_edit", "file_sort"])
def test_queries_over_texts_in_many_ranges(name, spark, data, oracle, monkeypatch):
    seen = []

    def counted(df, *rest, **more):
        out = ordinals.with_ordinal(df, *rest, **more)
        seen.append(len(out.inputFiles()) if "_range" in plan(out) else 1)
        return out

    monkeypatch.setattr(ordinals, "BYTES", 50_000)
    monkeypatch.setattr(catalog, "_FILES", {})
    for module in (catalog, sorting, sheet):
        monkeypatch.setattr(module, "with_ordinal", counted)
    test_query_matches_sql(name, spark, data, oracle)
    assert max(seen) > 2


def test_deep_ranges_of_matches(spark, monkeypatch):
    from gridloom.operators import filters

    rows = spark.range(3000).select(F.col("id").alias("row"))
    monkeypatch.setattr(filters, "NEAR", 100)
    got = filters.match_range(rows.where("row % 3 = 0"), 500, 20).orderBy("match").collect()
    assert [(r["match"], r["row"]) for r in got] == [(k, 3 * k) for k in range(500, 520)]


def test_literal_patterns(spark):
    for separator in ("|", ".", "\\E", "a\\Eb", "$^", "\\"):
        df = spark.createDataFrame([(f"x{separator}y{separator}z",)], "s string")
        assert df.select(cells.pieces(F.col("s"), separator, 2).alias("p")).first()["p"] == ["x", f"y{separator}z"]


def test_lift_keeps_every_byte(spark):
    every = bytes(range(256))
    df = spark.createDataFrame([(every,)], "b binary").select(cells.lift(F.col("b")).alias("t"))
    assert df.select(cells.lower(F.col("t")).alias("b")).first()["b"] == every


def test_edits_of_a_joined_table(spark):
    rows = spark.createDataFrame([(i, [str(i), "x"]) for i in range(5)], "row bigint, fields array<string>")
    table = edits.edit_table(spark, {(1, 1): "a", (1, 0): "b", (9, 0): "c", (2, 7): "d"})
    got = {r["row"]: r["fields"] for r in edits.apply_edits(rows, table).collect()}
    assert got[1] == ["b", "a"] and got[2] == ["2", "x"] and len(got) == 5
    assert sorted((r["row"], r["column"]) for r in edits.invalid_edits(rows, table).collect()) == [(2, 7), (9, 0)]


def test_changes_are_checked():
    for change in (columns.Split(0, "", 2), columns.Split(0, ",", 1), columns.Split(5, ",", 2), columns.Join((0,), ""), columns.Join((0, 0), ""), columns.Arrange(3, ()), columns.Arrange(3, (3,))):
        with pytest.raises(InvalidOption):
            change.check(3)



def test_temporary_bytes():
    assert sorting.temporary_bytes(10, 2) == 136


def test_sort_reads_whole_texts(spark, tmp_path):
    head = "the same twenty chars "
    texts = [head + "b", head + "c", None, head + "x" * 5000 + "a", head + "x" * 5000 + "é", head, head + "b", "", head + "😀", head + "\uffff"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["place"], r["row"]) for r in catalog.QUERIES["sort_whole_text"](spark, str(tmp_path)).collect())
    keys = [(t or "").encode() for t in texts]
    assert [row for _, row in got] == sorted(range(len(keys)), key=lambda i: keys[i], reverse=True)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_folders(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".hypothesis", ".pytest_cache"))
    code = "import __spark_entry__ as e, gridloom.cli, gridloom.verify, gridloom.streaming.jobs; q = e.queries(); assert 'filter_contains' in q and not any(n.startswith('op') for n in q), q.keys(); assert 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
