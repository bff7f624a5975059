"""Source divergence, Merkle manifest and line dedup against plain versions of their rules."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from gridloom.llm import line_dedup, merkle_manifest, source_divergence
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_sql(spark, data, module):
    got = module.query(spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    return rows_of(got) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({module.SQL})").fetchall(), key=repr)


# Source divergence


def plain_audit(rows, at_least, ranks):
    """From (lang, source, text): the contract, word for word."""
    rows = [tuple(v or "" for v in r) for r in rows]
    found, docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        found.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    groups = {(lang, source) for lang, source, _ in rows}
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= at_least]
        sources = sorted(s for g, s in groups if g == lang)
        own = {s: {t: found[lang, s, t] for t in kept} for s in sources}
        every = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(of.values()) + 5 * len(kept)) for t, n in of.items()} for s, of in own.items()}
        q = {t: 1 + 10**9 * (n + 5) // (sum(every.values()) + 5 * len(kept)) for t, n in every.items()}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pair), ("term", term)):
                ordered = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < ranks]
    return sorted(out, key=repr)


def many_sources(sources=75, docs=400):
    """More sources than a block has, some terms in all of them, many ties."""
    return [("xy"[i % 2], f"s{i % sources}", " ".join([f"w{'abcdefghij'[j % 10]}{'klmnop'[(i * j) % 6]}É" for j in range(i % 13)] + ["all"] * (i % 3))) for i in range(docs)]


@pytest.mark.parametrize("few", [1000, 0])
def test_divergence_matches_the_plain_rule(spark, monkeypatch, few):
    monkeypatch.setattr(source_divergence, "TERMS", 8)
    rows = many_sources()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert rows_of(source_divergence.audit(df, at_least=3, ranks=4, few=few)) == plain_audit(rows, 3, 4)


def test_divergence_on_awkward_rows(spark, awkward, empty):
    rows = [tuple(r) for r in awkward.select("lang", "source", "text").collect()]
    assert rows_of(source_divergence.audit(awkward, at_least=2)) == plain_audit(rows, 2, 50)
    assert source_divergence.audit(empty).count() == 0
    nothing = [("a", "s", None), ("a", "t", ""), ("b", None, "12 _")]
    assert rows_of(source_divergence.audit(spark.createDataFrame(nothing, "lang string, source string, text string"))) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


def test_divergence_query_equals_its_sql(spark, data):
    assert same_as_sql(spark, data, source_divergence)


def test_tasks_hand_counts_on_before_they_hold_many(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD_ROWS", 3)
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 20)
    rows = many_sources(5, 40)
    batch = spark.createDataFrame(rows, "lang string, source string, text string").toArrow().to_batches()
    parts = list(source_divergence.count_terms(iter(batch)))
    assert len(parts) > 3
    got = Counter()
    for b in parts:
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((lang, s, t) for lang, s, text in rows for t in text.translate(LOWER).split())
    assert +got == want and {k[:2] for k in got} == {r[:2] for r in rows}


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_radix_select_takes_the_greatest_and_breaks_ties_by_bytes(spark, few):
    names = ["", "a", "aa", "aab", "b" * 300, "b" * 300 + "c", "b" * 301, "é", "z", "\U0001f600", "～"]
    rows = [("g", None, n, 7) for n in names] + [("g", None, f"low{i}", i % 3) for i in range(20)] + [("g", None, "top", (1 << 30) - 1), ("h", "x", "only", 0)] + [("i", "x", f"n{i:03}", i * 999983 % (1 << 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, name string, value bigint").repartition(4)
    for k in (1, 5, 40):
        by = defaultdict(list)
        for a, b, n, v in rows:
            by[a, b].append((v, n))
        want = [(*g, v, n, i + 1) for g, of in by.items() for i, (v, n) in enumerate(sorted(of, key=lambda x: (-x[0], x[1].encode()))[:k])]
        assert rows_of(source_divergence.radix_top(df, ["a", "b"], "value", "name", k, few=few)) == sorted(want, key=repr)


# Merkle manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    """From (doc_id, source, lang, n_chars, text), one tree after the other."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(by[g])]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path, folded = [], leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = plain_leaf((*r[:4], None if r[4] is None else r[4].translate(LOWER)))
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    before, after = run[: at % 8], run[at % 8 + 1 :]
                    path += before + after
                    folded, at = h([*before, folded, *after]), at // 8
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(path), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaves, n", [(1, 9), (5, 65), (37, 700), (10**6, 700), (10**6, 1)])
def test_manifest_is_the_plain_tree(spark, monkeypatch, leaves, n):
    monkeypatch.setattr(merkle_manifest, "LEAVES", leaves)
    rows = [(i * 7919 % 1009, f"s{i % 3}", None if i % 50 == 3 else ["en", "de"][i % 7 == 0], i, f"Text {i}" if i % 4 else f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    assert rows_of(merkle_manifest.manifest(df)) == plain_manifest(rows)


def test_subtrees_are_those_of_the_whole_tree():
    for total in (1, 7, 8, 9, 64, 65, 130):
        leaves = [str(i) for i in range(total)]
        whole = plain_tree(leaves)
        for start in range(0, total, 5):
            for end in range(start + 1, total + 1, 3):
                levels = merkle_manifest.subtrees(leaves[start:end], start, total)
                for level, (own, first) in enumerate(zip(levels, merkle_manifest.firsts(start, len(levels)), strict=True)):
                    whole_here = [c for c in range(len(whole[level])) if c * 8**level >= start and min((c + 1) * 8**level, total) <= end]
                    assert own == [whole[level][c] for c in whole_here] and (not own or whole_here[0] == first)


def test_manifest_on_awkward_rows(awkward, empty):
    rows = [tuple(r) for r in awkward.select(*merkle_manifest.LEAF).collect()]
    assert rows_of(merkle_manifest.manifest(awkward)) == plain_manifest(rows)
    assert merkle_manifest.manifest(empty).count() == 0


def test_manifest_query_equals_its_sql(spark, data):
    assert same_as_sql(spark, data, merkle_manifest)


# Line dedup


def plain_lines(docs, at_least=10, points=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    texts = [(t or "").split("\n") for _, t in docs]
    seen = Counter(k for lines in texts for k in {key(x) for x in lines})
    out = []
    for (i, _), lines in zip(docs, texts, strict=True):
        kept = [x for x in lines if len(key(x)) < points or seen[key(x)] < at_least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def dropped(df, **more):
    return rows_of(line_dedup.drop_common_lines(df, **more).select("doc_id", "n_lines", "n_dropped", "kept_text"))


@pytest.mark.parametrize("at_least, points, hot", [(10, 1, 2000), (3, 3, 5), (1, 1, 2000)])
def test_lines_match_the_plain_rule(spark, monkeypatch, at_least, points, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    line = lambda i, j: ["", " \t", f"Rare {i} {j}", f"  Common {j % 4}\r", "ÉTÉ", "été", "ab", f"{i % 7} ÀB"][(i * 3 + j * 5) % 8]
    docs = [(i, "\n".join(line(i, j) for j in range(i % 11))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert dropped(df, at_least=at_least, points=points) == plain_lines(docs, at_least, points)


def test_a_line_counts_once_for_a_document(spark):
    docs = [(1, "\n".join(["again"] * 50)), (2, "again\nX"), *[(i, "ten\n ten") for i in range(3, 13)]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = dropped(df)
    assert got == plain_lines(docs) and (1, 50, 0, docs[0][1]) in got and (3, 2, 2, "") in got


def test_lines_on_awkward_rows(awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    for at_least in (1, 2, 10):
        assert dropped(awkward, at_least=at_least) == plain_lines(docs, at_least)
    assert line_dedup.drop_common_lines(empty).count() == 0
    assert set(line_dedup.drop_common_lines(awkward).columns) == {*awkward.columns, "n_lines", "n_dropped", "kept_text"}


def test_lines_query_equals_its_sql_and_runs_without_python(spark, data):
    assert same_as_sql(spark, data, line_dedup)
    plan = line_dedup.query(spark, data)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_a_text_is_one_row_of_the_shuffle(spark, data):
    """Lines travel as hashes: no exchange below the last join carries a text."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    places = line_dedup.common_places(docs, line_dedup.common_keys(docs))
    assert places.columns == ["d0", "d1", "d2", "places"] and places.where(F.size("places") > 0).count() == places.count()
