"""Quality rules, classifier, language, tokenizers, shards and packing."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from gridloom.llm import byte_gru, line_crf, packing, pieces, quality_rules, shared, token_shards, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Quality rules


def plain_statistics(text):
    split = [w for w in "".join(" " if c in quality_rules.BLANKS else c for c in text).split(" ") if w]
    windows = Counter(zip(split, split[1:], split[2:]))
    covered = {i + k for i in range(len(split) - 2) if windows[tuple(split[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in quality_rules.BLANKS for c in x)]
    return len(split), sum(map(len, split)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_match_a_plain_count(awkward):
    got = quality_rules.with_statistics(awkward).select("text", *quality_rules.STATISTICS).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert tuple(r)[1:] == plain_statistics(r["text"] or "")


def test_order_of_rules_changes_no_verdict(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = list(quality_rules.rules())
    a, b = (quality_rules.apply_rules(docs, o).select("doc_id", "kept").orderBy("doc_id").collect() for o in (names, names[::-1]))
    assert a == b and set(quality_rules.order_rules(docs)) == set(names)


def test_rules_on_awkward_rows(awkward, empty):
    got = quality_rules.apply_rules(awkward).select("text", "kept", "base_failed", "rejected_by").collect()
    assert all(not r["kept"] and r["base_failed"] for r in got if not (r["text"] or "").strip())
    assert quality_rules.apply_rules(empty).count() == 0
    filtered = quality_rules.apply_rules(awkward, list(quality_rules.rules())).where("kept").select(*awkward.columns)
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1  # a filter must not copy the statistics' expressions


def test_cascade_keeps_what_the_statistics_keep(spark, data, awkward, empty):
    word = lambda letters, i: "".join(letters[i // len(letters) ** k % len(letters)] for k in range(4))
    text = lambda letters, n: " ".join(word(letters, 7 * i) for i in range(n))
    texts = [text("абвгдежзиклмн", 60), text(["क", "ख", "गा", "घि", "चु"], 60), "w " * 60, "a b c " * 9 + text("efghij", 40), "a b c d " * 9 + text("efghij", 20)]
    more = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    names = list(quality_rules.rules())
    for docs in (spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), awkward.select("doc_id", "text"), more):
        want = Counter(rows_of(quality_rules.apply_rules(docs, names).where("kept").select("doc_id", "text")))
        for order in (names, names[::-1]):
            assert Counter(rows_of(quality_rules.passing(docs, order))) == want
    kept = {r["doc_id"] for r in quality_rules.passing(more).collect()}
    assert {1, 2, 4} <= kept and not {3, 5} & kept
    assert quality_rules.passing(awkward).columns == awkward.columns and quality_rules.passing(empty).count() == 0


# Classifier


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    per, pair = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    odds = rng.normal(size=9)
    got, pairs, _ = line_crf.marginals(odds, per, pair)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in per:
        total, good, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(odds[at + k] * y[k] for k in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        np.testing.assert_allclose(got[at : at + n], good / total, rtol=1e-9)
        want_pairs += joint / total
        at += n
    np.testing.assert_allclose(pairs, want_pairs, rtol=1e-9)


def test_marginals_of_long_chains_match_one_pass(monkeypatch):
    rng = np.random.default_rng(1)
    per, pair = np.array([2, 40, 1, 17, 16, 33, 8]), rng.normal(size=(2, 2))
    odds = rng.normal(scale=3, size=per.sum())
    whole = line_crf.marginals(odds, per, pair)
    monkeypatch.setattr(line_crf, "PIECE", 8)
    for a, b in zip(whole, line_crf.marginals(odds, per, pair), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_lines_of_many_bytes_are_told_apart():
    a, b = b"a" * 4096 + b"b" * 4096, b"b" * 4096 + b"a" * 4096
    active, _, _ = line_crf.line_features([a + b"\n" + b, a + b"\n" + a])
    assert not np.array_equal(active[1], active[3])


def test_classifier_learns_from_a_bound_of_rows(spark, monkeypatch):
    got = []
    monkeypatch.setattr(line_crf, "fit", lambda x, per, y: got.append(len(per)) or {"flat": 1.0})
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.createDataFrame([(ids[0], f"text {k}") for k in range(5000)] + [(ids[1], "bad")], "doc_id bigint, text string")
    line_crf.train(docs, spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id bigint, quality int"), rows=400)
    assert all(n <= 400 for n in got)


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(7, "one text")] * 5000 + [(i, f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    got = [sorted(map(tuple, shared.sample_rows(docs.repartition(n), 400, "doc_id", "text").collect())) for n in (1, 7)]
    assert got[0] == got[1] and 380 <= len(got[0]) <= 400 and len(set(got[0])) == len(got[0])


def test_classifier_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = line_crf.score_documents(docs, line_crf.train(docs, labels)).where(line_crf.held_out()).join(labels, "doc_id").select("quality", "predicted").collect()
    right = [r["quality"] == r["predicted"] for r in got]
    assert len(right) > 50 and sum(right) / len(right) > 0.93


def test_classifier_on_awkward_rows(spark, awkward, empty, labels):
    model = line_crf.train(awkward, labels)
    got = line_crf.score_documents(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert line_crf.score_documents(empty, model).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert line_crf.train(awkward, none) == {"flat": 1.0}
    assert {r["score"] for r in line_crf.score_documents(awkward, {"flat": 1.0}).collect()} == {1.0}


# Language


def test_gradient_through_time():
    net = byte_gru.ByteGRU(["a", "b", "c"], hidden=5)
    data, label = np.frombuffer(b"abcabdxyzq", np.uint8).reshape(2, 5), np.array([0, 2])

    def loss():
        p = net.positions(data)
        return -np.log(p[np.arange(2)[:, None], np.arange(5)[None], label[:, None]].astype(np.float64)).sum()

    for p, g in zip(net.parameters(), net.step(data, label), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = p[at]
        p[at] = before + 1e-2
        high = loss()
        p[at] = before - 1e-2
        low = loss()
        p[at] = before
        assert abs((high - low) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


def naive_probabilities(net, text):
    """Mean over the positions of a text, a byte at a time from its first to its last, and back."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(way, data):
        h, out, n = np.zeros(len(way.bias)), [], len(way.bias)
        for b in data:
            x, u = way.table[b].astype(float), h @ way.own.astype(float)
            z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(x[2 * n :] + r * (u[2 * n :] + way.bias))
            h = (1 - z) * new + z * h
            out.append(h)
        return np.array(out).reshape(-1, n)

    odds = np.concatenate([states(net.there, text), states(net.back, text[::-1])[::-1]], 1) @ net.out + net.base
    p = np.exp(odds - odds.max(1, keepdims=True, initial=-np.inf))
    return (p / p.sum(1, keepdims=True)).sum(0) / max(len(text), 1)


@pytest.mark.parametrize("numbers", [16 << 20, 3000])
def test_network_reads_a_text_from_its_first_byte_to_its_last(monkeypatch, numbers):
    monkeypatch.setattr(byte_gru, "SEGMENT", 60)
    monkeypatch.setattr(byte_gru, "CHECK", 16)
    monkeypatch.setattr(byte_gru, "NUMBERS", numbers)  # with few, the longest texts are read in parts
    net, rng = byte_gru.ByteGRU(["a", "b", "c"], hidden=6), np.random.default_rng(3)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in [0, 1, 2, 59, 60, 61, 500, 1234, *rng.integers(0, 150, 90).tolist()]]
    got = net.texts(texts)
    for text, p in zip(texts, got, strict=True):
        np.testing.assert_allclose(p, naive_probabilities(net, text), atol=1e-4)
    assert net.texts([]).shape == (0, 3)
    a, b = net.texts([b"one two", b"six two"])
    assert not np.allclose(a, b)


def test_network_remembers_what_lies_far_back(monkeypatch):
    """A network that forgets nothing: its first byte decides, 100,000 bytes on."""
    net = byte_gru.ByteGRU(["a", "b"], hidden=4)
    for way in (net.there, net.back):
        way.table[:], way.own[:], way.bias[:] = 0, 0, 0
        way.table[:, :4] = 30  # what was there stays
        way.table[[ord("x"), ord("y")], :4] = -30  # but for two letters
        way.table[ord("x"), 8:], way.table[ord("y"), 8:] = 3, -3
    net.out[:] = np.array([[1, -1]] * 4 + [[0, 0]] * 4)
    rest = b"." * 100_000
    monkeypatch.setattr(byte_gru, "NUMBERS", 100_000)
    for text, best in ((b"x" + rest, 0), (b"y" + rest, 1)):
        p = net.texts([text])[0]
        assert p[best] > 0.99
        np.testing.assert_allclose(p, naive_probabilities(net, text), atol=1e-4)


def test_whole_rows_are_learned(spark, monkeypatch):
    got = []
    monkeypatch.setattr(byte_gru, "fit", lambda words, label, languages, passes: got.append((words, label.tolist(), languages)))
    texts = [(i, f"{i} " + "ab" * (20 * i), "de") for i in range(1, 40)] + [(i, "x" * 5000, "only long") for i in range(40, 44)] + [(50, "", "empty")]
    byte_gru.train(spark.createDataFrame(texts, "doc_id bigint, text string, lang string"), size=3000)
    words, label, languages = got[0]
    assert languages == ["de", "only long"] and max(map(len, words)) <= byte_gru.STRETCH and sum(len(w) for w, y in zip(words, label, strict=True) if y == 0) <= 3000
    assert b"".join(w for w, y in zip(words, label, strict=True) if y == 1) == b"x" * 5000
    assert [b"".join(byte_gru.stretches(t)) for t in (b"", b"a", b"abc" * 33)] == [b"", b"a", b"abc" * 33]
    assert shared.whole_rows([5, 3, 9, 2], 8) == [0, 1] and shared.whole_rows([9, 3, 4], 8) == [1, 2] and shared.whole_rows([9, 8], 1) == [1] and shared.whole_rows([], 1) == []


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_gru.identify(docs, byte_gru.train(docs)).where(byte_gru.held_out()).select("lang", "lang_pred").collect()
    for name in {r["lang"] for r in got}:
        right = [r["lang_pred"] == name for r in got if r["lang"] == name]
        assert sum(right) / len(right) > 0.95, name


def test_rare_languages_and_those_of_long_texts_are_learned(spark):
    rng = np.random.default_rng(5)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))
    rows = [(i, text("abcde", 30), "common") for i in range(4000)] + [(5000 + i, text("vwxyz", 8000), "long") for i in range(12)] + [(6000 + i, text("klmno", 40), "rare") for i in range(9)] + [(7001, text("fghi", 50), "repeated")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = byte_gru.train(docs)
    assert net.languages == ["common", "long", "rare", "repeated"]
    new = spark.createDataFrame([(1, text("abcde", 30)), (2, text("vwxyz", 9000)), (3, text("klmno", 30)), (4, text("fghi", 30))], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in byte_gru.identify(new, net).orderBy("doc_id").collect()] == net.languages


def test_language_on_awkward_rows(awkward, empty):
    net = byte_gru.train(awkward)
    got = byte_gru.identify(awkward, net).collect()
    assert len(got) == awkward.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if letters else "und") and 0 <= r["score"] <= 1
    assert byte_gru.train(empty) is None and byte_gru.identify(empty, net).count() == 0
    assert {r["lang_pred"] for r in byte_gru.identify(awkward, None).collect()} == {"und"}


# Tokenizers

ODD = ["", " ", "  ", "   a", " a", "a ", "a  b", "\n", "\nab", "a\n", "a\nb", "a \nb", "a\n b", "a\n\nb", "a\r\nb", "don't we'll it's 's", "x\u00a0\n y", "\x1c \x1d a", "naïve— “q” 12 3a", "a　 b", "<|endoftext|> <s> <0x41>", "hello <|endoftext|> there", "a<|endoftext|>", "<|endoftext|><|endoftext|>  b\n", "x \n<|endoftext|>\n y <|endoftext", "é<|endoftext|> 日本", "▁", "a▁b", "▁▁ a", "日本 語 😀 é́ a", "\x00", "a" * 700, "ab" * 500, "x      y       z" + " " * 40]


def test_byte_bpe_equals_the_library(spark, data):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    library = Tokenizer.from_file(BYTE_BPE)
    flat, counts = words.byte_bpe_encoder(BYTE_BPE).encode_slice(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_added_tokens_are_found_in_any_text():
    rng = np.random.default_rng(4)
    parts = ["<|endoftext|>", " ", "  ", "\n", "ab", "<|", "é", "日", "'s", "12", "\u00a0", "|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(3000)]
    flat, counts = words.byte_bpe_encoder(BYTE_BPE).encode_slice(pa.array(texts, pa.large_string()))
    ends, library = np.cumsum(counts), Tokenizer.from_file(BYTE_BPE)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_table_forgets_without_changing_ids():
    code = words.byte_bpe_encoder(BYTE_BPE)
    code.table.limit = code.units.limit = 50
    texts = pa.array([" ".join(f"w{i * 37 % 997}" for i in range(k, k + 40)) for k in range(60)], pa.large_string())
    small = [code.encode_slice(texts.slice(i, 1))[0].tolist() for i in range(60)]
    flat, counts = words.byte_bpe_encoder(BYTE_BPE).encode_slice(texts)
    assert sum(small, []) == flat.tolist() and counts.sum() == len(flat)


def test_pieces_equal_the_library(spark, data):
    rng = np.random.default_rng(1)
    texts = ODD + ["".join(rng.choice(list("abeinrst  hd.é▁"), rng.integers(1, 300))) for _ in range(150)] + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    model, code = pieces.text_encoder(PIECES)
    flat, counts = code.encode_slice(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert flat[a:b].tolist() == model.library.encode(text), text[:60]


def test_piece_digests(awkward, empty):
    model, _ = pieces.text_encoder(PIECES)
    got = rows_of(pieces.digest_pieces(awkward, PIECES))
    want = []
    for r in awkward.collect():
        ids = model.library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.library.decode(ids).encode()).hexdigest()))
    assert Counter(got) == Counter(want)
    full = pieces.encode_pieces(awkward, PIECES).collect()
    assert len(full) == len(got) and all(model.library.decode(r["ids"]) == r["decoded"] for r in full)
    assert pieces.digest_pieces(empty, PIECES).count() == 0


# Shards


def test_shards_round_trip(spark, awkward, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    folder, manifest = token_shards.write_shards(awkward, BYTE_BPE)
    got = sorted(rows_of(token_shards.read_shards(spark, folder, manifest)), key=lambda r: r[1])
    docs = sorted((tuple(r)[:2] for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for (doc_id, at, n, crc), (want_id, text) in zip(got, docs, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (doc_id, at, n, crc) == (want_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    shard = token_shards.Shard(folder, manifest.first()["path"])
    assert len(shard.tokens(0)) == shard.counts[0]
    store, root = token_shards.filesystem(folder)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(b"another")
    with pytest.raises(ValueError):
        token_shards.Shard(folder, manifest.first()["path"])
    assert token_shards.read_shards(spark, *token_shards.write_shards(empty, BYTE_BPE)).count() == 0


# Packing


def test_patterns_use_up_the_demand():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 60, 3000):
        demand = Counter(rng.integers(1, 257, n).tolist() + [512] * (n // 3) + [1024] * (n // 9))
        found = packing.patterns(dict(demand))
        used = Counter()
        for pattern, times in found:
            assert sum(pattern) <= 1024 and times > 0
            for k in pattern:
                used[k] += times
        assert used == demand
        if n == 3000:
            assert sum(k * v for k, v in demand.items()) / sum(t for _, t in found) / 1024 > 0.995


@pytest.mark.parametrize(("demand", "best"), [({512: 10}, 5), ({342: 9}, 4.5), ({600: 4, 400: 4}, 4), ({700: 3, 324: 3, 300: 3}, 4), ({1: 2048}, 2), ({500: 1, 524: 1}, 1)])
def test_program_finds_the_optimum(demand, best):
    found = packing.solve(demand)
    assert sum(x for _, x in found) == pytest.approx(best, rel=1e-3)
    for n, c in demand.items():
        assert sum(counts[n] * x for counts, x in found) >= c - 1e-6


def test_packing_places_every_id_once(awkward, empty):
    got = packing.pack_documents(awkward, BYTE_BPE, keep_ids=True).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in awkward.collect():
        want[(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1)] += 1
    tokens = Counter()
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        tokens[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert tokens == Counter({k: k[1] * n for k, n in want.items()})
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0


def test_cut_pieces_rebuild_the_document(awkward):
    starts = {}
    for r in packing.cut_documents(awkward.where("doc_id = 7"), BYTE_BPE, keep_ids=True).collect():
        starts[r["start"]] = r["ids"]
    ids = [i for s in sorted(starts) for i in starts[s]]
    library = Tokenizer.from_file(BYTE_BPE)
    assert ids == [*library.encode(awkward.where("doc_id = 7").first()["text"], add_special_tokens=False).ids, 0]


def test_rules_query_equals_its_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.sql(quality_rules.SQL).fetchall())
    assert sorted(rows_of(quality_rules.query(spark, data).orderBy(F.col("doc_id")))) == want


def test_all_lines_of_a_document_are_learned(spark, monkeypatch):
    got = []
    monkeypatch.setattr(line_crf, "fit", lambda x, per, y: got.append((x, per, y)) or {"flat": 1.0})
    monkeypatch.setattr(line_crf, "TRAIN_LINES", 2000)
    text = "\n".join(["a clean line of words."] * 600 + ["$$$ 123 !!! ###"] * 900)
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    docs = spark.createDataFrame([(ids[0], text), (ids[1], "short"), (ids[2], "too long a document\n" * 2001)], "doc_id bigint, text string")
    line_crf.train(docs, spark.createDataFrame([(ids[0], 0), (ids[1], 1), (ids[2], 1)], "doc_id bigint, quality int"))
    active, _, _ = line_crf.line_features([text.encode()])
    (x, per, y), = got
    assert sorted(per.tolist()) == [1, 1500] and sorted(y.tolist()) == [0, 1]
    assert active.astype("<i4").tobytes() in x.astype("<i4").tobytes()  # the whole document, line by line; one that can't be whole isn't there


def test_classifier_query_scores_every_document(spark, data):
    got = line_crf.query(spark, data)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_texts_reach_python_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    try:
        for was, want in (("64m", "8388608"), ("1g", "8388608"), ("512k", "512k"), ("1000000b", "1000000b")):
            spark.conf.set(key, was)
            shared.bound_batches(spark)
            assert spark.conf.get(key) == want
        spark.conf.set(key, "64m")
        texts = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), 1000).alias("text"))
        line_crf.score_documents(texts, {"flat": 1.0})
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()
        assert len(sizes) >= 3 and all(r["n"] < 9 << 20 for r in sizes)
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
