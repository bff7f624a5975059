"""Chat format, n-gram join, embeddings, substring dedup and the pipeline."""

import hashlib
import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import chat_format, chunk_dedup, cover_tree, jaccard_join, shared

# Chat


@pytest.mark.parametrize("text", ["", "plain", "\\", "a\\\n", "</turn>", "\\</turn>", "\\\\### User: x", "### Assistant: </turn> ok", "\n</turn>\n### User: b", "### Other \"q\": z</turn", "\n", "### User:", "é😀"])
@pytest.mark.parametrize("role", ["user", "assistant", "", 'we"ird: </turn>', "### User: "])
def test_turns_round_trip(text, role):
    rendered = chat_format.format_turn(role, text)
    assert [(r, chat_format.unescape(b)) for r, b in chat_format.parse(rendered)] == [(role, text)]
    if not chat_format._FOUND.search(text):
        assert chat_format.parse(rendered)[0][1] == text  # escaped only where it conflicts


def test_conversations_parse_as_their_turns():
    rng = random.Random(4)
    parts = ["### User: ", "</turn>", "\\", "\n", "a", "### Assistant:", " "]
    turns = [(rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=rng.randint(0, 7)))) for _ in range(400)]
    text = "".join(chat_format.format_turn(*t) for t in turns)
    assert [(r, chat_format.unescape(b)) for r, b in chat_format.parse(text)] == turns


def test_chat_on_awkward_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, formatted string, n_turns int"
    rows = [(1, 0, "user", None, "c", 1), (1, 1, "assistant", "x</turn>", "c", 1), (1, 1, "assistant", "x</turn>", "c", 1), (None, None, None, "t", "c", 1), (2, None, "assistant", "", "c", 1), (3, 0, "assistant", "y" * 200_000, "c", 1)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, kind))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nx</turn>\nassistant\nx</turn>\n").hexdigest()
    assert got[1]["loss_chars"] == 16 and got[1]["loss_sha256"] == hashlib.sha256(b"x</turn>x</turn>").hexdigest()
    assert got[3]["loss_chars"] == 200_000 and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    none = spark.createDataFrame([], kind)
    assert chat_format.read_back(chat_format.format_turns(none)).count() == 0
    whole = {r["conv_id"]: r["formatted"] for r in chat_format.format_conversations(spark.createDataFrame(rows, kind)).collect()}
    assert len(chat_format.parse(whole[1])) == 3 and len(whole[1]) == got[1]["formatted_chars"]


# Jaccard join


def plain_sets(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_groups(docs, n, over, under):
    sets = [plain_sets(t, n) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and under * len(a & b) >= over * len(a | b):
            label[find(j)] = find(i)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def near_copies(seed, groups=12, base=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=60)
    out = []
    for _ in range(groups):
        words = rng.choices(vocab, k=rng.randint(5, base)) + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "over"), [(4, 85), (5, 80), (2, 60)])
def test_groups_match_all_pairs(spark, n, over):
    docs = near_copies(n)
    got = jaccard_join.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), n, over, 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(docs, n, over, 100)


def test_groups_on_awkward_rows(awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = jaccard_join.similar_groups(awkward)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(docs, 5, 80, 100)
    assert jaccard_join.similar_groups(empty).count() == 0


def test_large_regions_are_dealt_exactly(spark, monkeypatch):
    docs = near_copies(9, groups=4, base=60) * 1
    wide = [(i, t) for i, (_, t) in enumerate(docs + near_copies(10, groups=25, base=40))]
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 2)
    got = jaccard_join.similar_groups(spark.createDataFrame(wide, "doc_id bigint, text string"), 3, 70, 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(wide, 3, 70, 100)


@pytest.mark.parametrize(("rows", "over"), [(8, 50)])
def test_rounds_join_near_copies_exactly(spark, monkeypatch, rows, over):
    """Groups of near copies that no window divides, a chain of them, and one that falls apart in cells."""
    rng = random.Random(rows)
    base = [f"b{i}" for i in range(70)]
    docs = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(70)] = f"x{rng.randint(0, 9999)}"
        docs.append(" ".join(words))
    docs += [" ".join(f"s{i}" for i in range(k, k + 60)) for k in range(0, 200, 6)]
    docs = list(enumerate(docs))
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 5)
    counts = {}
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    jaccard_join._compared(frame, 2, over, 100, counts=counts)
    assert counts["regions"]["large"][0] > 0 and "round 1" in counts
    got = jaccard_join.similar_groups(frame, 2, over, 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(docs, 2, over, 100)


def test_long_words_are_told_apart(spark):
    a, b = "a" * 4096, "b" * 4096
    docs = [(1, a + b), (2, b + a), (3, a + b), (4, "w " * 3 + a + a + b), (5, "w " * 3 + a + b + a), (6, "c" * 200_000), (7, "c" * 200_001)]
    got = jaccard_join.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), 4, 85, 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(docs, 4, 85, 100)


def test_keys_of_many_sets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RARE", 10_000)
    docs = [(i, " ".join([f"b{j}" for j in range(80)] + [f"y{i}"])) for i in range(150)] + [(500, "alone here")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = jaccard_join.similar_groups(frame.repartition(7), 3, 90, 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(docs, 3, 90, 100)


def plain_link_counts(docs, n, over, under):
    sets = [plain_sets(t, n) for _, t in docs]
    linked = lambda a, b: bool(a and b) and under * len(a & b) >= over * len(a | b)
    return [sum(linked(s, t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rows", [3, 2000])
def test_links_match_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard_join, "REGION_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 20)
    docs = near_copies(12, groups=6) + [(900 + k, t) for k, (_, t) in enumerate(near_copies(12, groups=6)[:8])] + [(990, None), (991, ""), (992, "")]
    docs = docs + [(2000 + i, " ".join(f"k{j}" for j in range(150) if j != i)) for i in range(90)]  # one cell more than CELL
    got = sorted((tuple(r) for r in jaccard_join.similar_links(spark.createDataFrame(docs, "doc_id bigint, text string"), 3, 70, 100).collect()), key=repr)
    want = [(*g, k) for g, k in zip(sorted(plain_groups(docs, 3, 70, 100)), [k for _, k in sorted(zip([d for d, _ in docs], plain_link_counts(docs, 3, 70, 100), strict=True))], strict=True)]
    assert got == sorted(want, key=repr)


def test_links_on_awkward_rows(awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = jaccard_join.similar_links(awkward).collect()
    assert sorted(r["n_links"] for r in got) == sorted(plain_link_counts(docs, 5, 80, 100))
    assert jaccard_join.similar_links(empty).count() == 0


@pytest.mark.parametrize("over", [60, 85])
def test_cells_split_exactly(over):
    rng = np.random.default_rng(over)
    centre = [rng.choice(5000, 80, replace=False) for _ in range(5)]
    sets = []
    for _ in range(500):
        s = set(centre[rng.integers(5)].tolist())
        for _ in range(rng.integers(0, 25)):
            s.discard(int(rng.choice(list(s))))
            s.add(int(rng.integers(5000, 90000)))
        sets.append(np.array(sorted(s), np.uint64))
    region = jaccard_join.Region(sets, over, 100)
    region.join(np.arange(len(sets)))
    plain = list(range(len(sets)))

    def find(i):
        while plain[i] != i:
            i = plain[i]
        return i

    plain_sets_ = [set(s.tolist()) for s in sets]
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(plain_sets_[i] & plain_sets_[j]) >= over * len(plain_sets_[i] | plain_sets_[j]):
            plain[find(i)] = find(j)
    groups = lambda of: sorted(sorted(g) for g in _by(of, len(sets)))
    assert groups(find) == groups(lambda i: region.label[i])


def _by(of, n):
    out = {}
    for i in range(n):
        out.setdefault(of(i), []).append(i)
    return out.values()


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(5)
    for over in (85, 80, 50):
        classes = jaccard_join.Classes(over, 100, 5000)
        for _ in range(150):
            n = int(rng.integers(1, 400))
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = np.concatenate([a[int(rng.integers(0, n * 40 // 100 + 1)) :], rng.integers(0, 1 << 62, int(rng.integers(0, n * 30 // 100 + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if common == len(a) == len(b) or 100 * common < over * (len(a) + len(b) - common):
                continue
            keys, owner = jaccard_join.bucket_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes, np.array([0, 1]))
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_components_of_names(spark):
    rng = random.Random(7)
    name = lambda k: hashlib.md5(str(k).encode()).digest()[:15] + b"\0"
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    got = {bytes(r["id"]): bytes(r["component_id"]) for r in shared.connected_components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src binary, dst binary").repartition(3)).collect()}
    whole = {r["id"]: r["component_id"] for r in shared.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert {name(k) for k in whole} == set(got)
    assert all((whole[a] == whole[b]) == (got[name(a)] == got[name(b)]) for a in whole for b in whole)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(0, k) for k in range(1000, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    got = {r["id"]: r["component_id"] for r in shared.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint").repartition(5)).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in loops}


# Embeddings


def plain_links(vectors, cosine):
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def clustered(seed, n=400, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return [(int(i), (centres[rng.integers(8)] + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.4])).astype(np.float32).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize(("block", "region"), [(40, 64), (5000, 64), (40, 5), (7, 200)])
def test_vectors_match_all_pairs(spark, monkeypatch, block, region):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "REGION", region)
    vectors = clustered(3)
    vectors += [(1000 + i, vectors[i][1]) for i in range(15)] + [(2000 + i, [2 * c for c in vectors[i][1]]) for i in range(5)]
    near = plain_links(vectors, 0.95)
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")).collect()}
    label = {i: i for i, _ in vectors}
    ids = [i for i, _ in vectors]
    for _ in range(30):
        for a, b in zip(*np.nonzero(near), strict=True):
            label[ids[a]] = label[ids[b]] = min(label[ids[a]], label[ids[b]])
    for k, (i, _) in enumerate(vectors):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[k].sum(), label[i], label[i] == i)


def test_dual_traversal_prunes_and_misses_nothing():
    x = cover_tree.units(np.array([v for _, v in clustered(8, 900)], float))
    tree, limit = cover_tree.cover_tree(x.astype(np.float32)), np.sqrt(0.1)
    seen = np.zeros((900, 900), bool)
    for a, b in cover_tree.dual_leaves(tree, tree, limit):
        seen[np.ix_(a, b)] = True
    assert (seen | (x @ x.T < 0.95)).all() and seen.mean() < 0.9


def test_vectors_on_awkward_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label int, rep bigint, key string, node string, copies int"
    ok = [1.0, 2.0, 3.0]
    rows = [(1, ok), (1, ok), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0, 2.0]), (None, ok), (9, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame([(*r, None, 5, "k", "n", 3) for r in rows], kind)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), *((i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8)), (None, 0, None, True), (9, 2, 1, False)], key=repr)
    assert cover_tree.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_vectors_of_any_length_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e100]), (3, [1e-200, 0.0]), (4, [0.0, 1e-200]), (5, [0.0, 5e-324]), (6, [-1e308, -1e308]), (7, [-1.0, -1.0]), (8, [1e308, -1e-308])]
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 8: (3, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_clustered_vectors_are_sent_to_few_blocks(monkeypatch):
    """What travels grows in proportion where clusters lie apart."""
    rng = np.random.default_rng(2)
    centres = cover_tree.units(rng.normal(size=(60, 32)))
    for n in (1500, 7500):
        x = cover_tree.units(centres[rng.integers(60, size=n)] + rng.normal(size=(n, 32)) * 0.02)
        picked, far = [0], cover_tree._distances(x, x[:1])[:, 0]
        while len(picked) < 60:
            picked.append(int(far.argmax()))
            far = np.minimum(far, cover_tree._distances(x, x[picked[-1:]])[:, 0])
        d = cover_tree._distances(x, x[picked])
        home = d.argmin(1)
        radius = np.array([d[home == k, k].max() for k in range(60)])
        monkeypatch.setattr(cover_tree, "BLOCK", 300)
        blocks = cover_tree._blocks(x[picked], np.bincount(home, minlength=60))
        assert sorted(np.concatenate(blocks).tolist()) == list(range(60))
        near = d <= radius + np.sqrt(0.1) + 1e-6
        assert sum(near[:, g].any(1).sum() for g in blocks) < 1.1 * n


# Substring dedup


def naive_chunks(raw):
    """(start, content, words) of the chunks of a text, byte by byte."""

    def gear(i):
        h = sum(int(chunk_dedup._GEAR[raw[i - k] if i >= k else 10]) << 2 * k for k in range(16)) & 0xFFFFFFFF
        return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 8

    units = []
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        s, e = m.span()
        cuts = [p for p in range(s + 1, e) if e - s > 64 and gear(p - 1) % 32 == 0 and raw[p] & 0xC0 != 0x80]
        units += zip([s, *cuts], [*cuts, e], strict=True)
    out, held = [], []
    for s, e in units:
        held.append((s, e))
        if gear(e - 1) % 4 == 0 or len(held) == 64 or (s, e) == units[-1]:
            out.append((held[0][0], re.sub(rb"[\x09-\x0d]", b" ", raw[held[0][0] : e]), len(held)))
            held = []
    return out


def naive_groups(chunks):
    """(first, after the last) of the shortest runs of 20 words from each chunk on and up to each chunk."""
    n, out = [w for _, _, w in chunks], set()
    for i in range(len(n)):
        ahead = next((j for j in range(i + 1, len(n) + 1) if sum(n[i:j]) >= 20), None)
        behind = next((j for j in range(i, -1, -1) if sum(n[j : i + 1]) >= 20), None)
        out |= {(i, ahead)} if ahead else set()
        out |= {(behind, i + 1)} if behind is not None else set()
    return sorted(out)


def naive_dedup(docs):
    """One pass in order of the ids: text without what came before, and the documents that had it first."""
    seen, out = {}, []
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        chunks = naive_chunks(raw)
        gone, firsts, own = set(), set(), {}
        for i, j in naive_groups(chunks):
            key = tuple(c for _, c, _ in chunks[i:j])
            if key in seen:
                firsts.add(seen[key])
            if key in seen or key in own:
                gone |= set(range(i, j))
            own.setdefault(key, doc_id)
        seen |= {k: v for k, v in own.items() if k not in seen}
        stops = [s for s, _, _ in chunks[1:]] + [len(raw)]
        kept = b"".join([raw[: chunks[0][0]] if chunks else raw, *(raw[s:e] for k, ((s, _, _), e) in enumerate(zip(chunks, stops, strict=True)) if k not in gone)])
        out.append((doc_id, None if text is None else kept.decode(), sorted(firsts), len(gone)))
    return out


def deduplicated(spark, docs, parts):
    got = chunk_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)).collect()
    return sorted((r["doc_id"], r["text"], r["first_ids"], r["n_removed"]) for r in got)


def test_dedup_matches_one_pass_in_order(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert deduplicated(spark, docs, 3) == naive_dedup(docs)


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_dedup_is_the_same_however_rows_are_dealt(spark, parts):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(9000)]
    line, whole = " ".join(rng.choices(vocab, k=45)), " ".join(rng.choices(vocab, k=90))
    docs = [(k, " ".join(rng.choices(vocab, k=30)) + "\n" + line + " " + " ".join(rng.choices(vocab, k=25))) for k in range(5, 95)]
    docs += [(k, whole) for k in (1, 2, 3, 100, 101, 102, 103, 104)] + [(99, whole + " " + line), (110, ("w" * 70 + "\u00e9") * 40), (111, ("w" * 70 + "\u00e9") * 40 + " x")]
    got = deduplicated(spark, docs, parts)
    assert got == naive_dedup(docs)
    assert {i: f for i, _, f, _ in got}[104] == [1]


def test_common_passages_are_salted(spark):
    rng = random.Random(13)
    docs = spark.createDataFrame([(k, k, " ".join(f"v{rng.randint(0, 9999)}" for _ in range(30)) + " " + " ".join(f"c{i}" for i in range(40))) for k in range(40)], "doc_id bigint, twin bigint, text string")
    common = chunk_dedup._common(docs)
    assert len(common) and (docs.mapInArrow(chunk_dedup._digests(common), chunk_dedup._ROWS).where("salt > 0").groupBy("digest").agg({"salt": "max"}).count()) == len(common)


def test_passages_go_and_the_first_stays(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60000)]
    passages = [" ".join(rng.choices(vocab, k=51)) for _ in range(100)]
    docs = []
    for k in range(300):
        own = rng.choices(vocab, k=rng.randint(40, 90))
        docs.append((k, " ".join(own[:30]) + rng.choice(["\n", " ", "\t "]) + passages[k % 100] + " " + " ".join(own[30:])))
    clean = [(1000 + k, " ".join(rng.choices(vocab, k=80))) for k in range(100)]
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_substrings(spark.createDataFrame(docs + clean, "doc_id bigint, text string")).collect()}
    assert sum(got[k]["n_removed"] > 0 for k in range(100, 300)) >= 195
    assert all(k % 100 in got[k]["first_ids"] for k in range(100, 300) if got[k]["n_removed"])
    assert all(got[k]["text"] == t for k, t in docs[:100] + clean)
    assert np.mean([got[k]["removed_words"] for k in range(100, 300)]) > 40


def test_cuts_fall_in_step_after_an_insertion():
    rng = random.Random(3)
    words = [f"u{rng.randint(0, 9999)}" for _ in range(500)]
    a = chunk_dedup.chunks([" ".join(words).encode()])[2]
    b = chunk_dedup.chunks([" ".join([*words[:200], "inserted", "words", *words[200:]]).encode()])[2]
    assert len(set(a.tolist()) - set(b.tolist())) <= 3


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(300)), np.uint8)
    got = chunk_dedup.gear(data)
    h = 0
    for i, b in enumerate(data.tolist()):
        h = ((h << 2) + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        x = h
        if i >= 16:
            x = sum(int(chunk_dedup._GEAR[data[i - k]]) << (2 * k) for k in range(16)) & 0xFFFFFFFF
        assert got[i] == ((x ^ (x >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 8


def test_dedup_on_awkward_rows(awkward, empty):
    got = chunk_dedup.dedup_substrings(awkward).collect()
    source = awkward.collect()
    assert len(got) == len(source)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert None in texts[0] and texts[5] == [""] and texts[None][0] == next(r["text"] for r in source if r["doc_id"] is None)
    assert sorted(x[:9] for x in texts[4]) == sorted(r["text"][:9] for r in source if r["doc_id"] == 4)
    assert all(r["key"] == "clash" for r in got)
    assert chunk_dedup.dedup_substrings(empty).count() == 0


def test_text_without_a_repeated_window_stays(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)]  # every short phrase is soon seen somewhere
    docs, seen = [], set()
    while len(docs) < 120:
        words = rng.choices(vocab, k=120)
        windows = [tuple(words[i : i + 20]) for i in range(101)]
        assert not seen & set(windows) and len(set(windows)) == 101
        seen |= set(windows)
        docs.append((len(docs), " ".join(words)))
    copied = docs[7][1].split()[30:90]
    mixed = (500, " ".join([*docs[50][1].split()[:9], *copied, *docs[60][1].split()[:9]]))
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_substrings(spark.createDataFrame([*docs, mixed], "doc_id bigint, text string")).collect()}
    assert [got[i]["text"] for i, _ in docs] == [t for _, t in docs]
    assert got[500]["first_ids"] == [7] and 20 <= got[500]["removed_words"] <= 60
    assert set(got[500]["text"].split()[:9]) == set(mixed[1].split()[:9])


def test_groups_cover_a_passage_and_stay_in_their_text():
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 200))).encode() for _ in range(50)]
    doc, _, digest, words = chunk_dedup.chunks(texts)
    first, stop, value = chunk_dedup.groups(doc, digest, words)
    total = [words[a:b].sum() for a, b in zip(first, stop, strict=True)]
    assert all(t >= 20 for t in total) and all(doc[a] == doc[b - 1] for a, b in zip(first, stop, strict=True))
    assert all(t - words[a] < 20 or t - words[b - 1] < 20 for t, a, b in zip(total, first, stop, strict=True))
    covered = {k for a, b in zip(first, stop, strict=True) for k in range(a, b)}
    assert covered == {k for k in range(len(doc)) if words[doc == doc[k]].sum() >= 20}
    of = {}
    for a, b, v in zip(first, stop, value.tolist(), strict=True):
        assert of.setdefault(v, tuple(digest[a:b])) == tuple(digest[a:b])
    assert len(of) == len({tuple(digest[a:b]) for a, b in zip(first, stop, strict=True)})


# Pipeline


def test_stages_on_awkward_rows(spark, awkward, empty, labels, tmp_path):
    for name, source in (("full", awkward), ("none", empty)):
        d = str(tmp_path / name)
        source.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_one_row_of_a_group_stays(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, words[0]), (1, words[0]), (2, words[0] + " z"), (3, words[1]), (5, words[1]), (5, words[2]), (6, words[2]), (2, words[2]), (7, ""), (7, ""), (8, None), (None, "q r s t u v"), (None, "q r s t u v"), (9, None)]
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id bigint, text string, lang string, _twins string")
    out = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, words[0]), (3, words[1]), (2, words[2]), (7, ""), (8, None), (9, None), (None, "q r s t u v")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.keep_one_of_similar(spark, docs.limit(0), "").count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = shared.settle(stage(spark, docs, data), "test")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = plain_groups(list(kept.items()), 5, 80, 100)
    assert all(d == c for d, _, c in groups)
    packed = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_a_common_passage_sends_a_row_for_each_task(spark, monkeypatch):
    rng = random.Random(14)
    line = " ".join(f"c{i}" for i in range(40))
    docs = [(k, " ".join(f"v{rng.randint(0, 9999)}" for _ in range(30)) + " " + line) for k in range(7, 607)] + [(3, line), (3, line), (3, line + " x"), (700, line + " " + line)]
    told = spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(docs)], "doc_id bigint, twin bigint, text string")
    common = chunk_dedup._common(told)
    rows = told.repartition(4).mapInArrow(chunk_dedup._digests(common), chunk_dedup._ROWS).where("salt > 0").groupBy("digest").count().collect()
    assert len(rows) == len(common) and all(r["count"] <= 4 for r in rows)
    made, settle = {}, chunk_dedup.settle
    monkeypatch.setattr(chunk_dedup, "settle", lambda df, label: made.setdefault(label, settle(df, label)))
    got = deduplicated(spark, docs, 5)
    assert made["marks"].count() < 100  # what all documents have isn't gathered by document; a few share a word before it too
    monkeypatch.setattr(chunk_dedup, "COMMON", 0)
    made.clear()
    assert deduplicated(spark, docs, 3) == got
    assert all(n and 3 in f for i, _, f, n in got if i > 3)


def test_texts_come_out_of_a_column_in_runs():
    texts = [None, "", "é" * 10, "x" * 5, None, "y" * 200, "", "z" * 30, "w" * 8]
    column = pa.array([*texts, "no"]).slice(0, len(texts))
    got = list(shared.text_runs(column, 40))
    assert [t for _, part in got for t in part] == [(t or "").encode() for t in texts]
    assert [at for at, _ in got] == np.cumsum([0, *(len(part) for _, part in got[:-1])]).tolist()
    assert all(sum(map(len, part)) <= 40 or len(part) == 1 for _, part in got) and list(shared.text_runs(column.slice(0, 0), 40)) == []


def test_edges_and_regions_are_held_a_part_at_a_time(spark, monkeypatch):
    rng = random.Random(15)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    names = [(b"%016d" % a, b"%016d" % b) for a, b in edges]
    for rows, kind in ((edges, pa.int64()), (names, pa.binary())):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*rows[i : i + 40], strict=True)], ["src", "dst"]) for i in range(0, 250, 40)]
        tree = [r for b in shared._forest_batches(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        whole = {k: v for k, v in tree}
        for a, b in rows:
            assert whole.get(a, a) == whole.get(b, b) and (kind == pa.binary() or whole.get(a, a) <= min(a, b))
    monkeypatch.setattr(jaccard_join, "SLICE_ROWS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 7 + [2] * 2 + [3]), pa.array(range(10))], ["key", "x"])
    assert list(jaccard_join._grouped([batch, batch.slice(9)], 1)) == [((1,), [list(range(7))]), ((2,), [[7, 8]]), ((3,), [[9, 9]])]
    links = jaccard_join._compared(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60 + i % 3))) for i in range(12)], "doc_id bigint, text string"), 4, 85, 100)[1]
    made, settle = [], jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df, label: (made.append(label), settle(df, label))[1])
    monkeypatch.setattr(jaccard_join, "_compared", lambda *a: (spark.createDataFrame([(1, 2, b"%016d" % 1, 1)], "doc_id bigint, twin bigint, node binary, n_shingles bigint"), links))
    jaccard_join.first_rows(None).collect()
    assert made == ["links"]  # one Python worker for a task


def test_few_links_of_many_tasks_make_few_files(spark, monkeypatch):
    """For each file that an executor writes it starts processes, which share its memory at first and may be counted as much again."""
    from pyspark.sql import functions as F

    links = spark.range(0, 400, 1, 40).select(*(F.lpad(F.expr(f"id div {n}").cast("string"), 16, "0").cast("binary").alias(c) for n, c in ((1, "src"), (10, "dst"))))
    rows = spark.range(400).select("id", F.col("id").alias("twin"), F.lpad(F.col("id").cast("string"), 16, "0").cast("binary").alias("node"), F.lit(1).alias("n_shingles")).withColumnRenamed("id", "doc_id")
    files, settle = {}, jaccard_join.settle

    def counted(df, label):
        out = settle(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(jaccard_join, "settle", counted)
    monkeypatch.setattr(jaccard_join, "_compared", lambda *a: (rows, links))
    assert jaccard_join.first_rows(None).count() == jaccard_join.similar_groups(None).select("component_id").distinct().count() == 1
    assert files["links"] <= 4
