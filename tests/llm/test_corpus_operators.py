"""Substring dedup, vectors, SentencePiece, near-dedup, language ID and the pipeline against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from test_batch_operators import base_counts, crc, in_bands, library_ids
from webloom.llm import _kernels as K
from webloom.llm import embed_dedup, language_id, order_minhash, packing, queries, spm_viterbi, substring_dedup
from webloom.llm._spark import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Substring dedup.


def brute_substrings(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def as_counter(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_substrings_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in docs_of(spark, sf).collect()]
    assert as_counter(queries.op2_level_doubling(spark, sf)) == brute_substrings(rows, 35)


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_substrings_odd_rows(spark, levels):
    rng = random.Random(levels)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "x y z " * 30), (None, "q r s t u v w x y z a b c d"), (None, "q r s t u v w x y z a b c d"), (104, "é漢 " * 20), (1, rows[1][1]), (1, "another text of the same id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, grp int, kept_sha256 int")
    assert as_counter(substring_dedup.judge(df, 9, levels)) == brute_substrings(rows, 9)
    assert substring_dedup.judge(df.limit(0), 9, levels).count() == 0


def test_substrings_of_crowds(spark, monkeypatch):
    """Rows equal in id and text by the thousand: with a window, without one, and with one that other rows have too."""
    monkeypatch.setattr(substring_dedup, "COPIES", 20)
    long, short = " ".join(f"w{k}" for k in range(50)), "too short \n to have a window"
    rows = [(None, long)] * 2000 + [(5, short)] * 300 + [(6, long + " tail")] * 15 + [(7, "head " + " ".join(f"w{k}" for k in range(8, 45)) + " end")] + [(8, None)] * 40 + [(9, "")] * 30 + [(5, long)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, n_chars int, _wl_id string").repartition(4)
    assert as_counter(substring_dedup.judge(df)) == Counter(brute_substrings(rows, 35))
    left = Counter((r.doc_id, r.text, r.n_chars) for r in substring_dedup.remove(df.drop("_wl_id")).collect())
    assert left[(None, "", 0)] == 2000 and left[(5, short, 9)] == 300 and left[(6, "", 0)] == 15 and left[(7, "head end", 8)] == 1 and left[(8, None, 9)] == 40 and left[(9, "", 9)] == 30 and left[(5, "", 0)] == 1


def test_substrings_hold_little_of_a_group(monkeypatch):
    texts = pa.table({"_wl_text": [" ".join(f"w{(i * j) % 997}" for j in range(400)) for i in range(1500)]})
    K.powers(1 << 16), K.powers(1 << 16, 1)
    sizes = substring_dedup.lengths(35)
    none = pa.table({"level": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary())})
    level = substring_dedup.Level(sizes, [np.zeros(0, kind) for kind in substring_dedup._kinds(sizes)])
    tracemalloc.start()
    for _, _, data, starts, ends, word_offsets in substring_dedup.Texts(texts.column("_wl_text")):
        assert not level.candidates(K.span_hashes(data, starts, ends), word_offsets)[0].any()
    assert sum(1 for _ in substring_dedup._cut(texts, none, sizes)) == 1500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 2_000_000 and peak < 36_000_000
    given_back = []
    monkeypatch.setattr(K, "release", lambda: given_back.append(1))
    assert substring_dedup._one_group(lambda a: a)(1) == 1 and substring_dedup._one_group(lambda a, b: a + b)(1, 2) == 3
    assert len(given_back) == 2


def test_substrings_removed_text(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"first\n{passage} end  of", 9, "a"), (2, f"{passage} second", 9, "b"), (3, "kept  as\nit is", 14, None), (4, None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, grp string")
    got = {r.doc_id: tuple(r) for r in substring_dedup.remove(df, 10).collect()}
    assert got == {1: (1, "first end  of", 13, "a"), 2: (2, "second", 6, "b"), 3: rows[2], 4: rows[3]}
    assert substring_dedup.remove(df, 10).schema == df.schema


# Vectors.


def brute_vectors(rows, threshold=0.95):
    good = [(k, np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.linalg.norm(v) > 0]
    linked, root = defaultdict(set), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in good:
        for b, y in good:
            if a < b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                linked[a].add(b)
                linked[b].add(a)
                root[max(find(a), find(b))] = min(find(a), find(b))
    head = {}
    for k, (vec_id, _) in enumerate(rows):
        head[find(k)] = min(head.get(find(k), vec_id), vec_id)
    return Counter((vec_id, len(linked[k]), head[find(k)], vec_id == head[find(k)]) for k, (vec_id, _) in enumerate(rows))


def vector_counter(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def test_vectors_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert vector_counter(queries.op6_spherical_cells(spark, sf)) == brute_vectors(rows)


def test_vectors_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(k, (base[k % 12] + rng.normal(size=8) * 0.12 * (k % 5)).astype(np.float32).tolist()) for k in range(240)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [float("inf")] + [1.0] * 7), (305, [1.0, 0.0]), (306, [2.0, 0.0]), (307, rows[5][1]), (308, rows[5][1]), (309, rows[5][1]), (310, None)]
    rows.append((311, [1.0] * 7 + [None]))
    monkeypatch.setattr(embed_dedup, "PER_CELL", 20)
    monkeypatch.setattr(embed_dedup, "HOME_BLOCK", 7)
    monkeypatch.setattr(embed_dedup, "VISIT_BLOCK", 9)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string")
    assert vector_counter(embed_dedup.classes(df)) == brute_vectors(rows)
    assert embed_dedup.classes(df.limit(0)).count() == 0


def test_vectors_of_extreme_components(spark):
    """Components whose squares are not numbers, or zero, in double precision."""
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e300, -1e300]), (6, [1.0, 1.0]), (7, [1e200, float("inf")]), (8, [0.0, 0.0]), (9, [1e-310, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.classes(df).collect()}
    assert got == {**{k: (4, 1) for k in (1, 2, 3, 4, 6)}, **{k: (0, k) for k in (5, 7, 8, 9)}}


def test_visits_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, seen = embed_dedup.visits(x, embed_dedup.spherical_kmeans(x, 12), np.sqrt(0.1) + 1e-9)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    lost = [(a, b) for a, b in zip(i, j) if home[a] != home[b] and not (seen[a, home[b]] if home[a] > home[b] else seen[b, home[a]])]
    assert len(i) > 200 and not lost


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    root = {}
    for _ in range(250):
        for a, b in edges:
            if a != b:
                m = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = m
    assert got == root


# SentencePiece.


def viterbi(encoder, points):
    """The whole lattice at once."""
    n = len(points)
    cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for i in range(1, n + 1):
        for size in range(min(i, encoder.longest), 0, -1):
            k = encoder.pieces.get(tuple(points[i - size : i]))
            own = k[1] if k else encoder.unknown if size == 1 else float("inf")
            if cost[i - size] + own < cost[i]:
                cost[i], back[i] = cost[i - size] + own, i - size
    ids, i = [], n
    while i:
        k = encoder.pieces.get(tuple(points[back[i] : i]))
        ids = ([k[0]] if k else encoder.byte_ids[list(spm_viterbi._bytes_of(points[back[i]]))].tolist()) + ids
        i = back[i]
    return ids


TEXTS = st.text(alphabet="aabcdeeeiinnorstt   \n\t▁é漢🙂.,", max_size=90)


@settings(max_examples=120, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_pieces_and_stream_equal_the_lattice(texts):
    e = spm_viterbi.encoder(spm_viterbi.default_path())
    ids, offsets = e.encode_texts(texts)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        want = viterbi(e, e.points(" " + t)) if t else []
        assert ids[a:b].tolist() == want
        assert list(e.stream(e.points(" " + t) if t else [])) == want
        assert e.decode(want) == t


def test_stream_keeps_a_window():
    e = spm_viterbi.encoder(spm_viterbi.default_path())
    text = "xthequickbrown" * 3000
    read = 0

    def points():
        nonlocal read
        for p in e.points(" " + text):
            read += 1
            yield p

    lag, done = 0, 0
    for i in e.stream(points()):
        done += len(e.texts[i])
        lag = max(lag, read - done)
    assert done == len(text) + 1 and lag < 300


def test_unbroken_runs_take_linear_time():
    """Runs whose paths do not meet, 200,000 characters each; ids equal the lattice's on shorter ones."""
    import base64
    import random
    import time

    e, n = spm_viterbi.encoder(spm_viterbi.default_path()), 200_000
    noise = base64.b64encode(random.Random(4).randbytes(n)).decode()
    for run in ("a" * n, noise[:n], "=" * n, "abc" * (n // 3), "-" * n):
        began = time.process_time()
        ids = list(e.stream(e.points(" " + run)))
        assert time.process_time() - began < 20
        assert "".join(e.texts[i].decode() for i in ids) == " " + run
        short = " " + run[:300]
        assert list(e.stream(e.points(short))) == viterbi(e, e.points(short))
    both, offsets = e.encode_texts(["x " + "a" * n, noise[:n]])
    assert e.decode_flat(both.astype(int), offsets)[0].tobytes().decode() == "x " + "a" * n + noise[:n]


def test_round_trip_whole_table(spark, sf):
    rows = queries.op8_streaming_viterbi(spark, sf).collect()
    assert len(rows) == docs_of(spark, sf).count() and all(r.round_trip for r in rows)
    odd = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "x" * 100000, 3), (2, " a  ▁b\n", 3)], "doc_id long, text string, ids int")
    assert all(r.round_trip for r in spm_viterbi.encode(odd, check=True).collect())
    got = {(r.doc_id, r.decoded) for r in spm_viterbi.decode(spm_viterbi.encode(odd)).collect()}
    assert got == {(1, ""), (None, ""), (2, "x" * 100000), (2, " a  ▁b\n")}
    assert spm_viterbi.encode(odd.limit(0)).count() == 0


def test_ids_of_the_whole_table_equal_the_lattice_and_the_stream(spark, sf):
    import zlib

    e = spm_viterbi.encoder(spm_viterbi.default_path())
    ids = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op8_streaming_viterbi(spark, sf).collect()}
    for r in docs_of(spark, sf).collect():
        streamed = list(e.stream(e.points(" " + r.text))) if r.text else []
        if len(r.text or "") < 2000:
            assert streamed == (viterbi(e, e.points(" " + r.text)) if r.text else [])
        assert ids[r.doc_id] == (len(streamed), zlib.crc32(np.array(streamed, "<u4").tobytes()))


def test_models_with_pieces_over_words_are_streamed():
    e = spm_viterbi.Encoder(spm_viterbi.default_path())
    e.pieces[tuple(e.points(" of the"))] = (5, -100.0)
    e.longest, e.over_words = max(e.longest, 7), True
    texts = ["one of the cats", "", "of the"]
    ids, offsets = e.encode_texts(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [viterbi(e, e.points(" " + t)) if t else [] for t in texts]
    assert ids.tolist().count(5) == 2


# Near-dedup.


def shingles(text):
    w = WORD.findall(text or "")
    seen, out = Counter(), []
    for g in ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)] if w else []):
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def brute_classes(rows):
    all_shingles = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    for k, s in enumerate(all_shingles):
        for x in s:
            index[x].append(k)
    shared = Counter((a, b) for ks in index.values() for n, b in enumerate(ks) for a in ks[:n])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        both = len(all_shingles[a]) + len(all_shingles[b])
        if 9 * n >= 4 * both and find(a) != find(b):
            m = longest_common(all_shingles[a], all_shingles[b])
            if 5 * m >= 4 * (both - m):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: rows[find(k)][0] for k, (d, _) in enumerate(rows)}


def test_near_duplicates_whole_table(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in docs_of(spark, sf).collect())
    got = {r.doc_id: r.component_id for r in queries.op9_order_minhash(spark, sf).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_odd_rows(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]

    def edited(n):
        w = list(base)
        for _ in range(n):
            w[rng.randrange(len(w))] = "new"
        return " ".join(w)

    rows = [(10, " ".join(base)), (11, edited(2)), (12, edited(2)), (13, " ".join(base)), (14, " ".join(base[100:] + base[:100])), (15, " ".join(f"v{k}" for k in range(200))), (16, None), (17, ""), (18, ""), (19, "a b"), (20, "a b"), (21, "a c"), (22, "x " * 300), (23, "x " * 310), (None, " ".join(base))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.component_id, r.kept) for r in order_minhash.classes(df).collect()}
    assert got == {10: (10, True), 11: (10, False), 12: (10, False), 13: (10, False), 14: (14, True), 15: (15, True), 16: (16, True), 17: (17, True), 18: (18, True), 19: (19, True), 20: (19, False), 21: (21, True), 22: (22, True), 23: (22, False), None: (10, False)}
    assert sorted(r.doc_id for r in order_minhash.keep_one(df).collect()) == [10, 14, 15, 16, 17, 18, 19, 21, 22]
    assert order_minhash.classes(df.limit(0)).count() == 0


def test_near_duplicates_of_equal_rows(spark):
    """Rows equal in id and text by the thousand, and a near copy of them."""
    text = " ".join(f"word{k}" for k in range(120))
    rows = [(None, text)] * 3000 + [(4, text.replace("word60", "other"))] + [(5, "something else that is short")] * 500
    got = Counter((r.doc_id, r.component_id) for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, 4): 3000, (4, 4): 1, (5, 5): 500}


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Members that no lead of a bucket is near to are linked without further rounds too."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]

    def edited(words, n):
        w = list(words)
        for at in rng.sample(range(60), n):
            w[at] = f"e{rng.randint(0, 2)}"
        return w

    rows = [(k, " ".join(edited(base, rng.randint(1, 4)))) for k in range(150)]
    monkeypatch.setattr(order_minhash, "ROUNDS", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in order_minhash.classes(df).collect()} == brute_classes(rows)


def test_near_duplicates_at_the_threshold(spark):
    """Families of 80 to 150 words with 1 to 3 words replaced: no link is lost to leads, rounds or sketches."""
    rng = random.Random(17)
    rows = []
    for words, edits in ((80, 1), (100, 2), (150, 3)):
        base = [f"f{words}w{k}" for k in range(words)]
        for _ in range(120):
            w = list(base)
            for at in rng.sample(range(words), edits):
                w[at] = f"e{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in order_minhash.classes(df).collect()} == brute_classes(rows)


def test_near_duplicates_of_texts_that_share_a_key(spark, sf, monkeypatch):
    monkeypatch.setattr(order_minhash, "key_of", lambda text: F.coalesce(F.length(text).cast("long") % 50, F.lit(0)))
    rows = sorted((r.doc_id, r.text) for r in docs_of(spark, sf).collect())[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {r.doc_id: r.component_id for r in order_minhash.classes(df).collect()} == want
    assert {r.doc_id for r in order_minhash.keep_one(df).collect()} == set(want.values())


def test_near_duplicates_go_by_row(spark):
    near = " ".join(f"w{k}" for k in range(60))
    other, third = " ".join(f"v{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    # 1: a null row near a document; 2: a null row of its own text; 3 and 4: an id of two texts; 5: repeats of an id or of null.
    rows = [(1, near, "1"), (None, near + " x", "1"), (None, other, "2"), (5, near + " y", "3"), (5, third, "4"), (6, "a b c", "5"), (6, "a b c", "5"), (None, "d e", "6"), (None, "d e", "6"), (None, None, "7"), (None, None, "7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    kept = order_minhash.keep_one(df)
    assert kept.schema == df.schema
    assert Counter(tuple(r) for r in kept.collect()) == Counter([rows[0], rows[2], rows[4], rows[5], rows[7], rows[9], rows[10]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=80, unique=True), st.lists(st.tuples(st.integers(0, 79), st.integers(0, 30)), max_size=8))
def test_band_loses_no_alignment(a, edits):
    b = list(a)
    for at, x in edits:
        if x not in b:
            b[at % len(b)] = x
        elif len(b) > 1:
            b.remove(x)
    m = longest_common(a, b)
    want = 5 * m >= 4 * (len(a) + len(b) - m)
    assert order_minhash.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_sketch_in_steps(monkeypatch):
    values = np.random.default_rng(2).integers(0, 2**62, 5000).astype(np.uint64)
    whole = order_minhash.sketch(values)
    monkeypatch.setattr(order_minhash, "STEP", 257)
    assert np.array_equal(order_minhash.sketch(values), whole)


# Language ID.


def test_languages_held_out(spark, sf):
    rows = {r.doc_id: r for r in queries.op10_cross_parsing(spark, "/root/testdata/sf0.01").collect()}
    import zlib

    truth = {r.doc_id: r.lang for r in docs_of(spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == truth.keys()
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out == (d in set(held)) for d in truth) and all(0 <= r.score <= 1 for r in rows.values())
    assert np.mean([rows[d].lang_pred == truth[d] for d in held]) > 0.97


def test_phrases_equal_greedy_parse():
    texts = {"a": ["the cat sat on the mat and the dog"], "b": ["le chat est sur la table et le chien"]}
    model = language_id.Model(texts)
    samples = ["the chat sat on la mat", "xyz", "élan the the", "", "12 !", "a" * 1000]
    data, offsets = language_id.normalised(samples)
    got = model.phrases(data, offsets)
    for k, language in enumerate(model.languages):
        known = bytes(language_id.normalised([" ".join(texts[language])])[0])
        for n in range(len(samples)):
            whole, count = bytes(data[offsets[n] : offsets[n + 1]]), 0
            for s in range(0, len(whole), language_id.SEGMENT):
                rest = whole[s : s + language_id.SEGMENT]
                while rest:
                    size = max([m for m in range(1, len(rest) + 1) if rest[:m] in known], default=1)
                    rest, count = rest[size:], count + 1
            assert got[n, k] == count


def test_languages_odd_rows(spark):
    rows = [(k, f"the house and the garden number {k}", "en", 1) for k in range(20)] + [(100 + k, f"la maison et le jardin avec {k}", "fr", 1) for k in range(20)]
    rows += [(200, None, "en", 1), (201, "", "fr", 1), (202, "12 -- !", "en", 1), (203, "le jardin", None, 1), (None, "the garden", "de", 1), (205, "the house " * 20000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[203][0] == "fr" and got[None][0] == "en" and got[205][0] == "en" and len(got) == len(rows)
    kept = language_id.keep_known(df)
    assert kept.schema == df.schema and kept.count() == len(rows) - 3
    assert language_id.identify(df.limit(0)).count() == 0
    unlabelled = df.where("lang is null")
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.keep_known(unlabelled).count() == unlabelled.count() == 2
    assert {r.doc_id for r in language_id.keep_known(df, {"fr"}).collect()} == {*range(100, 120), 203}


def test_texts_of_no_learned_language_go(spark, sf):
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (40, 400, 4000)]
    docs = docs_of(spark, sf)
    other = [t for (t,) in docs.where("lang = 'de' and length(text) > 300").select("text").collect()]
    learned = docs.where("lang in ('en', 'fr')")
    more = spark.createDataFrame([(10_000 + k, t, None, "x", 0) for k, t in enumerate([*noise, *other])], docs.schema)
    kept = {r.doc_id for r in language_id.keep_known(learned.union(more).withColumn("_wl_lettered", F.lit(False))).collect()}
    assert not {d for d in kept if d < 10_003 and d >= 10_000} and len([d for d in kept if d >= 10_003]) <= len(other) // 20
    assert {r.doc_id for r in learned.where(r"text rlike '\\p{L}'").collect()} <= kept


def test_every_label_is_learned(spark, monkeypatch):
    """No label is left out, however many there are, also where the sample is too large to broadcast."""
    monkeypatch.setattr(language_id, "MAX_CHOSEN", 0)
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 30, f"l{k:03}") for k in range(400)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), chars=50)
    assert model.languages == [r[2] for r in rows]


def test_predictions_equal_a_greedy_parse_of_the_whole_table(spark, sf):
    """Every text of the table against each language's learned bytes, parsed phrase by phrase."""
    docs = docs_of(spark, sf)
    model = language_id.fit(docs, ~language_id.held_out() & F.col("doc_id").isNotNull(), chars=1500)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = {k: bytes(language_id.normalised([" ".join(t)])[0]) for k, t in _learned(docs, 1500).items()}
    assert sorted(known) == model.languages
    texts = [t or "" for _, t in rows]
    data, offsets = language_id.normalised(texts)
    got = model.phrases(data, offsets)
    for k, language in enumerate(model.languages):
        for n in range(len(texts)):
            whole, count = bytes(data[offsets[n] : offsets[n + 1]]), 0
            for s in range(0, len(whole), language_id.SEGMENT):
                rest = whole[s : s + language_id.SEGMENT]
                while rest:
                    size = 1
                    while size < len(rest) and rest[: size + 1] in known[language]:
                        size += 1
                    rest, count = rest[size:], count + 1
            assert got[n, k] == count


def test_predicted_languages_and_scores_equal_a_greedy_parse(spark, sf):
    """The registered query at its own settings, for a quarter of the table: phrases by a plain search in each language's learned bytes."""
    import math
    import zlib

    docs = docs_of(spark, sf)
    known = {k: bytes(language_id.normalised([" ".join(t)])[0]) for k, t in _learned(docs, language_id.CHARS).items()}
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op10_cross_parsing(spark, sf).collect()}
    checked = 0
    for doc_id, text in ((r.doc_id, r.text) for r in docs.where("doc_id % 4 = 1").collect()):
        whole, costs = bytes(language_id.normalised([text or ""])[0]), {}
        for language, learned in known.items():
            count = 0
            for s in range(0, len(whole), language_id.SEGMENT):
                rest = whole[s : s + language_id.SEGMENT]
                while rest:
                    size = 1
                    while size < len(rest) and rest[: size + 1] in learned:
                        size += 1
                    rest, count = rest[size:], count + 1
            costs[language] = count * math.log2(max(len(learned), 2))
        least, second = sorted(costs.values())[:2]
        lettered = any(c.isalpha() for c in text or "")
        want = (zlib.crc32(str(doc_id).encode()) % 5 == 0, min(sorted(costs), key=costs.get) if lettered else "und")
        assert got[doc_id][:2] == want
        assert got[doc_id][2] == pytest.approx(1 - least / second if lettered and second else 0.0, abs=1e-9)
        checked += 1
    assert checked >= 40


def _learned(docs, chars):
    """The sample by hand: per language the rows that are not held out in the order of the hash of doc_id."""
    import zlib

    ranked = docs.where(r"text rlike '\\p{L}' and lang is not null and doc_id is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    out, sizes = defaultdict(list), Counter()
    for r in sorted(ranked, key=lambda r: (r.lang, r.h)):
        held = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        before = sizes[r.lang]
        if not held and before < chars:
            text = r.text[next(i for i, c in enumerate(r.text) if c.isalpha()) :][:chars]
            sizes[r.lang] += len(text.encode())
            out[r.lang].append(text.encode()[: chars - before].decode(errors="ignore"))
    return out


def test_languages_of_long_texts_and_many(spark, monkeypatch):
    """A language has training text however long its texts are and however many languages there are."""
    rows = [(k, "12 " * 9000 + "the house and the garden " * 2000, "en") for k in range(5)] + [(10 + k, "la maison et le jardin avec " * 2000, "fr") for k in range(5)]
    words = {f"l{n:02}": " ".join(chr(97 + (n * 7 + k * k) % 26) * (1 + k % 3) + chr(97 + n % 26) for k in range(9000)) for n in range(20)}
    rows += [(100 + 10 * n + k, t, lang) for n, (lang, t) in enumerate(words.items()) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    assert model.languages == sorted({"en", "fr", *words})
    assert (model.weights > np.log2(20_000)).all()
    assert model.predict(["the garden and the house", "le jardin et la maison"])[0] == ["en", "fr"]


def test_sparse_moves_equal_the_full_table(monkeypatch):
    texts = {"a": ["the cat sat on the mat and the dog"], "b": ["le chat est sur la table et le chien"], "c": ["élan ñandú"]}
    data, offsets = language_id.normalised(["the chat sat on la mat", "xyz", "élan the the", "", "a" * 1000, "q the dog ñ le"])
    full = language_id.Model(texts)
    monkeypatch.setattr(language_id, "FULL", 0)
    sparse = language_id.Model(texts)
    assert full.full and not sparse.full and np.array_equal(full.phrases(data, offsets), sparse.phrases(data, offsets))


# Pipeline.


def test_pipeline_stage_by_stage(spark, sf):
    import zstandard

    docs = docs_of(spark, sf)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_dedup", "substring_dedup", "packing"]
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != "packing":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), now.schema)
        out[name] = now
    before = {r.doc_id: r for r in docs.collect()}
    lettered = {d for d, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in out["language_id"].collect()} == lettered  # no text of this table is of another language
    z = zstandard.ZstdCompressor(level=3)
    assert {r.doc_id for r in out["quality_rules"].collect()} == {d for d in lettered if not base_counts(before[d].text)[5] and in_bands(before[d].text, z)}
    classes = brute_classes(sorted((r.doc_id, r.text) for r in out["quality_rules"].collect()))
    assert {r.doc_id for r in out["near_dedup"].collect()} == {d for d, c in classes.items() if d == c}
    rows = [(r.doc_id, r.text) for r in out["near_dedup"].collect()]
    kept = {k[0]: k[3] for k in brute_substrings(rows, 35)}
    for r in out["substring_dedup"].collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == kept[r.doc_id]
    rows = [(r.doc_id, r.text) for r in out["substring_dedup"].collect()]
    want = Counter()
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        at = 0
        for size in [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if len(ids) % 1024 >> b & 1]:
            want[(i, at, size, crc(ids[at : at + size]), len(ids), 0)] += 1
            at += size
    assert Counter(tuple(r) for r in out["packing"].drop("sequence_id").collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).drop("sequence_id").collect()) == want


def test_pipeline_of_odd_rows(spark, sf, tmp_path):
    """Null ids, repeated rows, null and empty texts, names that clash, and no rows at all."""
    docs = docs_of(spark, sf).where("doc_id < 60").withColumns({"n_words": F.lit(1), "row": F.lit("r"), "length": F.lit(2)})
    text = docs.orderBy(F.length("text").desc()).first()["text"]
    odd = spark.createDataFrame([(None, text, "en", "s", 1, 1, "r", 2), (None, None, "en", "s", 0, 1, "r", 2), (7000, "", None, None, None, 1, "r", 2)], docs.schema)
    for name, table in (("odd", docs.unionByName(odd).unionByName(docs.limit(9))), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        pieces = {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        assert bool(rows) == (name == "odd") and 7000 not in pieces
        for own in pieces.values():  # one row of each text is left, so each id's pieces lie end to end
            own.sort()
            assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_kernels():
    data, offsets = K.flat(__import__("pyarrow").array(["a b", None, "", " c\n", "d"]))
    starts, ends, at = K.words(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"d"] and at.tolist() == [0, 2, 2, 2, 3, 4]
    import zlib

    a, b = b"some bytes", b"and others" * 50
    whole = K.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
    assert int(whole[0]) == zlib.crc32(a + b)
    assert F is not None
