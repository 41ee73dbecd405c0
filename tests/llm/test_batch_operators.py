"""Chat formatting, sharding, quality, token store and packing against brute force, with odd tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import bpe, chat_format, packing, quality, queries, sharding, token_store

ODD = [
    (1, "the cat sat on the mat\nthe cat sat on the mat\n\n x", 7),
    (2, None, 7),
    (3, "", 7),
    (4, "   \n\t ", 7),
    (5, "ab " * 30000 + "x" * 70000, 7),
    (6, "the cat sat on the mat\nthe cat sat on the mat\n\n x", 7),
    (6, "the cat sat on the mat\nthe cat sat on the mat\n\n x", 7),
    (None, "größe é漢字 it's we'll 12 +-* ok", 7),
    (None, None, 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, shard int")


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def library_ids(texts):
    tokenizer = bpe.Encoder(bpe.default_path()).tokenizer
    return [x.ids + [0] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" ab'\"strevlmd\n\t1é漢!_\x85　", max_size=30), max_size=6))
def test_pieces_equal_the_library(texts):
    ids, offsets = bpe.encoder(bpe.default_path()).encode(texts)
    want = [x.ids for x in bpe.encoder(bpe.default_path()).tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>", "\\", "<", "[", "\\/s>", " a", ""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<|text|>"]), st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat_format.format_turns(turns)
    assert chat_format.parse(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_escapes_only_conflicts():
    assert chat_format.format_turns([("user", "plain"), ("assistant", "a < b")])[0] == "[INST]plain[/INST]<s>a < b</s>"
    assert "<\\/s>[\\INST] ok [\\/INST]" in chat_format.format_turns([("user", queries.HOSTILE)])[0]


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", "q", 0), (1, 0, "user", "q", 0), (2, None, None, "x", 0), (None, 0, "user", "a", 0), (None, 0, "user", "a", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = sorted((str(r.conv_id), r.n_turns, r.loss_chars, r.turns_sha256) for r in chat_format.digest(chat_format.format_conversations(df)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([("1", 3, 0, sha("user\nq\nuser\nq\nassistant\n\n")), ("2", 1, 0, sha("\nx\n")), ("None", 1, 0, sha("user\na\n")), ("None", 1, 0, sha("user\na\n"))])
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, sf, odd):
    rows = queries.op3_jump_shards(spark, sf).collect()
    texts = dict(texts_of(spark, sf))
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        key = int(sharding.stable_key(np.array([r.doc_id]))[0])
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "key", jump_one(key, 16), jump_one(key, 17))
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    got = sharding.assign(odd, "doc_id", order=("text",), shards=3).collect()
    assert len(got) == len(ODD)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign(odd.limit(0), "doc_id").count() == 0


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def in_bands(text, z):
    """The verdict of the bands by hand: the class of the whole text's length, and chunks of 2 KiB of which the last one ends with the text."""
    raw = (text or "").encode()
    limits = [(low, high) for least, low, high in quality.BANDS if len(raw) >= least][-1:]
    if not limits:
        return True
    (low, high), chunks = limits[0], []
    if not low <= len(z.compress(raw)) / len(raw) <= high:
        return False
    at = 0
    while len(raw) >= 2048 and at + 2048 < len(raw):
        chunks.append(raw[at : at + 2048])
        at += 2048
    if len(raw) >= 2048:
        chunks.append(raw[-2048:])
    out = [c for c in chunks if not 0.27 <= len(z.compress(c)) / 2048 <= 0.57]
    return len(out) * 10 <= len(chunks)


def test_quality(spark, sf, odd):
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want, z = Counter(), zstandard.ZstdCompressor(level=3)
    for (i, t), n in texts.items():
        base = base_counts(t)
        want[(i, *base, not base[5] and in_bands(t, z))] += n
    got = Counter(tuple(r) for r in quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == want
    kept = quality.keep(docs)
    assert kept.schema == docs.schema and kept.count() == sum(n for k, n in want.items() if k[-1])
    assert quality.judge(odd.limit(0)).count() == 0


def test_bands_reject_both_ends():
    import base64
    import random

    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    judge = lambda t: quality.compression(memoryview(t.encode()), z)[3]
    assert not judge("all work and no play makes a dull page. " * 40)
    assert not judge(base64.b64encode(random.Random(1).randbytes(6000)).decode())
    assert judge("short")


def test_packing(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = packing.bucketed(docs).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 for r in rows)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for (i, _), ids in zip(pairs, library_ids([t for _, t in pairs])):
        at = 0
        for size in [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if len(ids) % 1024 >> b & 1]:
            want[(i, at, size, crc(ids[at : at + size]), len(ids))] += 1
            at += size
        assert at == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert packing.pack(odd.limit(0)).count() == 0 and packing.bucketed(odd.limit(0)).count() == 0


def test_sequences_do_not_depend_on_files(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).cache()
    found = [Counter(map(tuple, packing.bucketed(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_store(spark, sf, odd, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    ids = library_ids([t for _, t in pairs])
    store = token_store.write(docs, str(tmp_path / "store"))
    got = sorted((r.start, r.n_tokens, r.ids_crc32, str(r.doc_id)) for r in token_store.read_digests(spark, store).collect())
    assert Counter(x[1:] for x in got) == Counter((len(x), crc(x), str(i)) for (i, _), x in zip(pairs, ids))
    at = 0
    for start, n, _, _ in got:
        assert start == at
        at += n
    order = [int(x[3]) for x in got if x[3] != "None"]
    assert order == sorted(order) and [x[3] for x in got[:2]] == ["None", "None"]
    rebuilt = Counter((str(r.doc_id), bytes(r.ids)) for r in token_store.read_ids(spark, store).collect())
    assert rebuilt == Counter((str(i), np.array(x, "<u4").tobytes()) for (i, _), x in zip(pairs, ids))
    names = [r.name for r in token_store.read_chunks(spark, store).collect()]
    assert len(names) == len(set(names))
    empty = token_store.write(docs.limit(0), str(tmp_path / "empty"))
    assert token_store.read_digests(spark, empty).count() == 0


def rewrite(folder, change):
    """Replaces the rows of a table by change(rows), in one file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    files = sorted(x for x in os.listdir(folder) if x.endswith(".parquet"))
    table = pa.concat_tables([pq.read_table(os.path.join(folder, x), partitioning=None) for x in files])
    for x in os.listdir(folder):
        os.remove(os.path.join(folder, x))
    pq.write_table(pa.Table.from_pylist(change(table.to_pylist()), table.schema), os.path.join(folder, "part-0.parquet"))


def swapped(rows):
    """Two recipes of unlike documents in each other's place, each with its own root."""
    a, b = next((a, b) for a in range(len(rows)) for b in range(a) if rows[a]["n_tokens"] == rows[b]["n_tokens"] and rows[a]["root"] != rows[b]["root"])
    for k in ("digests", "sizes", "root"):
        rows[a][k], rows[b][k] = rows[b][k], rows[a][k]
    return rows


@pytest.mark.parametrize(
    "folder, change",
    [
        ("recipes", lambda rows: rows[:7] + rows[8:]),
        ("recipes", lambda rows: rows[: len(rows) // 3]),
        ("recipes", lambda rows: rows + rows[3:4]),
        ("recipes", swapped),
        ("recipes", lambda rows: [rows[0] | {"doc_id": -5}, *rows[1:]]),
        ("recipes", lambda rows: [r | {"digests": r["digests"][16:] + r["digests"][:16]} for r in rows]),
        ("parts/kind=1", lambda rows: rows[1:]),
        ("parts/kind=1", lambda rows: rows + rows[:1]),
        ("parts/kind=1", lambda rows: [rows[0] | {"ids": rows[0]["ids"][:-2] + b"zz"}, *rows[1:]]),
        ("manifest", lambda rows: rows[:-1]),
        ("manifest", lambda rows: [r | {"first": r["first"] + (r["part"] > 0)} for r in rows]),
        ("manifest", lambda rows: [r | {"root": bytes(16)} if r["part"] == 1 else r for r in rows]),
        ("manifest", lambda rows: []),
    ],
)
def test_store_reads_nothing_that_was_changed(spark, sf, tmp_path, folder, change):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    store = token_store.write(docs, str(tmp_path / "store"))
    rewrite(os.path.join(store, folder), change)
    for read in (token_store.read_digests, token_store.read_ids):
        with pytest.raises(Exception, match="chunk|recipe|document|manifest"):
            read(spark, store).collect()


def test_merkle_folds_as_the_whole_tree():
    def whole(leaves):
        while len(leaves) > 1:
            leaves = [token_store.name_of(b"\1" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    for n in range(1, 70):
        leaves = [token_store.name_of(str(k).encode()) for k in range(n)]
        assert token_store.merkle(leaves) == whole(leaves)


SHORT = (
    "We left the house at six, as it was still dark, and put the old boat on the back of his truck. My aunt had made tea for us all, but no one drank any of it. A dog ran up and down by the gate; it may have known how far we had to go that day, and that she would not come with us.",
    "To fit a new lamp, first cut off the power and wait. Undo both screws, pull the glass down and lift out the bulb. Do not touch its pins. Push the new one in until you hear a click, then fix the glass so that the mark is at the top. If it does not light up, take it out and try once more.",
    "Fees are due on the first of May. You can pay by card, by cheque or in cash at any of our desks; ask Joan if you want a form. Who pays late will owe us five per cent a month. We do not send bills by post, so keep this page. For a quick reply, write to us at the box below, or just ring up Zoe at noon.",
)


def test_short_prose_is_kept_and_short_noise_is_not(spark):
    import random
    import string

    rng = random.Random(20)
    noise = [" ".join("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for _ in range(55)) for n in (4, 5, 6, 8)]
    rows = quality.judge(spark.createDataFrame(list(enumerate([*SHORT, *noise])), "doc_id long, text string")).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in rows)
    assert [r.kept for r in rows] == [True] * len(SHORT) + [False] * len(noise)


def test_noise_and_half_noise_are_dropped(spark, sf):
    import random
    import string

    rng = random.Random(8)

    def noise(size, letters=string.ascii_letters + string.digits):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(size // 7 + 9))[:size]

    prose = max((t for _, t in texts_of(spark, sf) if t and t.isascii() and quality.compression(memoryview(t.encode()), __import__("zstandard").ZstdCompressor(level=3))[3]), key=len)
    texts = [noise(600), noise(1100), noise(1600), noise(5000), noise(1600, string.ascii_lowercase), noise(5000, "0123456789abcdef"), prose + noise(len(prose) // 3), prose]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(prose) > 3 * quality.CHUNK
    assert [r.kept for r in quality.judge(df).orderBy("doc_id").collect()] == [False] * 7 + [True]


def test_bands_reject_what_the_base_rules_let_through(spark):
    """Repetition without repeated windows and noise in words, each beside clean prose of the same length."""
    import random

    rng = random.Random(12)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(6, 12))) for _ in range(14)]
    few = [" ".join(rng.choice(words) for _ in range(n)) for n in (160, 220, 260)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(8)) for _ in range(n)) for n in (60, 200, 2000)]
    df = spark.createDataFrame(list(enumerate([*few, *noise])), "doc_id long, text string")
    rows = quality.judge(df).collect()
    assert not any(r.base_failed for r in rows) and not any(r.kept for r in rows)


@pytest.mark.parametrize("shards", [1, 32, 1000])
def test_any_number_of_shards(spark, sf, shards):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit(3).alias("key"), F.lit("x").alias("bin"))
    rows = sharding.assign(df, "doc_id", shards=shards).collect()
    slots = {}
    for r in rows:
        assert r.shard == jump_one(int(sharding.stable_key(np.array([r.doc_id]))[0]), shards) and r.grown_shard in (r.shard, shards) and (r.key, r.bin) == (3, "x")
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == df.count() and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_counts_too_many_to_broadcast(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    want = Counter((r.doc_id, r.shard) for r in sharding.assign(df, shards=16).collect())
    monkeypatch.setattr(sharding, "MAX_COUNTS", 4)
    rows = sharding.assign(df, shards=16).collect()
    assert Counter((r.doc_id, r.shard) for r in rows) == want and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_crowded_bins_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_BIN", 100)
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("size"))
    rows = sharding.assign(df, order=("size",), shards=4, bins=8).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 6000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1


def test_rows_without_key_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_BIN", 100)
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 11).alias("size"))
    rows = sharding.assign(df, order=("size",), shards=8, bins=4).collect()
    assert len({(r.shard, r.grown_shard) for r in rows if r.doc_id is None}) == 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 2000 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_buckets_of_equal_lengths(spark, sf, tmp_path):
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"))
    packing.write(pieces, str(tmp_path / "packed"))
    want = Counter(r.length for r in pieces.select("length").collect())
    for length, n in want.items():
        rows = packing.read(spark, str(tmp_path / "packed"), length).collect()
        assert len(rows) == n and all(len(r.ids) == 4 * length for r in rows)


def test_new_pieces_are_encoded_together(monkeypatch):
    texts = ["thonthea éaiieraux 12½ 日本 'll \x00\xff~\n\n\t x" * 3, "ezcoas oforatou tioued" * 40, "", "<s></s>"]
    e = bpe.Encoder(bpe.default_path())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def found():
        e.forget()
        ids, offsets = e.encode(texts)
        return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]

    singly, calls = e.learn_singly, []
    monkeypatch.setattr(e, "learn_singly", lambda pieces: calls.append(len(pieces)) or singly(pieces))
    assert found() == want and not calls
    e.letters_of[:] += 1  # a vocabulary that names letters in another way
    assert found() == want and calls
