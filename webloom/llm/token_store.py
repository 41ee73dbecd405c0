"""Token ids in a content-addressed store.

A rolling hash over the last few ids cuts each document's id stream into chunks; a chunk is named by the digest of
its ids and stored once, however many documents hold it. A document is a recipe, the list of its chunks, with the
Merkle root over them. Recipes lie in parts, in ascending doc_id; the manifest has the Merkle root over each part's
recipes in their order, and one root over all parts.

Reading verifies all of it: every chunk against its name, every recipe's chunks against its root, every part's recipes
against the manifest, and the manifest against its own root. So a chunk, recipe, file or row that is lost, repeated,
swapped or altered is an error, never a shorter result.

Files in the store: `parts/kind=1`, the chunks (digest, n_tokens, ids: little-endian integers of 2 bytes if the vocabulary allows it, else 4)
ordered by digest in each file, `recipes` (doc_id, n_tokens, digests, sizes, root, part, local), and `manifest` (part,
first, n_docs, n_tokens, root; part -1 stands for the whole). A document starts at `first` of its part plus `local`.

Texts are encoded once. Ids move once: chunks a task has met before are left out, the rest go by digest to the
partition that stores them, where a sort finds the copies. Nothing else moves but recipes (20 bytes a chunk): global
starts come from sums of range partitions, and a document's crc32 is combined from those of its chunks, each shifted
by the bytes after it. Only one row a part comes to the driver; parts are as many as shuffle partitions.

Defined cases: a null or empty text is the end id alone; documents without doc_id come first, equal doc_ids are
documents of their own, in the order of their roots; repeated rows are spread over parts like any others; a very long
text is encoded by itself, so a task needs memory for its longest text; an empty table makes an empty store; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._kernels import U64, crc_shift, flat, mix, released
from ._spark import Scratch, partitions, shared_dir
from .bpe import default_path, encoder
from .packing import text_steps, with_end

#: Ids the rolling hash sees; one cut per AVERAGE (a power of two) ids; longest chunk.
WINDOW, AVERAGE, LONGEST = 4, 256, 2048
PARTS = "kind int, key long, doc_id long, n_tokens long, digest binary, sizes binary, ids binary, root binary"
RECIPES = "doc_id long, n_tokens long, digests binary, sizes binary, root binary, part int, local long"
MANIFEST = "part int, first long, n_docs long, n_tokens long, root binary"
#: Rows of `parts` that are a recipe and that are a chunk.
_RECIPE, _CHUNK = 0, 1


def name_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: Iterable[bytes]) -> bytes:
    """The root over 16-byte leaves; an odd one moves up as it is. Leaves are folded as they come, so few are held."""
    peaks: list[bytes] = []
    for n, leaf in enumerate(leaves):
        # As many full subtrees end here as the number of leaves before has ones at its low end.
        while n & 1:
            leaf = name_of(b"\1" + peaks.pop() + leaf)
            n >>= 1
        peaks.append(leaf)
    if not peaks:
        return name_of(b"")
    root = peaks.pop()
    while peaks:
        root = name_of(b"\1" + peaks.pop() + root)
    return root


@functools.lru_cache(maxsize=2)
def _values(n: int) -> np.ndarray:
    """The rolling hash's value of every id below n."""
    return mix(np.arange(n, dtype=U64) + U64(0xA0761D6478BD642F))


def cuts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks: where the rolling hash says so, at document ends, and LONGEST after the last."""
    state = np.zeros(len(ids), U64)
    value = _values(1 << int(ids.max(initial=0)).bit_length())[ids]
    for back in range(WINDOW):
        state[back:] += value[: len(value) - back] * U64(pow(0x9E3779B97F4A7C15, back, 2**64))
    ends = np.union1d(np.flatnonzero(mix(state) & U64(AVERAGE - 1) == 0) + 1, offsets[1:])
    ends = ends[ends > 0]
    begins = np.concatenate([[0], ends[:-1]])
    more = (ends - begins - 1) // LONGEST
    if not more.any():
        return ends
    extra = np.repeat(begins, more) + LONGEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.union1d(ends, extra)


def _fixed(raw: bytes, size: int) -> pa.Array:
    """Values of `size` bytes each as a binary column."""
    return _spans(np.frombuffer(raw, np.uint8), np.arange(0, len(raw) + 1, size))


def _spans(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between bounds as a binary column, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _parts(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of rows of one kind; columns that this kind has not are null."""
    kinds = {"kind": pa.int32(), "key": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "digest": pa.binary(), "sizes": pa.binary(), "ids": pa.binary(), "root": pa.binary()}
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


def _encode(path: str, end_id: int):
    def run(batches):
        kind = "<u2" if max(encoder(path).vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        width, task, done, seen = int(kind[-1]), TaskContext.get(), 0, set()
        # Recipes may lie anywhere, so they are dealt by number: repeated rows don't meet in one task.
        salt = mix(np.array([(task.partitionId() if task else 0) + 1], U64))[0]
        for batch in batches:
            for doc_ids, texts in text_steps(batch, ["doc_id", "text"]):
                ids, offsets = with_end(*encoder(path).encode(texts), end_id)
                data = np.ascontiguousarray(ids, kind).view(np.uint8)
                ends = cuts(ids, offsets)
                bounds = np.concatenate([[0], ends])
                raw, at = memoryview(data), (width * bounds).tolist()
                names = [name_of(raw[i:j]) for i, j in zip(at, at[1:])]
                digests, sizes = b"".join(names), np.diff(bounds)
                to = np.searchsorted(ends, offsets, side="right")
                roots = [merkle(names[i:j]) for i, j in zip(to.tolist(), to[1:].tolist())]
                n = len(texts)
                key = mix(np.arange(done, done + n, dtype=U64) ^ salt).view(np.int64)
                done += n
                yield _parts(
                    _RECIPE, n, key=pa.array(key), doc_id=doc_ids, n_tokens=pa.array(np.diff(offsets)), digest=_spans(np.frombuffer(digests, np.uint8), 16 * to),
                    sizes=_spans(sizes.astype("<u4").view(np.uint8), 4 * to), root=pa.array(roots, pa.binary()),
                )
                if len(seen) > 1_000_000:
                    seen.clear()
                new = np.zeros(len(names), bool)
                for i, x in enumerate(names):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                mask = pa.array(new)
                key = np.frombuffer(digests, np.int64)[::2]
                yield _parts(
                    _CHUNK, int(new.sum()), key=pa.array(key[new]), n_tokens=pa.array(sizes[new]), digest=_fixed(digests, 16).filter(mask), ids=_spans(data, width * bounds).filter(mask)
                )

    return run


def _ordered(batches):
    """Recipes of one range partition, in order: the part's number and their running start in it."""
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        local = start + np.cumsum(n) - n
        start += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(local)], names=["doc_id", "n_tokens", "digests", "sizes", "root", "part", "local"])


def _leaf(doc_id: int | None, n_tokens: int, local: int, root: bytes) -> bytes:
    return name_of(b"\0" + root + f"{doc_id}/{n_tokens}/{local}".encode())


def _folded(batches):
    """part, n_docs, n_tokens, root of parts whose recipes come whole and in order."""
    counts: dict[int, list[int]] = {}

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out = []
    for part, own in itertools.groupby(rows(), key=lambda r: r[0]):
        counts[part] = [0, 0]

        def leaves():
            for _, local, doc_id, n_tokens, root in own:  # noqa: B023
                counts[part][0] += 1  # noqa: B023
                counts[part][1] += n_tokens  # noqa: B023
                yield _leaf(doc_id, n_tokens, local, root)

        out.append((part, merkle(leaves())))
    yield pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in out], pa.int32()), pa.array([counts[p][0] for p, _ in out], pa.int64()), pa.array([counts[p][1] for p, _ in out], pa.int64()), pa.array([r for _, r in out], pa.binary())],
        names=["part", "n_docs", "n_tokens", "root"],
    )


def _manifest(recipes: DataFrame) -> list[tuple]:
    """The rows of the manifest, from the recipes as they are: one a part, and one for the whole."""
    narrow = recipes.select("part", "local", "doc_id", "n_tokens", "root")
    dealt = narrow.repartition(partitions(recipes.sparkSession), "part").sortWithinPartitions("part", "local", "doc_id", "root")
    found = sorted(tuple(r) for r in dealt.mapInArrow(_folded, "part int, n_docs long, n_tokens long, root binary").collect())
    rows, first = [], 0
    for part, n_docs, n_tokens, root in found:
        rows.append((part, first, n_docs, n_tokens, bytes(root)))
        first += n_tokens
    return [(-1, 0, sum(r[2] for r in rows), first, merkle(_leaf(p, n, at, root) for p, at, _, n, root in rows)), *rows]


def write(docs: DataFrame, store: str | None = None, path: str | None = None, end_id: int = 0) -> str:
    """Encodes docs (doc_id, text) into a store and returns its folder."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    store = store or f"{shared_dir(spark).rstrip('/')}/webloom-store-{uuid.uuid4().hex}"
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(_encode(path or default_path(), end_id)), PARTS)
    # The sort that finds copies of chunks is the order of the files, too.
    copy = F.row_number().over(Window.partitionBy("kind", "key", "digest").orderBy("n_tokens"))
    once = rows.repartition(n, "key").withColumn("copy", copy).where(f"copy = 1 or kind = {_RECIPE}")
    once.drop("copy").write.partitionBy("kind").option("compression", "zstd").parquet(f"{store}/parts")

    made = spark.read.schema("key long, doc_id long, n_tokens long, digest binary, sizes binary, root binary").parquet(f"{store}/parts/kind={_RECIPE}") if _has(spark, f"{store}/parts/kind={_RECIPE}") else spark.createDataFrame([], PARTS)
    # The key is in the order last, so that repeated rows are many ranges.
    ranged = made.repartitionByRange(n, "doc_id", "root", "key").sortWithinPartitions("doc_id", "root", "key")
    ranged = ranged.select("doc_id", "n_tokens", F.col("digest").alias("digests"), "sizes", "root").mapInArrow(_ordered, RECIPES)
    ranged.write.option("compression", "zstd").parquet(f"{store}/recipes")
    scratch.paths.append(f"{store}/parts/kind={_RECIPE}")
    scratch.drop()
    rows = _manifest(spark.read.schema(RECIPES).parquet(f"{store}/recipes"))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{store}/manifest")
    return store


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _chunks(spark: SparkSession, store: str) -> DataFrame:
    path, schema = f"{store}/parts/kind={_CHUNK}", "digest binary, n_tokens long, ids binary"
    return spark.read.schema(schema).parquet(path) if _has(spark, path) else spark.createDataFrame([], schema)


def _verified(raw: pa.Array, names: pa.Array, counts: pa.Array):
    """Bytes and bounds of a batch of chunks in ids of 4 bytes, once each is what its name says."""
    data, bounds = flat(raw)
    view, at = memoryview(data), bounds.tolist()
    for name, i, j in zip(names.to_pylist(), at, at[1:]):
        if name_of(view[i:j]) != name:
            raise ValueError(f"chunk {name.hex()} is damaged")
    n = counts.to_numpy()
    width = np.diff(bounds) // np.maximum(n, 1)
    if len(n) and not ((width == width[0]) & (np.diff(bounds) == n * width[0]) & np.isin(width, (2, 4))).all():
        raise ValueError("a chunk has another length")
    ids = np.ascontiguousarray(data).view("<u2" if len(n) and width[0] == 2 else "<u4").astype("<u4")
    return ids.view(np.uint8), 4 * np.concatenate([[0], np.cumsum(n)])


def read_chunks(spark: SparkSession, store: str) -> DataFrame:
    """name, n, crc (crc32 of the ids) of every stored chunk; a chunk that is not what its name says is an error."""

    def checked(batches):
        for batch in batches:
            data, bounds = _verified(batch.column(2), batch.column(0), batch.column(1))
            view, at = memoryview(data), bounds.tolist()
            crcs = np.fromiter((zlib.crc32(view[i:j]) for i, j in zip(at, at[1:])), np.int64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs)], names=["name", "n", "crc"])

    return _chunks(spark, store).select("digest", "n_tokens", "ids").mapInArrow(checked, "name binary, n long, crc long")


def _recipes(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, digests, sizes, root of all recipes, once they are those that the manifest has."""
    recipes = spark.read.schema(RECIPES).parquet(f"{store}/recipes")
    manifest = spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    told = sorted((r.part, r.first, r.n_docs, r.n_tokens, bytes(r.root)) for r in manifest.collect())
    if told != _manifest(recipes):
        raise ValueError("the recipes are not those of the manifest")
    # One row a part: as many as the partitions that wrote the store.
    begins = F.broadcast(manifest.select(F.col("part").alias("p"), "first"))
    return recipes.join(begins, F.col("part") == F.col("p")).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "digests", "sizes", "root")


def _uses(batches):
    """Each recipe's chunks with the ids that come after them, once its root is checked."""
    for batch in batches:
        (names, bounds), (sizes, size_bounds) = flat(batch.column(3)), flat(batch.column(4))
        raw, at = memoryview(names), bounds.tolist()
        for i, j, root, start in zip(at, at[1:], batch.column(5).to_pylist(), batch.column(1).to_pylist()):
            if merkle(bytes(raw[k : k + 16]) for k in range(i, j, 16)) != root:
                raise ValueError(f"the recipe of the document at {start} is damaged")
        counts, total = np.diff(bounds) // 16, batch.column(2).to_numpy()
        size = np.ascontiguousarray(sizes).view("<u4").astype(np.int64)
        if not np.array_equal(size_bounds // 4, bounds // 16) or not np.array_equal(np.add.reduceat(size, bounds[:-1] // 16) if len(size) else counts, total):
            raise ValueError("a recipe has another length")
        doc = np.repeat(np.arange(len(counts)), counts)
        after = np.cumsum(total)[doc] - np.cumsum(size)
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), _fixed(names.tobytes(), 16), pa.array(after)], names=["doc_id", "start", "n_tokens", "name", "after"])


def _shifted(batches):
    for batch in batches:
        crc = crc_shift(batch.column(3).to_numpy().astype(np.uint32), 4 * batch.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc.astype(np.int64)), batch.column(5)], names=["doc_id", "start", "n_tokens", "crc", "n"])


USES = "doc_id long, start long, n_tokens long, name binary, after long"


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32; whatever is not as it was written is an error."""
    uses = _recipes(spark, store).mapInArrow(_uses, USES)
    held = uses.join(read_chunks(spark, store).withColumnRenamed("name", "held"), F.col("name") == F.col("held"), "left")
    held = held.select("doc_id", "start", "n_tokens", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "after", "n")
    parts = held.mapInArrow(_shifted, "doc_id long, start long, n_tokens long, crc long, n long")
    # Every document has a start of its own, as each has the end id.
    whole = parts.groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"))
    checked = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document has another length")).cast("long"))
    return whole.select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document, rebuilt from its chunks."""

    def whole_chunks(batches):
        for batch in batches:
            data, bounds = _verified(batch.column(2), batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _spans(data, bounds)], names=["held", "ids"])

    uses = _recipes(spark, store).mapInArrow(_uses, USES)
    chunks = _chunks(spark, store).select("digest", "n_tokens", "ids").mapInArrow(whole_chunks, "held binary, ids binary")
    held = uses.join(chunks, F.col("name") == F.col("held"), "left")
    piece = F.struct((-F.col("after")).alias("at"), F.coalesce("ids", F.raise_error(F.lit("a chunk is missing")).cast("binary")).alias("ids"))
    whole = held.groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("parts"))

    def joined(batches):
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column(3).to_pylist()]
            if any(len(x) != 4 * n for x, n in zip(ids, batch.column(2).to_pylist())):
                raise ValueError("a document has another length")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return whole.select("doc_id", "start", "n_tokens", "parts").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids binary")
