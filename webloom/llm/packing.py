"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into full sequences and then pieces of the binary digits of what is left,
largest first. Every piece is a sequence of its own, of a power-of-two length, so no sequence crosses documents and
nothing is padded. `write` buckets equal lengths: a folder for each length holds rows of so many ids each and nothing
else, from which a reader takes batches of one shape; `read` gives one bucket back, and `sequences` numbers what all buckets hold.

Defined cases: a null or empty text is the end id alone; rows with equal doc_id are documents of their own; a very long
text is encoded by itself, so a task needs memory for its longest text; an empty table gives no rows; other columns,
whatever their names, are ignored. Ids are not shuffled: a piece depends on its document only. Sequence ids are places in the order of
length, doc_id (null first), start and ids' crc32, gapless from 0 whatever files the table is in; pieces that are equal in all of it
are alike in all but that number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.ranks import ranked
from webloom.shared import Scratch, new_path

from ._kernels import STEP_BYTES, batch_rows, flat, released, steps
from .bpe import default_path, encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def text_steps(batch: pa.RecordBatch, names: list[str], limit: int = STEP_BYTES):
    """Slices of a batch with at most `limit` bytes of text each (or one longer text), so that memory is bounded."""
    texts, ids = batch_rows(batch, names[-1]), batch_rows(batch, names[0])
    for i, j in steps(flat(texts)[1], limit):
        yield ids.slice(i, j - i), [x or "" for x in texts.slice(i, j - i).to_pylist()]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each document, and the new offsets."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def cut(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many ids: each piece's document, start in it, and length."""
    bits = longest.bit_length() - 1
    places = np.arange(bits - 1, -1, -1)
    whole = counts // longest
    digits = (counts[:, None] >> places) & 1
    per = whole + digits.sum(axis=1)
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    length = np.full(len(doc), longest, np.int64)
    tail = nth >= whole[doc]
    length[tail] = np.broadcast_to(1 << places, digits.shape)[digits.astype(bool)]
    ends = np.cumsum(length)
    base = np.cumsum(counts) - counts
    return doc, ends - length - base[doc], length


def pack(docs: DataFrame, longest: int = 1024, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (little-endian uint32)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    path = path or default_path()

    def pieces(batches):
        for batch in batches:
            for doc_ids, texts in text_steps(batch, ["doc_id", "text"]):
                ids, offsets = with_end(*encoder(path).encode(texts), end_id)
                counts = np.diff(offsets)
                doc, start, length = cut(counts, longest)
                bounds = np.concatenate([[0], np.cumsum(length)])
                payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds * 4), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(counts[doc]), payload], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(pieces), SCHEMA)


def write(pieces: DataFrame, path: str) -> None:
    """Buckets of equal lengths: a folder `length=n` for each of the few lengths that there are, without a shuffle."""
    pieces.write.partitionBy("length").parquet(path)


def _buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, doc_tokens long, ids binary, length long").parquet(path)


def read(spark: SparkSession, path: str, length: int) -> DataFrame:
    """One bucket: sequences of `length` ids each."""
    return _buckets(spark, path).where(F.col("length") == length)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """What the buckets hold, without the ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(spark)
    held = scratch.write(_buckets(spark, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.monotonically_increasing_id().alias("row")), "pieces")
    placed = ranked(held, [F.col(c) for c in ("length", "doc_id", "start", "ids_crc32", "row")])
    scratch.drop()
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("place") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def bucketed(docs: DataFrame, longest: int = 1024, path: str | None = None, end_id: int = 0) -> DataFrame:
    """The sequences of docs, written to buckets in the shared folder and read back from there."""
    place = new_path(docs.sparkSession, "buckets")
    write(pack(docs, longest, path, end_id), place)
    return sequences(docs.sparkSession, place)
