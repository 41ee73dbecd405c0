"""Quality rules: base counts of words, symbols and repetition, and zstandard compression bands.

A text is kept if the base rules hold and its compression is in the band of its length: zstandard's ratio (bytes
after over bytes before, level 3) of the whole text lies between the limits of its length class - repetitive text
falls below, random text above - and the same is true of its chunks of CHUNK bytes, from one chunk on, but for
OUT_PERCENT of them. The last chunk ends with the text, so that every byte is in one. Texts too short
for a ratio to mean anything have the base rules only. Upper limits lie between prose of 50 words or more - the generated
texts, and English prose of manuals and licences, of which at most 0.2 % of any class is above - and random words of 62
letters and digits, which are above in every class; of 26 letters they are from 1.5 KB on, and of 16 from 4 KB on (shorter
ones compress as prose does).

Every text is measured whole, a very long one by itself; there is no shuffle and memory is bounded by the longest text.

Defined cases: a null or empty text has counts of 0 and fails the base rules; rows are judged each by itself, so ties
and repeated rows need no rule; an empty table gives no rows; other columns, whatever their names, are passed by `keep`
and ignored by `judge`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K

#: From so many bytes on, the least and the largest ratio of a whole text.
BANDS = (
    (256, 0.38, 0.83), (352, 0.38, 0.81), (384, 0.38, 0.795), (448, 0.38, 0.78), (512, 0.33, 0.75), (768, 0.33, 0.71), (1024, 0.30, 0.65), (1536, 0.30, 0.59),
    (2048, 0.27, 0.57), (3072, 0.27, 0.54), (4096, 0.25, 0.525), (8192, 0.25, 0.485), (16384, 0.22, 0.46),
)
#: Bytes of a chunk, the band of its ratio, and how many of a hundred may lie outside.
CHUNK, CHUNK_BAND, OUT_PERCENT = 2048, (0.27, 0.57), 10
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, n_chunks long, n_chunks_out long, kept boolean"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, the words in windows of `window` words that are found twice or more in it."""
    value = K.span_hashes(data, starts, ends)
    hashes = K.window_hashes(value, window)
    if not len(hashes):
        return np.zeros(len(offsets) - 1, np.int64)
    fits = K.window_fits(word_offsets, window)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))[: len(hashes)]
    at = np.flatnonzero(fits)
    key = K.mix(hashes[at] + doc[at].astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ordered = key[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    marked = np.zeros(len(hashes), bool)
    marked[at[order[twice]]] = True
    return _sums(K.covered(marked, window, len(value)), word_offsets)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    # A line begins after each break and at each document's start; it ends at a break or a document's end.
    begin = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.append(begin[1:] - 1, len(data))
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = offsets[1:][doc[last]]
    some = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[some], end[some], doc[some]
    if not len(begin):
        return np.zeros(n_docs, np.int64)
    key = K.mix(K.span_hashes(data, begin, end) + doc.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[first], minlength=n_docs)


def band(n_bytes: int) -> tuple[float, float] | None:
    found = None
    for least, low, high in BANDS:
        if n_bytes >= least:
            found = (low, high)
    return found


def compression(text: memoryview, compressor) -> tuple[float | None, int, int, bool]:
    """The whole ratio, chunks measured, chunks out of band, and whether the text is in its bands."""
    n = len(text)
    limits = band(n)
    if limits is None:
        return None, 0, 0, True
    ratio = len(compressor.compress(text)) / n
    chunks = out = 0
    if n >= CHUNK:
        for i in [*range(0, n - CHUNK, CHUNK), n - CHUNK]:
            chunks += 1
            out += not CHUNK_BAND[0] <= len(compressor.compress(text[i : i + CHUNK])) / CHUNK <= CHUNK_BAND[1]
    return ratio, chunks, out, limits[0] <= ratio <= limits[1] and 100 * out <= OUT_PERCENT * chunks


def _measure(batches):
    compressor = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data_all, offsets_all = K.flat(batch.column(1))
        for i, j in K.steps(offsets_all):
            offsets = offsets_all[i : j + 1]
            data = data_all[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            starts, ends, word_offsets = K.words(data, offsets)
            n_words = np.diff(word_offsets)
            chars = _sums(((data & 0xC0) != 0x80) & ~K.SEPARATOR[data], offsets)
            symbols = _sums(_SYMBOL[data], offsets)
            lines = duplicate_lines(data, offsets, starts, word_offsets)
            repeats = repeated_words(data, offsets, starts, ends, word_offsets)
            failed = (n_words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
            view = memoryview(data)
            found = [compression(view[a:b], compressor) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            kept = ~failed & np.array([f[3] for f in found], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, lines, repeats)), pa.array(failed), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "whole_ratio", "n_chunks", "n_chunks_out", "kept"],
            )


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: counts, ratios and verdict."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.released(_measure), SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns as they are."""

    def chosen(batches):
        for batch in batches:
            texts = K.batch_rows(batch, "text")
            ids = pa.array(np.arange(len(batch)))
            verdict = [x for part in _measure([pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])]) for x in part.column(10).to_pylist()]
            yield batch.filter(pa.array(verdict, pa.bool_()))

    return docs.mapInArrow(K.released(chosen), docs.schema)
