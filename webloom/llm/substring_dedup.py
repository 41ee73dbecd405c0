"""Substring deduplication by level-wise doubling.

Finds every window of `window` words whose word sequence also starts anywhere else, in the same document or another,
and removes the words that such windows cover. A window that repeats has sub-windows that repeat, so levels go from
about nine words by doubling up to the full length (9, 18, 35; shorter ones repeat by chance almost anywhere): only windows whose sub-window repeated at one length
are extended to the next, and a group of texts is done as soon as none of its windows survives.

On each level but the last one sub-window stands for each window: the one with the least hash in it (the leftmost, if
equal). Equal windows choose the same one, so a window whose representative does not repeat cannot repeat, and only
one in ten to fourteen positions is counted. The last level hashes the windows that are still candidates, with 128 bits.

Documents are dealt to groups by a hash of id and text; groups are as many as keep one near GROUP_BYTES of input, and
there are four buckets of hashes for so many bytes, however many partitions there are. A group sends each bucket of hashes one message with the distinct hashes it holds and whether it holds them more than
once; the bucket answers each group with the hashes that repeat over all groups. So a passage that stands in every
document costs one entry per group and not one per copy, hashes alone travel, and texts move once, to their group
(the exchange is shared by all levels). Of rows equal in id and text that are there over COPIES times one is sent for the others, so
that a third of all rows being alike is no third of a group's.

Defined cases: words are runs of other than U+0020 and U+0009 to U+000D; a null or empty text has none, and loses
none; all copies of a repeated window go, the first as well; rows that repeat are documents of their own, so both lose
what they share; rows of equal doc_id are kept apart; a very long text is read whole, in steps of STEP_WORDS words; an
empty table gives no rows; other columns, whatever their names, are passed by `remove` and ignored by `judge`.
"""

from __future__ import annotations

import hashlib
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import check_of, input_bytes, key_of, partitions, written

U64 = K.U64
#: Words hashed at a time, and the bits of a position in such a step.
STEP_WORDS, PLACE_BITS = 1 << 18, 24
#: Levels at most, and bytes of input that a group of texts is meant to have.
LEVELS, GROUP_BYTES = 3, 1 << 26
#: Rows equal in id and text that one group may get.
COPIES = 64
SIEVE = U64((1 << 22) - 1)
MESSAGE = "grp int, bucket int, one binary, many binary"
ANSWER = "grp int, hashes binary"
#: A hash on the last level; the second half tells apart what the first does not.
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def lengths(window: int, levels: int = LEVELS) -> list[int]:
    """Window lengths from level to level, each about twice the one before."""
    out = [window]
    while len(out) < levels and out[0] > 4:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Texts:
    """The words of a group's texts, in steps of bounded size."""

    def __init__(self, column):
        self.data, self.offsets = K.flat(column)

    def __iter__(self):
        """Document range, word starts and ends in bytes of the step's data, word offsets and the data."""
        for i, j in K.steps(self.offsets):
            offsets = self.offsets[i : j + 1]
            data = self.data[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            starts, ends, word_offsets = K.words(data, offsets)
            yield i, j, data, starts, ends, word_offsets


def _least(hashes: np.ndarray, fits: np.ndarray, span: int) -> np.ndarray:
    """For each window: where the least of its `span` sub-window hashes is."""
    n = len(fits)
    key = (hashes >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(hashes), dtype=U64)
    width = 1
    while width * 2 <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (key[:n] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)


class Level:
    """Which windows are candidates, from the hashes that repeated on the levels before."""

    def __init__(self, sizes: list[int], answers: list[np.ndarray]):
        self.sizes, self.answers = sizes, answers
        self.sieves = []
        for known in answers:
            first = known["a"] if known.dtype == PAIR else known
            sieve = np.zeros(1 << 22, bool)
            sieve[(first & SIEVE).astype(np.int64)] = True
            self.sieves.append(sieve)

    def _repeats(self, level: int, first: np.ndarray, second) -> np.ndarray:
        """Which hashes are among the answers of a level; second gives the other halves where needed."""
        known = self.answers[level]
        out = np.zeros(len(first), bool)
        at = np.flatnonzero(self.sieves[level][(first & SIEVE).astype(np.int64)])
        if not len(at) or not len(known):
            return out
        pair = known.dtype == PAIR
        names = known["a"] if pair else known
        other = second(at) if pair else None
        where = np.searchsorted(names, first[at])
        for more in (0, 1):  # two equal first halves stand side by side; three do not happen
            place = np.minimum(where + more, len(names) - 1)
            hit = names[place] == first[at]
            if pair:
                hit &= known["b"][place] == other
            out[at[hit]] = True
            if not pair:
                break
        return out

    def candidates(self, value: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the full length that fit and are still candidates, and each one's place on the next level."""
        full = self.sizes[-1]
        fits = K.window_fits(word_offsets, full)
        first = self.sizes[0]
        if not fits.any() or first == full:
            return fits, np.arange(len(fits))
        place = np.zeros(0, np.int64)
        for level, size in enumerate(self.sizes[:-1]):
            if not fits.any():
                break
            if level < len(self.answers):
                hashes = K.window_hashes(value, size)
                fits = fits & self._repeats(level, hashes[_least(hashes, fits, full - size + 1)], None)
            else:
                place = _least(K.window_hashes(value, size), fits, full - size + 1)
                break
        return fits, place

    def entries(self, value, other, word_offsets) -> np.ndarray:
        """Hashes to be counted on the next level, one for each place."""
        level = len(self.answers)
        fits, place = self.candidates(value, word_offsets)
        at = np.flatnonzero(fits)
        last = level == len(self.sizes) - 1
        if not len(at):
            return np.zeros(0, PAIR if last else U64)
        if last:
            out = np.empty(len(at), PAIR)
            out["a"] = K.window_hashes(value, self.sizes[-1])[at]
            out["b"] = K.window_hashes(other, self.sizes[-1], 1)[at]
            return out
        return K.window_hashes(value, self.sizes[level])[np.unique(place[at])]

    def repeated(self, value, other, word_offsets) -> np.ndarray:
        """For each window of the full length: whether it repeats; all levels have been answered."""
        fits, _ = self.candidates(value, word_offsets)
        at = np.flatnonzero(fits)
        out = np.zeros(len(fits), bool)
        if len(at):
            first = K.window_hashes(value, self.sizes[-1])[at]
            second = lambda some: K.window_hashes(other, self.sizes[-1], 1)[at[some]]
            out[at] = self._repeats(len(self.sizes) - 1, first, second)
        return out


def _order(hashes: np.ndarray) -> np.ndarray:
    return np.lexsort((hashes["b"], hashes["a"])) if hashes.dtype == PAIR else np.argsort(hashes)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal hashes begin."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _pieces(value: np.ndarray, word_offsets: np.ndarray, full: int):
    """A long step in overlapping ranges of words, so that every window is in exactly one of them."""
    n = int(word_offsets[-1])
    for a in range(0, max(n - full + 1, 1), STEP_WORDS):
        b = min(a + STEP_WORDS + full - 1, n)
        yield a, b, np.clip(word_offsets, a, b) - a


def _messages(group: int, entries: list[np.ndarray], kind, buckets: int) -> pa.RecordBatch:
    every = np.concatenate(entries) if entries else np.zeros(0, kind)
    every = every[_order(every)]
    begin = _runs(every) if len(every) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(every))) > 1
    every = every[begin]
    # Representatives are least hashes, so their high bits are no measure of where they belong.
    first = K.mix(every["a"] if kind == PAIR else every)
    bucket = ((first >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    every, many, bucket = every[order], many[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [[], [], [], []]
    for k in np.flatnonzero(np.diff(cut)).tolist():
        part, flag = every[cut[k] : cut[k + 1]], many[cut[k] : cut[k + 1]]
        for column, v in zip(rows, (group, k, part[~flag].tobytes(), part[flag].tobytes())):
            column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["grp", "bucket", "one", "many"])


def _answers(kind):
    def run(messages):
        """One bucket: which hashes repeat, told to every group that holds them."""
        groups, weights, hashes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, kind)]
        for grp, one, many in zip(*(messages.column(c).to_pylist() for c in ("grp", "one", "many"))):
            for raw, weight in ((one, 1), (many, 2)):
                part = np.frombuffer(raw, kind)
                if len(part):
                    hashes.append(part)
                    groups.append(np.full(len(part), grp, np.int32))
                    weights.append(np.full(len(part), weight, np.int32))
        hashes, groups, weights = map(np.concatenate, (hashes, groups, weights))
        order = _order(hashes)
        hashes, groups, weights = hashes[order], groups[order], weights[order]
        begin = _runs(hashes) if len(hashes) else np.zeros(0, np.int64)
        total = np.add.reduceat(weights, begin) if len(hashes) else weights
        keep = np.repeat(total > 1, np.diff(np.append(begin, len(hashes))))
        hashes, groups = hashes[keep], groups[keep]
        order = np.argsort(groups, kind="stable")
        hashes, groups = hashes[order], groups[order]
        begin = _runs(groups) if len(groups) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(groups))
        return pa.table({"grp": pa.array(groups[begin], pa.int32()), "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist())], pa.binary())})

    return run


def _known(table, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table.column("hashes").to_pylist()]
    every = np.concatenate(parts) if parts else np.zeros(0, kind)
    return every[_order(every)]


def _kinds(sizes: list[int]) -> list:
    return [U64] * (len(sizes) - 1) + [PAIR]


def _levels(docs: DataFrame, sizes: list[int], buckets: int) -> DataFrame:
    """docs has a column `grp` and a text `_wl_text`; returns the answers of all levels: grp, level, hashes."""
    kinds = _kinds(sizes)

    def counter(level: int):
        kind = kinds[level]

        def both(texts, known):
            if texts.num_rows == 0:
                return pa.Table.from_batches([_messages(0, [], kind, buckets)])
            state = Level(sizes, [_known(known.filter(pc.equal(known.column("level"), at)), kinds[at]) for at in range(level)])
            out, live = [], level == 0 or len(state.answers[-1])
            for _, _, data, starts, ends, word_offsets in Texts(texts.column("_wl_text")) if live else ():
                value, other = K.span_hashes(data, starts, ends), K.span_hashes(data, starts, ends, 1) if kind == PAIR else None
                for a, b, inner in _pieces(value, word_offsets, sizes[-1]):
                    found = state.entries(value[a:b], None if other is None else other[a:b], inner)
                    if len(found):
                        out.append(found)
            return pa.Table.from_batches([_messages(int(texts.column("grp")[0].as_py()), out, kind, buckets)])

        return both if level else lambda texts: both(texts, None)

    answers, groups = None, docs.groupBy("grp")
    for level, kind in enumerate(kinds):
        sent = groups.applyInArrow(_one_group(counter(0)), MESSAGE) if answers is None else groups.cogroup(answers.groupBy("grp")).applyInArrow(_one_group(counter(level)), MESSAGE)
        told = sent.groupBy("bucket").applyInArrow(_one_group(_answers(kind)), ANSWER).select("grp", F.lit(level).alias("level"), "hashes")
        answers = told if answers is None else answers.unionByName(told)
    return answers


def _cut(texts, known, sizes: list[int]):
    """Per text: words, removed words, kept runs of words as byte ranges of its text, digest of the kept words."""
    kinds = _kinds(sizes)
    state = Level(sizes, [_known(known.filter(pc.equal(known.column("level"), at)), kind) for at, kind in enumerate(kinds)])
    some = any(len(x) for x in state.answers[-1:])
    for _, _, data, starts, ends, word_offsets in Texts(texts.column("_wl_text")):
        gone = np.zeros(len(starts), bool)
        if some and len(starts) >= sizes[-1]:
            value, other = K.span_hashes(data, starts, ends), K.span_hashes(data, starts, ends, 1)
            for a, b, inner in _pieces(value, word_offsets, sizes[-1]):
                marked = state.repeated(value[a:b], other[a:b], inner)
                gone[a:b] |= K.covered(marked, sizes[-1], b - a)
        for a, b in zip(word_offsets[:-1].tolist(), word_offsets[1:].tolist()):
            lost = int(gone[a:b].sum())
            if a == b:
                yield 0, 0, [], b""
                continue
            keep = ~gone[a:b]
            edge = np.diff(np.concatenate([[0], keep.view(np.int8), [0]]))
            runs = [data[x:y].tobytes() for x, y in zip(starts[a:b][edge[:-1] == 1].tolist(), ends[a:b][edge[1:] == -1].tolist())]
            yield b - a, lost, runs, None


def _one_group(run):
    """run on groups of tables; a worker has one group's memory at a time, and none once it is idle."""

    def first(table):
        try:
            return run(table)
        finally:
            K.release()

    def both(table, other):
        try:
            return run(table, other)
        finally:
            K.release()

    return both if len(inspect.signature(run).parameters) == 2 else first


def _grouped(docs: DataFrame, columns: list) -> tuple[DataFrame, int]:
    """columns, with the text as _wl_text and the group, and how many buckets of hashes there are."""
    units = -(-input_bytes(docs) // GROUP_BYTES)
    n = max(2 * partitions(docs.sparkSession), units)
    text = F.col("text").cast("string")
    return docs.select(*columns, text.alias("_wl_text"), F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("grp")), max(16, 4 * units)


def _crowded(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with `_wl_spare`, without the rows that are there over COPIES times, but with one spare of each; and those rows.

    Such rows, equal in doc_id and text, would all be one group's. What becomes of them is known: a window of theirs stands in every copy. One
    copy is enough to tell the other documents of their windows, so the copies' texts do not move.
    """
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"_wl_id": F.col("doc_id").cast("long"), "_wl_key": key_of(text), "_wl_check": check_of(text)})
    names = ["_wl_id", "_wl_key", "_wl_check"]
    counts = keyed.where("text is not null").groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > COPIES)
    crowds = written(counts.select(*(F.col(c).alias(f"{c}_c") for c in names)), "crowds")
    if crowds.isEmpty():
        return docs.withColumn("_wl_spare", F.lit(False)), None
    same = F.col("_wl_id").eqNullSafe(F.col("_wl_id_c")) & (F.col("_wl_key") == F.col("_wl_key_c")) & (F.col("_wl_check") == F.col("_wl_check_c"))
    crowd = keyed.where("text is not null").join(crowds, same, "left_semi")
    spare = crowd.dropDuplicates(names).select(*docs.columns, F.lit(True).alias("_wl_spare"))
    alone = keyed.join(crowds, same, "left_anti").select(*docs.columns, F.lit(False).alias("_wl_spare"))
    return alone.unionByName(spare), crowd.select(*docs.columns)


_WORD = r"[^\x20\x09-\x0D]+"


def _lost(window: int):
    """Of a row of a crowd: its words, and whether it loses them all, which it does if it has a window."""
    n = F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)).cast("long")
    return n, n >= window


def judge(docs: DataFrame, window: int = 35, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    sizes = lengths(window, levels)
    docs, crowd = _crowded(docs.select("doc_id", "text"))
    grouped, buckets = _grouped(docs, [F.col("doc_id").cast("long").alias("doc_id"), "_wl_spare"])

    def run(texts, known):
        kept = [(n_words, lost, hashlib.sha256(b" ".join(w for r in runs for w in r.split())).hexdigest()) for n_words, lost, runs, _ in _cut(texts, known, sizes)] if texts.num_rows else []
        n_words, lost, digest = zip(*kept) if kept else ([], [], [])
        own = {"doc_id": texts.column("doc_id"), "spare": texts.column("_wl_spare")} if kept else {"doc_id": pa.array([], pa.int64()), "spare": pa.array([], pa.bool_())}
        return pa.table(own | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}).select(["doc_id", "n_words", "n_removed", "kept_sha256", "spare"])

    out = grouped.groupBy("grp").cogroup(_levels(grouped, sizes, buckets).groupBy("grp")).applyInArrow(_one_group(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, spare boolean").where("not spare").drop("spare")
    if crowd is None:
        return out
    n, all_lost = _lost(window)
    words = F.array_join(F.regexp_extract_all(F.col("text").cast("string"), F.lit(_WORD), F.lit(0)), " ")
    return out.unionByName(crowd.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_words"), F.when(all_lost, n).otherwise(0).alias("n_removed"), F.sha2(F.when(all_lost, "").otherwise(words), 256).alias("kept_sha256")))


def remove(docs: DataFrame, window: int = 35, levels: int = LEVELS) -> DataFrame:
    """docs without the repeated words: texts that lose none stay as they are, else kept runs are joined by a space.

    A column n_chars, if there is one, follows the text.
    """
    sizes = lengths(window, levels)
    schema, text_at = docs.schema, docs.columns.index("text")
    docs, crowd = _crowded(docs)
    # By position, so that no name of docs can clash with a name in here.
    grouped, buckets = _grouped(docs, [*(F.col(f"`{c}`").alias(f"_wl_{i}") for i, c in enumerate(schema.names) if i != text_at), "_wl_spare"])

    def run(texts, known):
        if texts.num_rows == 0:
            return _arrow(schema).empty_table()
        old, spare = texts.column("_wl_text").to_pylist(), texts.column("_wl_spare")
        found = list(_cut(texts, known, sizes))
        new = [x if not f[1] else b" ".join(f[2]).decode() for x, f in zip(old, found)]
        columns = []
        for i, field in enumerate(_arrow(schema)):
            if i == text_at:
                columns.append(pa.array(new, field.type))
            elif field.name == "n_chars":
                counts = texts.column(f"_wl_{i}").to_pylist()
                columns.append(pa.array([c if not f[1] else len(t) for c, t, f in zip(counts, new, found)], field.type))
            else:
                columns.append(texts.column(f"_wl_{i}"))
        return pa.table(columns, names=schema.names).filter(pc.invert(spare))

    out = grouped.groupBy("grp").cogroup(_levels(grouped, sizes, buckets).groupBy("grp")).applyInArrow(_one_group(run), schema)
    if crowd is None:
        return out
    _, all_lost = _lost(window)
    left = {"text": F.lit(""), "n_chars": F.lit(0)}
    return out.unionByName(crowd.select(*(F.when(all_lost, left[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in left else F.col(f"`{f.name}`") for f in schema.fields)))


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
