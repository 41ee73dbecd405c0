"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily against each: a phrase is
the longest match that the automaton has from here on, then the next begins. A text's cross entropy with a language is
about phrases * log2(length of the language's text) / length of the text (Ziv and Merhav, 1993), so the language that
needs fewest normalised phrases wins.

Fitting uses a bounded sample: per language the PER_LANGUAGE lettered rows with the least hash of doc_id, of these the
texts from their first letter on up to CHARS bytes together, the last one cut: the same for any number of languages
and any length. Every label is learned; the model grows with the labels, not with the documents. Prediction reads every
whole text. Both see texts in lower case, each run of other than letters as one space. A phrase also ends every SEGMENT
bytes, which is the same for all languages and adds a phrase at most; segments of many texts are parsed side by side,
one numpy step per byte of a segment and all languages.

`keep_known` rejects what is of no learned language: texts without a letter, and texts of LEAST_BYTES normalised bytes or
more for which even the best language needs more than MOST_BITS a byte (learned languages need up to 4.5 here, unlearned
ones mostly 5 to 9, random letters 9.6 and more); and, if target languages are named, texts of others.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text if nothing could be learned;
at equal phrases the first language by name wins; score is 1 - phrases of the best / phrases of the second (1 if
there is one language); rows of null doc_id or null lang are not learned from; very long texts are read whole, a batch of
bounded size or one text at a time; repeated rows are predicted each by itself and learned from once; an empty table
gives no rows; other columns, whatever their names, are passed by `keep_known` and ignored by `identify`. `keep_known` has
no ground to reject a lettered text if nothing could be learned, and keeps all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import written

PER_LANGUAGE, CHARS, SEGMENT = 200, 24_000, 256
#: A text of so many normalised bytes is of no learned language if each needs more bits a byte.
LEAST_BYTES, MOST_BITS = 100, 5.5
#: Sampled rows that may be broadcast; more go by a plain join.
MAX_CHOSEN = 1 << 17
#: Entries of a full table of moves; models that need more keep the moves that there are, sorted by state.
FULL = 1 << 25
UNKNOWN = "und"
_MISS = np.int32(1 << 30)
_LETTERED = r"\p{L}"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of the texts with runs of other than letters as one space, and their offsets."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    data = np.frombuffer(b"".join(raw), np.uint8)
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    keep[first] = letter[first]
    return np.where(letter, data, np.uint8(0x20))[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def automaton(data: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a byte string (Blumer et al., 1985); state 0 is the root."""
    length, link, to = [0], [-1], [{}]
    last = 0
    for c in data.tolist():
        new = len(to)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(to)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(dict(to[q]))
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to


class Model:
    """All languages' automata in one table: entry (state, class) is the next state's row, marked where a phrase ends."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        learned = {k: normalised([" ".join(texts[k])])[0] for k in self.languages}
        seen = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.uint8)]))
        # Class 0 is any byte that was not learned.
        self.classes = np.zeros(256, np.uint8)
        self.classes[seen] = np.arange(len(seen)) + 1
        self.width = len(seen) + 1
        built, self.roots, base = [], [], 0
        for k in self.languages:
            to = automaton(learned[k])
            moves = np.array([(s, self.classes[c], t) for s, row in enumerate(to) for c, t in row.items()], np.int64).reshape(-1, 3)
            built.append((base, len(to), moves))
            base += len(to) + 1
        self.full = base * self.width <= FULL
        scale = self.width if self.full else 1
        self.roots = np.array([b * scale for b, _, _ in built], np.int32)
        # After a byte that was not learned - a phrase of its own - the state is `dead`, from which any byte begins anew.
        self.dead = np.array([(b + n) * scale for b, n, _ in built], np.int32)
        self.anew = np.repeat((self.dead | _MISS)[:, None], self.width, axis=1)
        for own, (b, _, moves) in zip(self.anew, built):
            first = moves[moves[:, 0] == 0]
            own[first[:, 1]] = ((b + first[:, 2]) * scale) | _MISS
        if self.full:
            tables = []
            for own, dead, (b, n, moves) in zip(self.anew, self.dead, built):
                table = np.tile(own, (n + 1, 1))
                table[0] = dead  # a segment's first phrase is open from the start
                table[moves[:, 0], moves[:, 1]] = (b + moves[:, 2]) * self.width
                tables.append(table)
            self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        else:
            sorted_moves = [(b, m[np.lexsort((m[:, 1], m[:, 0]))]) for b, _, m in built]
            state = np.concatenate([b + m[:, 0] for b, m in sorted_moves])
            self.on = np.concatenate([m[:, 1] for _, m in sorted_moves]).astype(np.int16)
            self.to = np.concatenate([b + m[:, 2] for b, m in sorted_moves]).astype(np.int32)
            self.first = np.searchsorted(state, np.arange(base + 1)).astype(np.int32)
            self.halvings = int(np.diff(self.first).max()).bit_length()
        self.weights = np.array([np.log2(max(len(learned[k]), 2)) for k in self.languages])

    def _moved(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The entries of states (a row a language) on classes c: from the full table, or by halving a state's sorted moves."""
        if self.full:
            return self.table[state + c]
        low, end = self.first[state], self.first[state + 1]
        high, last = end, len(self.on) - 1
        for _ in range(self.halvings):
            middle = (low + high) >> 1
            less = (low < high) & (self.on[np.minimum(middle, last)] < c)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        at = np.minimum(low, last)
        missed = np.where(state == self.roots[:, None], self.dead[:, None], self.anew[:, c])
        return np.where((low < end) & (self.on[at] == c), self.to[at], missed)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each text (rows) needs in each language (columns)."""
        counts = np.diff(offsets)
        per = -(-counts // SEGMENT)
        doc = np.repeat(np.arange(len(counts)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[doc] + nth * SEGMENT
        size = np.minimum(offsets[doc + 1] - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, doc = begin[order], size[order], doc[order]
        c = np.append(self.classes[data], 0)
        state = np.repeat(self.roots[:, None], len(begin), axis=1)
        ended = np.ones((len(self.languages), len(begin)), np.int32)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step, side="left"))  # longer ones stand first
            entry = self._moved(state[:, :live], c[begin[:live] + step].astype(np.int32))
            ended[:, :live] += entry >> 30
            state[:, :live] = entry & (_MISS - 1)
        out = np.zeros((len(counts), len(self.languages)), np.int64)
        np.add.at(out, doc, ended.T)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: the language, the score, and whether it is of a learned language at all."""
        data, offsets = normalised(texts)
        cost = self.phrases(data, offsets) * self.weights
        best = cost.argmin(axis=1)
        least = cost.min(axis=1)
        second = np.partition(cost, 1, axis=1)[:, 1] if cost.shape[1] > 1 else np.full(len(cost), np.inf)
        score = 1 - np.divide(least, second, out=np.ones(len(cost)), where=second > 0)
        size = np.diff(offsets)
        known = (size < LEAST_BYTES) | (least <= MOST_BITS * size)
        return [self.languages[k] for k in best.tolist()], np.clip(score, 0, 1), known


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, chars: int = CHARS) -> Model:
    """A model from the bounded sample of the rows of docs (doc_id, text, lang) that may be learned from."""
    rows = docs.where(learnable & F.col("text").rlike(_LETTERED) & F.col("lang").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Only ids move to be ranked, and each task passes on no more than it may keep; then per_language rows a language.
    known = rows.select("doc_id", "lang")
    chosen = written(known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).groupBy("doc_id", "lang").agg(F.min("rank").alias("rank")), "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= MAX_CHOSEN else chosen
    # One text for a doc_id, however many rows repeat it, and no more of it than a language's share.
    passage = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, chars)
    sample = rows.join(chosen, ["doc_id", "lang"]).groupBy("lang", "rank").agg(F.min(passage).alias("text"))
    before = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.withColumn("before", before).where(F.col("before") < chars).collect(), key=lambda r: (r["lang"], r["rank"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode()[: chars - r["before"]].decode(errors="ignore"))
    return Model({k: v for k, v in texts.items() if any(c.isalpha() for t in v for c in t)})


def _predictor(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: list[str | None], lettered: list[bool]):
        """Languages, scores, and whether texts are of a learned language, a bounded amount of text at a time."""
        model, names, scores, known = shared.value, [], [], []
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= 4 * K.STEP_BYTES or i + 1 == len(texts):
                some = [x or "" for x in texts[begin : i + 1]]
                got = model.predict(some) if model.languages else ([UNKNOWN] * len(some), np.zeros(len(some)), np.ones(len(some), bool))
                names += got[0]
                scores += got[1].tolist()
                known += got[2].tolist()
                begin, size = i + 1, 0
        return [n if ok else UNKNOWN for n, ok in zip(names, lettered)], [s if ok else 0.0 for s, ok in zip(scores, lettered)], [k and ok for k, ok in zip(known, lettered)]

    return predict


def identify(docs: DataFrame, learnable: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from the rows that are not held out."""
    predict = _predictor(docs.sparkSession, fit(docs, ~held_out() & F.col("doc_id").isNotNull() if learnable is None else learnable))

    def run(batches):
        for batch in batches:
            names, scores, _ = predict(batch.column(3).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").rlike(_LETTERED), F.lit(False)).alias("lettered"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(K.released(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, languages: set[str] | None = None) -> DataFrame:
    """The rows of docs whose text is of a learned language (and of one of `languages`), with all their columns as they are."""
    predict = _predictor(docs.sparkSession, fit(docs, ~held_out() & F.col("doc_id").isNotNull()))
    names = docs.columns

    def run(batches):
        for batch in batches:
            found, _, known = predict(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist())
            keep = [ok and (languages is None or x in languages) for x, ok in zip(found, known)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(keep, pa.bool_()))

    # By position, so that no name of docs can clash with a name in here.
    lettered = F.coalesce(F.col("text").cast("string").rlike(_LETTERED), F.lit(False))
    return docs.select("*", lettered).toDF(*(f"c{i}" for i in range(len(names) + 1))).mapInArrow(K.released(run), docs.schema)
