"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text is the one whose pieces' stored scores sum highest; at equal scores the longest last
piece wins. `stream` reads a text once: it keeps the backpointers of the positions of a window, and where the paths of all
positions that can still be extended (those from which what was read begins a piece, within the longest piece's length)
meet in one boundary, it commits the ids before it and forgets them. The window is looked over whenever it has doubled, so
time is in proportion to the text. Where paths never meet (a long run of one character) the window is the whole run, at
twelve bytes a code point.

In most models a piece holds U+2581 (a space) at its start or nothing else, so all paths meet at every word's start: there
the stream commits whatever was read, and a word is a window. `Encoder` uses that commit rule for many texts at once:
they are cut at those boundaries and the windows are solved with numpy, those of equal length together, each distinct
one once (a bounded table keeps them). Longer windows go through `stream`, and so do all texts where a model has
pieces over a word's start. Both give the same ids, which tests check over a whole table.

The model is used as it is: identity normalisation, one space before the text, spaces as U+2581, and byte pieces for
characters without a piece (U+2581 itself among them, so that decoding gives back each text exactly). Its scores are
taken as stored also where the file was made by merges (ranks): this is the Viterbi path over those scores, which is not
the library's order of merges.

Defined cases: a null or empty text has no ids and decodes to the empty text; rows are encoded each by itself, so ties and
repeated rows need no rule; a very long text is encoded by itself, and a window grows only while paths do not meet, for which a
long unbroken run needs its own length; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._kernels import U64, mix, powers
from .bpe import PieceTable
from .packing import text_steps

SPACE = 0x2581
#: Stands for a U+2581 of the text, which has no piece.
LITERAL = 0x110000
#: Code points of the longest word solved with others.
LONGEST_WORD = 40
#: Words solved together.
WORDS = 32_768
_SPREAD = U64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _bytes_of(point: int) -> bytes:
    return chr(SPACE if point == LITERAL else point).encode("utf-8", "surrogatepass")


class Encoder(PieceTable):
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.uint32)
        self.texts: list[bytes] = [b""] * n
        self.pieces: dict[tuple[int, ...], tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.texts[i] = piece.replace(chr(SPACE), " ").encode()
                self.pieces[tuple(map(ord, piece))] = (i, -model.get_score(i))
        self.over_words = any(SPACE in p[1:] and set(p) != {SPACE} for p in self.pieces)
        self.unknown = max(c for _, c in self.pieces.values()) + 10
        self.longest = max(map(len, self.pieces))
        self._index()
        self.pool_bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.text_sizes = np.array([len(t) for t in self.texts])
        self.text_begins = np.cumsum(self.text_sizes) - self.text_sizes
        self.forget()

    @functools.cached_property
    def tree(self) -> tuple[dict[int, int], list[tuple[int, float] | None]]:
        """The pieces as a tree: (node, code point) in one number -> node, and the piece that ends in each node; 0 is the root."""
        children: dict[int, int] = {}
        ends: list[tuple[int, float] | None] = [None]
        for points, piece in self.pieces.items():
            node = 0
            for point in points:
                node = children.setdefault(node << 21 | point, len(ends))
                if node == len(ends):
                    ends.append(None)
            ends[node] = piece
        return children, ends

    def _index(self) -> None:
        """The pieces in the order of their hashes, and a sieve that passes their hashes and few others."""
        self.ids = np.array([i for i, _ in self.pieces.values()], np.uint32)
        hashes = np.array([self._hash(np.array(p, U64)) for p in self.pieces], U64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = self.ids[order]
        self.costs = np.array([c for _, c in self.pieces.values()])[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.hashes * _SPREAD >> U64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(points: np.ndarray) -> np.uint64:
        up, _ = powers(len(points))
        return (mix(points + U64(0x51)) * up).sum() + U64(len(points))

    # Words, many at a time.

    def cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = points == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][offsets[:-1] < len(points)]] = True
        return np.flatnonzero(start)

    def solve(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words, one a row and longest first: boundaries of the best paths, and entries of the pieces that end there."""
        m, n = points.shape
        up, down = powers(n + 1)
        sums = np.zeros((n + 1, m), U64)
        np.cumsum((mix(points.astype(U64) + U64(0x51)) * up[:n]).T, axis=0, out=sums[1:])
        cost = np.full((n + 1, m), np.inf)
        cost[0] = 0
        back, entry = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
        live = np.searchsorted(-lengths, -np.arange(n + 1), side="right")
        for i in range(1, n + 1):
            w = int(live[i])
            best, at, piece = cost[i, :w], back[i, :w], entry[i, :w]
            for size in range(min(i, self.longest), 0, -1):
                j = i - size
                h = (sums[i, :w] - sums[j, :w]) * down[j] + U64(size)
                rows = np.flatnonzero(self.sieve[(h * _SPREAD >> U64(42)).astype(np.int64)])
                if len(rows):
                    k = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
                    total = cost[j, rows] + self.costs[k]
                    better = (self.hashes[k] == h[rows]) & (total < best[rows])
                    rows, k = rows[better], k[better]
                    best[rows], at[rows], piece[rows] = total[better], j, k
                if size == 1:
                    total = cost[j, :w] + self.unknown
                    rows = np.flatnonzero(total < best)
                    best[rows], at[rows], piece[rows] = total[rows], j, -1
        end = np.zeros((n + 1, m), bool)
        at = lengths.copy()
        rows = np.flatnonzero(at)
        while len(rows):
            end[at[rows], rows] = True
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return end, entry

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        joined = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        joined[joined == SPACE] = LITERAL
        joined[joined == 0x20] = SPACE
        begins = np.cumsum(lengths) - lengths
        words, places, ids = [], [], []
        for r in np.flatnonzero(lengths > LONGEST_WORD).tolist():
            got = np.fromiter(self.stream(joined[begins[r] : begins[r] + lengths[r]].tolist()), np.uint32)
            words.append(np.full(len(got), r))
            places.append(np.arange(len(got)))
            ids.append(got)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= LONGEST_WORD]
        for a in range(0, len(order), WORDS):
            rows = order[a : a + WORDS]
            own = lengths[rows]
            column = np.arange(own[0])
            points = joined[np.minimum(begins[rows][:, None] + column, len(joined) - 1)]
            end, entry = self.solve(points, own)
            i, r = np.nonzero(end)
            k = entry[i, r]
            known = k >= 0
            words.append(rows[r[known]])
            places.append(i[known] * 8)
            ids.append(self.ids[k[known]])
            for i, r in zip(i[~known].tolist(), r[~known].tolist()):
                raw = _bytes_of(int(points[r, i - 1]))
                words.append(np.full(len(raw), rows[r]))
                places.append(np.arange(len(raw)) + i * 8)
                ids.append(self.byte_ids[list(raw)])
        words, places, ids = map(np.concatenate, (words, places, ids))
        order = np.lexsort((places, words))
        return ids[order], np.bincount(words, minlength=len(pieces)).astype(np.int32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [list(self.stream(self.points(t))) for t in texts]

    # One text, position by position.

    @staticmethod
    def points(prefixed: str) -> list[int]:
        return [SPACE if c == " " else LITERAL if ord(c) == SPACE else ord(c) for c in prefixed]

    def stream(self, points: Iterable[int]) -> Iterator[int]:
        """The ids of a text, given as code points with spaces as U+2581, each as soon as it is sure.

        A place may begin a later piece while what was read since is the beginning of one; those places are held with their node in
        the tree of pieces, longest first. The window is looked over for the boundary in which all their paths meet whenever
        it has doubled, so that a text whose paths never meet (a run of one character) takes time in proportion to its length.
        """
        (children, ends), least = self.tree, 2 * self.longest
        window, sizes, found = array("I"), array("I"), array("i")  # code points; size and id of the best piece that ends after each
        held: list[tuple[int, int, float]] = []
        cost, look = 0.0, least
        for point in points:
            i = len(window)
            held.append((i, 0, cost))
            best, size, piece, after = float("inf"), 1, -1, []
            for begin, node, before in held:
                node = children.get(node << 21 | point)
                if node is not None:
                    after.append((begin, node, before))
                    if (own := ends[node]) and before + own[1] < best:
                        best, size, piece = before + own[1], i + 1 - begin, own[0]
            if (point,) not in self.pieces and cost + self.unknown < best:
                best, size, piece = cost + self.unknown, 1, -1
            held, cost = after, best
            window.append(point)
            sizes.append(size)
            found.append(piece)
            if len(window) >= look:
                if boundary := self._meet(sizes, held):
                    yield from self._ids(window, sizes, found, boundary)
                    for column in (window, sizes, found):
                        del column[:boundary]
                    held = [(begin - boundary, node, before - cost) for begin, node, before in held]
                    cost = 0.0
                look = max(least, 2 * len(window))
        yield from self._ids(window, sizes, found, len(window))

    @staticmethod
    def _meet(sizes, held) -> int:
        """The last boundary on the best paths to the end and to all held places."""
        heap = sorted({-len(sizes), *(-begin for begin, _, _ in held)})
        while len(heap) > 1:
            top = -heapq.heappop(heap)
            if -top != heap[0]:
                heapq.heappush(heap, sizes[top - 1] - top)
        return -heap[0]

    def _ids(self, window, sizes, found, end) -> list[int]:
        out = []
        while end:
            begin = end - sizes[end - 1]
            out.append([found[end - 1]] if found[end - 1] >= 0 else self.byte_ids[list(_bytes_of(window[begin]))].tolist())
            end = begin
        return [i for ids in reversed(out) for i in ids]

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and their offsets, from all ids and theirs; the first space of each text is dropped."""
        sizes = self.text_sizes[ids]
        after = np.concatenate([[0], np.cumsum(sizes)])
        out = self.pool_bytes[np.repeat(self.text_begins[ids] - after[:-1], sizes) + np.arange(after[-1])]
        ends = after[offsets]
        keep = np.ones(len(out), bool)
        keep[ends[:-1][np.diff(ends) > 0]] = False
        return out[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        prefixed = [" " + t if t else "" for t in texts]
        if not self.over_words:
            return self.encode(prefixed)
        got = self.plain(prefixed)
        return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _payload(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def encode(docs: DataFrame, path: str | None = None, check: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32); check: also decoded_chars and round_trip.

    The check decodes the ids again where they were made, and compares the bytes of text and decoded text.
    """
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for doc_ids, texts in text_steps(batch, ["doc_id", "text"]):
                ids, offsets = encoder(path).encode_texts(texts)
                columns = [doc_ids, pa.array(np.diff(offsets).astype(np.int64)), _payload(ids, offsets)]
                names = ["doc_id", "n_tokens", "ids"]
                if check:
                    data, ends = encoder(path).decode_flat(ids.astype(np.int64), offsets)
                    back = [data[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    columns += [pa.array([len(x.decode("utf-8", "replace")) for x in back], pa.int64()), pa.array([x == t.encode() for x, t in zip(back, texts)], pa.bool_())]
                    names += ["decoded_chars", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded_chars long, round_trip boolean" * check
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded of rows (doc_id, ids)."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            for i, j in K.steps(offsets):
                ids = data[offsets[i] : offsets[j]].view("<u4").astype(np.int64)
                out, ends = encoder(path).decode_flat(ids, (offsets[i : j + 1] - offsets[i]) // 4)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), text.cast(pa.binary()).cast(pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
