"""Byte-level BPE encoding with the tokenizers library, with each distinct piece of text encoded once.

The library cuts a text into pieces (a word with the space before it, a number, ...) and encodes each piece by
itself, so ids of a text are the concatenated ids of its pieces. `Encoder` finds the pieces of a batch with numpy,
keeps the ids of pieces it has met in a bounded table, and gives the library only those it has not met. Results
equal `Tokenizer.encode_batch(texts, add_special_tokens=False)` with `encode_special_tokens = True`.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import unicodedata

import numpy as np

from ._kernels import U64, mix, powers

#: Pieces whose ids one Python worker keeps; the table starts anew beyond it.
KEEP = 600_000
#: Pieces that the library encodes as one text.
TOGETHER = 50
_L, _N, _S, _O = 1, 2, 3, 0
#: Code points that \s means in the library's pattern.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def classes() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            out[c] = _L
        elif first == "N":
            out[c] = _N
    out[WHITE] = _S
    return out


@functools.cache
def point_values() -> np.ndarray:
    """What every code point adds to the hash of its piece."""
    return mix(np.arange(sys.maxunicode + 1, dtype=U64) + U64(0x2545F4914F6CDD1D))


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+ begin, in a batch of texts."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    space = kind == _S
    # The last white space before something else stands alone, or goes with what follows if it is U+0020.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start = run | last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    start[joined] = False
    # A lone apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    quote = np.flatnonzero(start & (points == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _L) & ~first[quote + 1]]
    if len(quote):
        one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
        short = quote[one]
        rest = quote[~one]
        rest = rest[rest + 2 < n]
        rest = rest[~first[rest + 2]]
        a, b = points[rest + 1], points[rest + 2]
        long = rest[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        for at, size in ((short, 2), (long, 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            # What is left of the letters, if anything, is a piece; other kinds begin one anyway.
            start[after] |= kind[after] == _L
    return np.flatnonzero(start)


class PieceTable:
    """Ids of texts that are made of pieces encoded each by itself; keeps the ids of KEEP pieces at most.

    A subclass says where pieces begin (`cut`), encodes new pieces (`learn`) and whole texts (`plain`).
    """

    def cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        raise NotImplementedError

    def plain(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def forget(self) -> None:
        self.bits = 21
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << 16, U64)
        self.checks = np.zeros(1 << 16, U64)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0
        self.spilled: dict[int, int] = {}

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key or -1; entries that share a slot are in `spilled`."""
        at = self.slots[(keys >> U64(64 - self.bits)).astype(np.int64)]
        hit = (at >= 0) & (self.keys[np.maximum(at, 0)] == keys)
        out = np.where(hit, at, -1)
        if self.spilled:
            miss = np.flatnonzero(~hit & (at >= 0))
            get = self.spilled.get
            out[miss] = [get(k, -1) for k in keys[miss].tolist()]
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        ids, sizes = self.learn(texts)
        m = len(keys)
        while self.n + m > len(self.keys):
            self.keys, self.checks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.checks))
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        new = np.arange(self.n, self.n + m)
        self.keys[new], self.checks[new], self.size[new] = keys, checks, sizes
        self.begin[new] = self.used + np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += m
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = new[free]
        lost = np.flatnonzero(self.keys[self.slots[slot]] != keys)
        self.spilled.update(zip(keys[lost].tolist(), new[lost].tolist()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as one uint32 array and the n + 1 offsets of the texts."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = self.cut(points, offsets)
        ends = np.append(starts[1:], len(points))
        wide = point_values()[points]
        key = []
        for which in (0, 1):
            up, down = powers(len(points), which)
            sums = np.zeros(len(points) + 1, U64)
            np.cumsum(wide * up, out=sums[1:])
            key.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)))
        keys, checks = key
        entry = self._find(keys)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            if self.n + len(miss) > KEEP:
                self.forget()
                miss = np.arange(len(keys))
            _, at = np.unique(keys[miss], return_index=True)
            at = miss[at]
            self._learn(keys[at], checks[at], [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            entry[miss] = self._find(keys[miss])
        if not np.array_equal(self.checks[entry], checks):
            # Two pieces share a 64-bit key: this batch is encoded without the table.
            got = self.plain(texts)
            return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got])])
        size = self.size[entry].astype(np.int64)
        after = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[entry] - (after - size), size) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]


class Encoder(PieceTable):
    """A byte-level BPE tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer with the usual pattern is expected")
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = iter(range(256, 512))
        self.letters = [chr(b) if b in set(plain) else chr(next(odd)) for b in range(256)]
        # Pieces are encoded many at once by the same model, which is told where they end by a space: no byte's letter is one.
        self.split = Tokenizer(self.model)
        self.split.pre_tokenizer = WhitespaceSplit()
        self.symbols = np.array([*map(ord, self.letters[:255]), 0x20], np.uint32)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.letters_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.letters_of[list(vocabulary.values())] = [*map(len, vocabulary)]
        self.forget()

    def cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return piece_starts(points, offsets)

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A lone surrogate is in no text, and 0xFF in no UTF-8.
        raw = np.frombuffer("\ud800".join(pieces).encode("utf-8", "surrogatepass").replace(b"\xed\xa0\x80", b"\xff"), np.uint8)
        gaps = np.append(np.flatnonzero(raw == 0xFF), len(raw))
        letters = self.symbols[raw].tobytes().decode("utf-32-le")
        at = [0, *gaps[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(raw)]
        got = self.split.encode_batch_fast([letters[a:b] for a, b in zip(at, at[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in got])
        ends, after = gaps - np.arange(len(gaps)), np.cumsum(self.letters_of[ids])
        upto = np.searchsorted(after, ends) + 1
        # Tokens must end where pieces end, which they don't if the model leaves letters out or names them otherwise.
        if len(ids) and upto[-1] == len(ids) and np.array_equal(after[upto - 1], ends):
            return ids, np.diff(upto, prepend=0).astype(np.int32)
        return self.learn_singly(pieces)

    def learn_singly(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters, tokenize = self.letters, self.model.tokenize
        got = [[t.id for t in tokenize("".join([letters[b] for b in x.encode()]))] for x in pieces]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)
