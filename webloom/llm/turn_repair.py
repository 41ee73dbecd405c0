"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily: an acceptor of a conversation's rows, a transducer of edits (Keep, Rerole, Delete, Insert) and an
acceptor of the role initials `(s?(ua)+)?`. Only states that a conversation reaches are built, in the order of its rows, which is a
topological one, and the shortest path is taken over weights (cost, labels) that compare by cost and then by the labels' text. Such
weights may be cut off at every state: two paths between the same states that have the same rows behind them have no labels of
which one begins with the other (what follows would be inserts that lead back to the same state, which cost more), so what is less stays less
whatever is put after it. Labels tell the repaired rows: a role's place decides whether Rerole and Insert give user or assistant.
At most one row is inserted at one place, since a second one costs more than deleting the row that asks for it.

A conversation may be long (one may hold a third of all rows), so it is composed in pieces. Rows are dealt by Spark in ranges of
(conversation, turn, role, text); equal rows are one with a count before that. Each range is cut into pieces of bounded rows and bytes, and a piece is solved from each grammar
state it may begin in to each it may end in. The pieces' weights, a few bytes a row, are then composed in order for each conversation, which
names each piece's own labels; and pieces are edited by those where they are. What one task sees of one conversation is its labels
(which are one value of the result) and, where a digest of the whole repaired text is asked for, that text as a stream.

Faults: blank (no character but white space), duplicate (role and text stood in an earlier row), truncated (the last character that is not white
space is none of `.!?`); a row's first counts. Blank and duplicate rows must be deleted; a truncated row that stays adds 1.

Defined cases: null roles and texts are one space (a blank text, a role of no grammar); null turns come first; rows of one turn are in the order of role,
then text; repeated rows are duplicates; rows of null conv_id are one conversation; an empty table gives no rows; a conversation of no rows has no faults,
costs nothing and keeps nothing; very long texts are a piece of their own; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.shared import Scratch

from ._spark import check_of, key_of

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: What an edit costs, and what a truncated row that stays adds.
COST, TRUNCATED = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}, 1
#: The grammar (s?(ua)+)?: state -> {initial: next state}; 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: The role that Rerole and Insert may give in a state, and the state after it.
MADE = tuple(next(((role, after[role[0]]) for role in ("user", "assistant") if role[0] in after), None) for after in GRAMMAR)
LEGAL = ("su", "ua", "au")
FINE, BLANK, DUPLICATE, CUT = range(4)
#: A piece ends at so many rows or bytes of text.
PIECE_ROWS, PIECE_BYTES = 512, 1 << 20
#: Characters of a text that ranges are told by.
PREFIX = 100

Weight = tuple[int, str]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows as a fixed hash of conversation and turn damages them: some dropped, emptied, cut, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(hit == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).when(hit == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def faulted(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with `n`, how often each is there, and the fault of the first of them."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumns({"key": key_of(F.col("text")), "check": check_of(F.col("text"))})
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = once.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("key").alias("f_key"), F.col("check").alias("f_check")).agg(F.min(when).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("key") == F.col("f_key")) & (F.col("check") == F.col("f_check"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.col("turn").eqNullSafe(F.col("first.turn")), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    return once.join(firsts, same).select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def edits(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """The composed arcs that take one row in a grammar state: label, cost, next state."""
    yield DELETE, COST[DELETE], state
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if initial in GRAMMAR[state]:
            yield KEEP, COST[KEEP] + more, GRAMMAR[state][initial]
        if MADE[state]:
            yield REROLE, COST[REROLE] + more, MADE[state][1]


def inserted(best: dict[int, Weight]) -> dict[int, Weight]:
    """The states before the next row: those reached, and those that one inserted row leads to."""
    out = dict(best)
    for state, (cost, labels) in best.items():
        if MADE[state]:
            new, after = (cost + COST[INSERT], labels + INSERT), MADE[state][1]
            if after not in out or new < out[after]:
                out[after] = new
    return out


def shortest(rows: list[tuple[str, int, int]], start: int) -> dict[int, Weight]:
    """The least weight from a grammar state to each that can be reached by rows (initial, fault, copies)."""
    best: dict[int, Weight] = {start: (0, "")}
    for initial, fault, n in rows:
        if fault not in (BLANK, DUPLICATE):
            after: dict[int, Weight] = {}
            for state, (cost, labels) in inserted(best).items():
                for label, price, onward in edits(initial, fault, state):
                    new = (cost + price, labels + label)
                    if onward not in after or new < after[onward]:
                        after[onward] = new
            best, n = after, n - 1
        # Rows that must go are taken before anything is inserted: D comes before I.
        if n:
            best = {state: (cost + n * COST[DELETE], labels + n * DELETE) for state, (cost, labels) in best.items()}
    return best


def apply(rows: list[tuple[str, str, int]], labels: str, state: int) -> list[tuple[str, str]]:
    """Rows (role, text, copies) edited by labels that begin in a grammar state."""
    out, at = [], 0

    def insert():
        nonlocal at, state
        while at < len(labels) and labels[at] == INSERT:
            role, state = MADE[state]
            out.append((role, ""))
            at += 1

    for role, text, n in rows:
        for _ in range(n):
            insert()
            if labels[at] == KEEP:
                state = GRAMMAR[state][role[0]]
                out.append((role, text))
            elif labels[at] == REROLE:
                made, state = MADE[state]
                out.append((made, text))
            at += 1
    insert()
    return out


_WEIGHTS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("labels", pa.large_string())]))
_PIECE = [("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("weights", _WEIGHTS), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))]
PIECE = "conv_id long, part long, piece long, weights array<struct<from: int, to: int, cost: long, labels: string>>, blank long, duplicate long, truncated long, illegal long, opens string, closes string, low long, high long, turns long, roles array<string>, texts array<string>, copies array<long>"
#: What the composition of pieces needs: all but the rows.
NARROW = ["conv_id", "part", "piece", "weights", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "low", "high", "turns"]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*rows)) or [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _piece(conv, part, number, rows: list[tuple], starts: tuple[int, ...]) -> tuple:
    """One piece as a row of _PIECE; rows are (turn, role, text, n, fault)."""
    kinds = [0, 0, 0, 0]
    illegal, last, turns = 0, None, []
    for turn, role, _, n, fault in rows:
        kinds[fault] += 1
        kinds[BLANK if fault == BLANK else DUPLICATE] += n - 1
        initial = role[:1]
        illegal += n - 1 + (last is not None and last + initial not in LEGAL)
        last = initial
        if turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
    short = [(role[:1], fault, n) for _, role, _, n, fault in rows]
    weights = [{"from": start, "to": to, "cost": cost, "labels": labels} for start in starts for to, (cost, labels) in shortest(short, start).items()]
    return (conv, part, number, weights, kinds[BLANK], kinds[DUPLICATE], kinds[CUT], illegal, rows[0][1][:1], last, turns[0] if turns else None, turns[-1] if turns else None, len(turns), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])


def _cut(batches):
    """Pieces of a range's rows, which are in order; all but the range's first conversation begin here, in state 0."""
    conv, number, rows, size, starts, begun = None, 0, [], 0, tuple(range(len(GRAMMAR))), False
    for batch in batches:
        out = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text", "n", "fault"))):
            new = begun and r[0] != conv
            if new or len(rows) >= PIECE_ROWS or size >= PIECE_BYTES:
                if rows:
                    out.append(_piece(conv, part, number, rows, starts))
                    number, rows, size = number + 1, [], 0
                starts = (0,) if new else tuple(range(len(GRAMMAR)))
            conv, part, begun = r[0], r[1], True
            rows.append(r[2:])
            size += len(r[4])
        yield _batch(out, _PIECE)
    if rows:
        yield _batch([_piece(conv, part, number, rows, starts)], _PIECE)


def pieces(rows: DataFrame) -> DataFrame:
    """Rows of faulted() as pieces in order: (part, piece) tells the place of each among all."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumns({"known": F.col("turn").isNotNull(), "prefix": F.substring("text", 1, PREFIX)})
    order = ["conv_id", "known", "turn", "role", "prefix"]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id().cast("long"))
    return dealt.select("conv_id", "part", "turn", "role", "text", "n", "fault").mapInArrow(_cut, PIECE)


class Path:
    """The composition of one conversation's pieces: the least weight to each grammar state, and how it got there."""

    def __init__(self):
        self.best: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}
        self.common: list[str] = []

    def take(self, name: tuple, weights: list[dict]) -> None:
        after: dict[int, tuple[int, str, tuple | None]] = {}
        for w in weights:
            if have := self.best.get(w["from"]):
                new = (have[0] + w["cost"], have[1] + w["labels"])
                if w["to"] not in after or new < after[w["to"]][:2]:
                    after[w["to"]] = (*new, (have[2], name, w["from"], w["labels"]))
        # What all paths begin with is decided.
        shared = os.path.commonprefix([labels for _, labels, _ in after.values()])
        self.common.append(shared)
        self.best = {state: (cost, labels[len(shared) :], way) for state, (cost, labels, way) in after.items()}

    def close(self) -> tuple[int, str, list[tuple]]:
        """cost, labels, and (name, state, labels) of each piece; a row inserted at the end is the last piece's."""
        ends = inserted({s: (cost, labels) for s, (cost, labels, _) in self.best.items()})
        (cost, labels), end = min((ends[s], s) for s in ACCEPTING if s in ends)
        state = end if end in self.best and self.best[end][:2] == (cost, labels) else next(s for s in self.best if MADE[s] and MADE[s][1] == end and (self.best[s][0] + COST[INSERT], self.best[s][1] + INSERT) == (cost, labels))
        way, out = self.best[state][2], []
        while way:
            way, name, begin, own = way
            out.append((name, begin, own if out or state == end else own + INSERT))
        return cost, "".join(self.common) + labels, out


_PATH = [("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("state", pa.int32()), ("labels", pa.large_string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())]
PATH = "conv_id long, part long, piece long, state int, labels string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _compose(batches):
    """Per conversation a row of its figures and labels (part is null), and one of the labels of each of its pieces."""
    names = NARROW
    conv, path = None, None

    def close() -> list[tuple]:
        cost, labels, ways = path.close()
        own = (conv, None, None, None, labels, high - low + 1 - turns if turns else 0, *sums, cost)
        return [own, *((conv, *name, state, part, None, None, None, None, None, None) for name, state, part in ways)]

    for batch in batches:
        out = []
        for r in zip(*(batch.column(c).to_pylist() for c in names)):
            p = dict(zip(names, r))
            if path is None or p["conv_id"] != conv:
                if path is not None:
                    out += close()
                conv, path, sums, last, low, high, turns = p["conv_id"], Path(), [0, 0, 0, 0], None, None, None, 0
            path.take((p["part"], p["piece"]), p["weights"])
            sums = [a + p[k] for a, k in zip(sums, ("blank", "duplicate", "truncated", "illegal"))]
            sums[3] += last is not None and last + p["opens"] not in LEGAL
            last = p["closes"]
            if p["turns"]:
                turns += p["turns"] - (high == p["low"])
                low, high = p["low"] if low is None else low, p["high"]
        yield _batch(out, _PATH)
    if path is not None:
        yield _batch(close(), _PATH)


_EDITED = [("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
EDITED = "conv_id long, part long, piece long, roles array<string>, texts array<string>"


def _edit(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            rows = apply(list(zip(r["roles"], r["texts"], r["copies"])), r["labels"], r["state"])
            yield _batch([(r["conv_id"], r["part"], r["piece"], [a for a, _ in rows], [b for _, b in rows])], _EDITED)


class Repair:
    """`audits`: a row per conversation (gaps, blank, duplicate, truncated, illegal, cost, audit). `edited`: its repaired rows in pieces."""

    def __init__(self, rows: DataFrame):
        scratch = Scratch(rows.sparkSession)
        cut = scratch.write(pieces(faulted(rows)), "pieces")
        dealt = cut.select(*NARROW).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
        paths = scratch.write(dealt.mapInArrow(_compose, PATH), "paths")
        self.audits = paths.where("part is null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.col("labels").alias("audit"))
        chosen = paths.where("part is not null").select(F.col("part").alias("p_part"), F.col("piece").alias("p_piece"), "state", "labels")
        joined = cut.select("conv_id", "part", "piece", "roles", "texts", "copies").join(chosen, (F.col("part") == F.col("p_part")) & (F.col("piece") == F.col("p_piece")))
        self.edited = joined.select("conv_id", "part", "piece", "roles", "texts", "copies", "state", "labels").mapInArrow(_edit, EDITED)

    def rows(self) -> DataFrame:
        """conv_id, part, piece, at, role, text: the repaired rows; (part, piece, at) is their order in a conversation."""
        pairs = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
        return self.edited.select("conv_id", "part", "piece", F.posexplode(pairs).alias("at", "r")).select("conv_id", "part", "piece", "at", "r.role", "r.text")


DIGEST = "conv_id long, repaired_sha256 string"


def _hash(batches):
    """The digest of each conversation's repaired text, a piece at a time."""
    conv, digest, fields = None, None, [("conv_id", pa.int64()), ("repaired_sha256", pa.string())]
    for batch in batches:
        out = []
        for one, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts"))):
            if digest is None or one != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, empty = one, hashlib.sha256(), True
            for role, text in zip(roles, texts):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        yield _batch(out, fields)
    if digest is not None:
        yield _batch([(conv, digest.hexdigest())], fields)


def audit(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage and repair."""
    repair = Repair(damaged(conversations))
    hashed = repair.edited.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_hash, DIGEST)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    audits, hashed = repair.audits.withColumnRenamed("conv_id", "a_conv"), hashed.withColumnRenamed("conv_id", "h_conv")
    joined = every.join(audits, F.col("conv_id").eqNullSafe(F.col("a_conv")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("h_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
