"""Ordered funnel counting by a forward sweep.

A row of a funnel's first kind starts an attempt. Its next step is the client's earliest later row of the next kind; the attempt
ends where that row comes over `within` after its start, or where a row of the excluded kind lies after the previous step and
not after the next one.

The sweep reads a client's rows in time once, for all funnels together. Attempts wait in one bucket per step, each a deque in
the order of their starts: an excluded kind clears all buckets, the kind a bucket waits for moves all of it on at once after the
attempts that are too old are taken off its left end, and a row of the first kind is put at the end of the first bucket. Each
attempt is put in, moved and taken off a bounded number of times, so the sweep is linear, and its state is what started within
`within`.

An attempt does not outlast `within`, so a client's time is cut into blocks that are swept by themselves: a block starts the
attempts of its own rows and reads on into the next block for `within` (those rows are copied). A client with a third of all rows
is as many tasks' work as it has blocks. Rows of one client and time are one row (a set of kinds, gathered by partial aggregates), so
repeated rows do not meet in a task. The percentile is found in two steps: sums for every 2^14 microseconds name the range that holds
it (as many ranges as `within` has), and only that range's times, 2^14 at most, are looked at one by one. Nothing is sent to
the driver, and what is broadcast has a row per funnel and step.

Defined cases: rows with a null client, kind or time are left out; rows of several kinds at one time are all there at that time (the
excluded one first, then the steps from the last to the first, so that one time is one step at most for an attempt); repeated rows are one;
kinds in no funnel have no effect; a step of the same kind as the one before takes a later row; an empty table gives no rows; other columns,
whatever their names, are ignored. No text is read but the kind.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.shared import written

#: Name -> (kinds of the steps in order, the kind that ends an attempt).
FUNNELS = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}
WITHIN = 300_000_000
#: Microseconds of a block; a share of within / BLOCK of all rows is copied.
BLOCK = 3_600_000_000
#: Bits of the times that one range of the percentile's first step covers.
FINE = 14

Funnels = Mapping[str, tuple[tuple[str, ...], str | None]]


def micros(column: str, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone; the latter does not depend on the session's."""
    at = F.col(column)
    if kind != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    minutes = (F.unix_date(F.to_date(at)) * 1440 + F.hour(at) * 60 + F.minute(at)).cast("long")
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


class Sweep:
    """The state machine of one funnel over the rows of one client and block, in the order of time."""

    def __init__(self, steps: tuple[int, ...], excluded: int, within: int):
        self.first, self.later, self.excluded, self.within = steps[0], list(enumerate(steps[1:]))[::-1], excluded, within
        self.any = reduce(int.__or__, steps, excluded)
        self.waiting: list[deque[tuple[int, int]]] = [deque() for _ in steps[1:]]
        self.started = 0
        self.moved: list[tuple[int, int, int]] = []

    def take(self, at: int, kinds: int, own: bool) -> None:
        waiting = self.waiting
        if kinds & self.excluded:
            for bucket in waiting:
                bucket.clear()
        for k, kind in self.later:
            bucket = waiting[k]
            if bucket and kinds & kind:
                self._advance(k, at)
        if own and kinds & self.first:
            self.started += 1
            if waiting:
                bucket = waiting[0]
                while bucket and at - bucket[0][0] > self.within:
                    bucket.popleft()
                bucket.append((at, at))

    def _advance(self, k: int, at: int) -> None:
        """All that waits for step k + 2 reaches it, but for what is too old."""
        bucket, onward = self.waiting[k], self.waiting[k + 1] if k + 1 < len(self.waiting) else None
        oldest = at - self.within
        while bucket and bucket[0][0] < oldest:
            bucket.popleft()
        took = n = 0
        for start, before in bucket:
            if at - before != took:
                if n:
                    self.moved.append((k + 2, took, n))
                took, n = at - before, 0
            n += 1
            if onward is not None:
                onward.append((start, at))
        if n:
            self.moved.append((k + 2, took, n))
        bucket.clear()

    def close(self) -> list[tuple[int, int, int]]:
        """(step, microseconds from the step before, attempts) of all that was reached; ready for the next client."""
        out = [(1, 0, self.started), *self.moved] if self.started else []
        for bucket in self.waiting:
            bucket.clear()
        self.started, self.moved = 0, []
        return out


MOVES = "funnel string, client_id long, step int, took long, n long"


def _sweeper(funnels: Funnels, bits: dict[str, int], within: int):
    def sweep(batches):
        machines = [(name, Sweep(tuple(bits[k] for k in steps), bits.get(excluded, 0), within)) for name, (steps, excluded) in funnels.items()]
        group, out = None, []

        def close():
            for name, machine in machines:
                out.extend((name, group[0], *moved) for moved in machine.close())

        def batch_of():
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["funnel", "client_id", "step", "took", "n"])

        takes = [(m.any, m.take) for _, m in machines]
        for batch in batches:
            for client, block, at, kinds, own in zip(*(batch.column(c).to_pylist() for c in ("client_id", "block", "at", "kinds", "own"))):
                if group != (client, block):
                    if group:
                        close()
                    group = (client, block)
                for mine, take in takes:
                    if kinds & mine:
                        take(at, kinds, own)
            if len(out) >= 10_000:
                yield batch_of()
                out.clear()
        if group:
            close()
        yield batch_of()

    return sweep


def moves(events: DataFrame, funnels: Funnels = FUNNELS, within: int = WITHIN, block: int = BLOCK, client: str = "client_id", kind: str = "kind", at: str = "arrived_at") -> DataFrame:
    """funnel, client_id, step, took, n: how many of a client's attempts reached a step, by their time from the step before."""
    if block <= within:
        raise ValueError("a block must be longer than the time an attempt has")
    names = list(dict.fromkeys(k for steps, excluded in funnels.values() for k in (*steps, *([excluded] if excluded else []))))
    if not names or len(names) > 62:
        raise ValueError("between one and 62 kinds of rows can be told apart")
    bits = {name: 1 << i for i, name in enumerate(names)}
    rows = events.select(F.col(client).cast("long").alias("client_id"), F.col(kind).cast("string").alias("kind"), micros(at, dict(events.dtypes)[at]).alias("at"))
    rows = rows.where("client_id is not null and at is not null").where(F.col("kind").isin(names))
    bit = reduce(lambda c, i: c.when(F.col("kind") == names[i], F.lit(bits[names[i]])), range(len(names)), F.when(F.lit(False), F.lit(0)))
    times = rows.groupBy("client_id", "at").agg(F.bit_or(bit.cast("long")).alias("kinds"))
    own = F.expr(f"div(at - pmod(at, {block}), {block})")
    spread = times.withColumn("_own", own).withColumn("block", F.explode(F.when(F.pmod("at", F.lit(block)) < within, F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array("_own"))))
    spread = spread.select("client_id", "block", "at", "kinds", (F.col("block") == F.col("_own")).alias("own"))
    dealt = spread.repartition("client_id", "block").sortWithinPartitions("client_id", "block", "at")
    return dealt.mapInArrow(_sweeper(dict(funnels), bits, within), MOVES)


def percentiles(found: DataFrame, percent: int) -> DataFrame:
    """funnel, client_id, step, took: the ceil(percent * n / 100)-th smallest time of each client's step from the second on."""
    key = ["funnel", "client_id", "step"]
    times = found.where("step > 1").withColumn("range", F.shiftright("took", FINE))
    ranges = times.groupBy(*key, "range").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)}).withColumn("want", F.expr(f"div({percent} * all + 99, 100)"))
    ranges = ranges.where("upto - n < want and want <= upto").select(*(F.col(c).alias(f"r_{c}") for c in (*key, "range")), (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
    exact = times.groupBy(*key, "range", "took").agg(F.sum("n").alias("n"))
    near = exact.join(ranges, [F.col(c) == F.col(f"r_{c}") for c in (*key, "range")]).select(*key, "range", "took", "n", "left")
    passed = near.withColumn("upto", F.sum("n").over(Window.partitionBy(*key, "range").orderBy("took").rowsBetween(Window.unboundedPreceding, 0)))
    return passed.where("upto >= left").groupBy(*key, "range").agg(F.min("took").alias("took")).drop("range")


def count(events: DataFrame, funnels: Funnels = FUNNELS, within: int = WITHIN, percent: int = 25, **columns) -> DataFrame:
    """Per funnel and client with attempts: funnel, client_id, n1 to nK, deepest, t2 to tK (microseconds), same_depth.

    K is the number of steps of the longest funnel; t is null where no attempt got there. same_depth counts the clients of equal
    funnel and deepest, the client itself among them.
    """
    last = max(len(steps) for steps, _ in funnels.values())
    found = written(moves(events, funnels, within, **columns), "moves")
    counts = found.groupBy("funnel", "client_id").agg(*(F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, last + 1)), F.max("step").alias("deepest"))
    counts = written(counts, "funnels")
    times = percentiles(found, percent).groupBy(F.col("funnel").alias("_f"), F.col("client_id").alias("_c")).agg(*(F.max(F.when(F.col("step") == k, F.col("took"))).alias(f"t{k}") for k in range(2, last + 1)))
    # One row per funnel and step.
    depths = counts.groupBy(F.col("funnel").alias("_of"), F.col("deepest").alias("_at")).agg(F.count("*").alias("same_depth"))
    out = counts.join(times, (F.col("funnel") == F.col("_f")) & (F.col("client_id") == F.col("_c")), "left")
    out = out.join(F.broadcast(depths), (F.col("funnel") == F.col("_of")) & (F.col("deepest") == F.col("_at")))
    return out.select("funnel", "client_id", *(f"n{k}" for k in range(1, last + 1)), "deepest", *(f"t{k}" for k in range(2, last + 1)), "same_depth")
