"""Mixing sources to target weights by entropy balancing.

Sources share the words of all documents by weight; a target stops at `most` times its source's size and what is over is shared
again by weight until none is above. Of all document rates that give each source its target, those are taken that are nearest to one
copy each in relative entropy: the least of sum r log r - r + 1 under sum size * r = target and r <= most has
r = min(most, exp(lambda * size)), where lambda is found per source by Newton's method on the convex dual. All sources are solved
together, a step being one join and one aggregate over (source, size, documents); a step that leaves the bracket of the root is a halving
of it. Terms are summed as whole numbers of 2^-16 words, so that the order of addition does not matter and reruns agree to the last bit.

Rates become copies in whole numbers: along each source's sizes, the longest first, copies are what the running sum of rates
passes, so that what is rounded in one size is made up for in the next; what is left of a source's target is then taken from or
given to the size that leaves least, a few times. Of documents of one source and size, the first in the order of a hash take the odd copies.

Everything is DataFrame operations. Documents are told by (source, size, hash, row) and numbered in ranges of that order, so
neither a hot source nor rows that are all alike meet in one task; sums per source and size are partial aggregates.
The driver gets three numbers a step.

Defined cases: a null text has no words, and documents without words take none; a null source is a source, the last one; documents
of null, repeated or equal ids are rows of their own; rows that are equal in everything may take different numbers of copies, but
how many of them take how many is always the same; a source of no words has the target 0; an empty table gives no rows; very
long texts are counted whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ranks import ranked
from webloom.shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of a word's fractions in sums, and of a rate's.
FINE, RATE = 16, 20
#: Newton steps of one job, jobs at most, and the relative error of a source's words that ends them.
STEPS, JOBS, CLOSE = 6, 20, 1e-7
#: Times that a source's rest is given to one size.
REPAIRS = 4


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, hash, row: keys order sources by code point, null last; row tells equal rows apart."""
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size"), F.xxhash64("doc_id", "text").alias("hash"), F.monotonically_increasing_id().alias("row"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size, target of (key, source_size): shares by weight, none above `most` times its source's size.

    A level (words a unit of weight) says which sources stop at their limit, and those say the next level, until it stays;
    levels only rise. rest and open are the level's terms as whole numbers.
    """
    n = len(weights)
    weighed = ranked(sources, [F.col("key")]).select("key", "source_size", F.get(F.array(*(F.lit(w).cast("long") for w in weights)), F.pmod(F.col("place") - 1, F.lit(n)).cast("int")).alias("weight"))
    limit = F.col("source_size") * most
    rest, open_ = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    words = rest

    def above(rest: int, open_: int) -> Column:
        big = lambda c: c.cast("decimal(38,0)")
        return big(limit) * big(F.lit(open_)) < big(F.lit(rest)) * big(F.col("weight"))

    while open_:
        stopped = above(rest, open_)
        taken, left = weighed.agg(F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        if (words - taken, left) == (rest, open_):
            break
        rest, open_ = words - taken, left
    share = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(max(open_, 1)).cast("double")
    target = F.when(above(rest, open_), limit.cast("double")).otherwise(share) if open_ else limit.cast("double")
    return weighed.select("key", "source_size", target.alias("target"))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(tilt * x, F.lit(50.0))))


def _summed(value: Column) -> Column:
    """A sum that is the same in any order."""
    return F.sum(F.floor(value * float(1 << FINE)).cast("long")) / float(1 << FINE)


def tilts(classes: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """key, scale, tilt for each source of `wanted` (key, source_size, target): rates are min(most, exp(tilt * size / scale)).

    A null tilt stands for a source at its limit, of which all documents have the rate `most`.
    """
    scratch = Scratch(classes.sparkSession)
    with_words = scratch.write(classes.where("size > 0").select(F.col("key").alias("c_key"), "size", "n"), "classes")
    scales = with_words.groupBy("c_key").agg((F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")).cast("double")).alias("squares"), F.min("size").alias("least"))
    start = wanted.join(scales, F.col("key") == F.col("c_key")).where(F.col("target") < most * F.col("source_size"))
    scale = F.col("squares") / F.col("source_size")
    edge = F.log(F.col("target") / F.col("source_size")) * scale / F.col("least")
    grows = F.col("target") > F.col("source_size")
    low, high = F.when(grows, 0.0).otherwise(edge), F.when(grows, math.log(most) * scale / F.col("least")).otherwise(0.0)
    state = start.select("key", "target", scale.alias("scale"), low.cast("double").alias("low"), high.cast("double").alias("high"), F.lit(0.0).alias("tilt"), F.lit(1.0).alias("off"))
    state, held = scratch.write(state, "tilts"), ["key", "target", "scale", "low", "high", "tilt"]
    for _ in range(JOBS):
        for _ in range(STEPS):
            x = F.col("size") / F.col("scale")
            rate = _rate(F.col("tilt"), x, most)
            mass = F.col("n") * F.col("size") * rate
            sums = with_words.join(state.drop("off"), F.col("c_key") == F.col("key")).groupBy(*held).agg(_summed(mass).alias("words"), _summed(F.when(rate < most, mass * x).otherwise(0.0)).alias("slope"))
            over = F.col("words") > F.col("target")
            sums = sums.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high")), "off": F.abs(F.col("words") - F.col("target")) / F.col("target")})
            newton = F.col("tilt") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))
            inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
            moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
            state = sums.withColumn("tilt", F.when(F.col("off") <= CLOSE, F.col("tilt")).otherwise(moved)).select(*held, "off")
        state = scratch.write(state, "tilts")
        if state.where(F.col("off") > CLOSE).isEmpty():
            break
    return wanted.select("key", "source_size", "target").join(state.select(F.col("key").alias("s_key"), "scale", "tilt"), F.col("key") == F.col("s_key"), "left").drop("s_key")


def copies(classes: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """classes (key, size, n, first) with source_size, target, rate and `total`: the copies that all n documents take together."""
    joined = classes.join(solved.withColumnRenamed("key", "s_key"), F.col("key") == F.col("s_key")).drop("s_key")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("scale"), most))
    fixed = F.round(rate * float(1 << RATE)).cast("long")
    joined = joined.withColumn("rate", rate).withColumn("fixed", fixed * F.col("n")).drop("scale", "tilt")
    upto = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    passed = joined.withColumn("upto", F.sum("fixed").over(upto) + (1 << (RATE - 1)))
    total = F.shiftright("upto", RATE) - F.shiftright(F.col("upto") - F.col("fixed"), RATE)
    out = passed.withColumn("total", F.least(total, F.col("n") * most)).drop("fixed", "upto")
    scratch = Scratch(classes.sparkSession)
    for _ in range(REPAIRS):
        out = scratch.write(out, "copies")
        rests = out.groupBy("key", "target").agg(F.sum(F.col("total") * F.col("size")).alias("words"))
        rest = rests.select(F.col("key").alias("r_key"), F.round(F.col("target") - F.col("words")).cast("long").alias("rest"))
        open_ = out.join(rest, F.col("key") == F.col("r_key")).where("size > 0 and rest <> 0")
        room = F.when(F.col("rest") > 0, F.col("n") * most - F.col("total")).otherwise(F.col("total"))
        give = F.least(room, F.round(F.abs("rest") / F.col("size")).cast("long"))
        best = F.min_by(F.struct("size", (give * F.sign("rest")).cast("long").alias("give")), F.struct(F.abs(F.abs("rest") - give * F.col("size")), F.col("size")))
        given = open_.groupBy("r_key").agg(best.alias("b")).select("r_key", F.col("b.size").alias("r_size"), F.col("b.give").alias("give"))
        out = out.join(given, (F.col("key") == F.col("r_key")) & (F.col("size") == F.col("r_size")), "left").withColumn("total", F.col("total") + F.coalesce("give", F.lit(0))).drop("r_key", "r_size", "give")
    return scratch.write(out, "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target (the source's words in the mix), taken (the document's), source, copies of each row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(sized(docs), "sizes")
    placed = ranked(rows, [F.col("key"), -F.col("size"), F.col("hash"), F.col("row")])
    classes = scratch.write(placed.groupBy("key", "size").agg(F.count("*").alias("n"), F.min("place").alias("first")), "classes")
    sources = scratch.write(classes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    wanted = scratch.write(targets(sources, weights, most), "targets")
    counted = copies(classes, tilts(classes, wanted, most), most)
    counted = counted.select(F.col("key").alias("c_key"), F.col("size").alias("c_size"), "first", "source_size", "target", F.expr("div(total, n)").alias("each"), F.expr("total % n").alias("odd"))
    joined = placed.join(counted, (F.col("key") == F.col("c_key")) & (F.col("size") == F.col("c_size")))
    many = F.col("each") + F.when(F.col("place") - F.col("first") < F.col("odd"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (many * F.col("size")).alias("taken"), "source", many.alias("copies"))
