"""Near-duplicate documents by order MinHash, with candidates verified by banded alignment.

A text is the sequence of its 5-word shingles, each labelled with how often it came before in the text. For each of
SKETCHES random orders of labelled shingles, the PICKED least are taken and kept in the order of the text; their hash is one
sketch, so two texts share it only if they share those shingles in the same order - which is likelier the closer
they are in edits (Marcais et al., 2019). Texts that share a sketch are candidates.

Candidates are verified by an alignment of the labelled shingles. A labelled shingle occurs once in a text, so the best
alignment is the longest increasing run of matched places, and only pairs of places within a band can be part of one
that reaches the threshold: the band is what two texts at the threshold can drift apart, so it loses nothing. The
similarity is aligned shingles over all shingles (an order-sensitive Jaccard index); at 0.8 or more there is a link.

Sharing: a sketch is met by both texts at similarity s with a chance of about s ** PICKED, so one of SKETCHES is
missed by a pair at 0.8 about once in two million, less for closer pairs.

Scale: copies of one text are one node from the start, found by a hash that is summed up before it moves. A bucket
does not make all its pairs: its least and its greatest node are compared with each member, so candidates grow with
the members, and as texts share many buckets with different members, links join through many of them. Where a bucket
still holds several components, its nodes meet again in up to ROUNDS rounds under pairs of sketches and with other
ends, which makes components grow at little cost, so that few pairs are left. What is left in buckets of several components is then searched
exactly: a prefix-filtered join over their shingles (Chaudhuri et al., 2006; Xiao et al., 2008) gives all pairs of
different components that can be at the threshold, and each is verified. Joins on buckets and
shingles are equi-joins between written tables, not with an aggregate's output or another join's, so that Spark's adaptive
execution can split a partition that a very common bucket or shingle makes large. Only texts of nodes with a candidate go on to be
aligned. Nothing is collected to the driver.

Defined cases: a null text or one without words is in no group; a very long text is read whole, so a task needs memory for
the two longest texts it aligns; texts of under five words have one shingle, all of
their words; the class of a group is its least doc_id, null only if all are null; rows of equal doc_id are one
document to `classes`, so that all or none are kept, and rows to `keep_one`; an empty table gives no rows; other
columns, whatever their names, are passed by `keep_one` and ignored by `classes`.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import Scratch, check_of, clashes, components, key_of, told_apart, written

U64 = K.U64
SHINGLE, SKETCHES, PICKED = 5, 20, 3
#: Rounds over buckets that hold several components; the exact search after them finds what they leave, however many there are.
ROUNDS = 2
#: The similarity as a fraction.
THRESHOLD = (4, 5)
#: Shingles that are ranked at a time.
STEP = 1 << 15
_ORDERS = np.random.default_rng(77).integers(0, 2**63, size=256, dtype=np.uint64) * U64(2) + U64(1)


def labelled(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The occurrence-labelled shingles of a batch of texts, in order, and the n + 1 offsets of the texts."""
    starts, ends, word_offsets = K.words(data, offsets)
    value = K.span_hashes(data, starts, ends)
    counts = np.diff(word_offsets)
    hashes, fits = K.window_hashes(value, size), K.window_fits(word_offsets, size)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(out_offsets[-1], U64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    place = np.ones(len(out), bool)
    place[out_offsets[short]] = False
    out[place] = hashes[fits]
    for i in short.tolist():
        out[out_offsets[i]] = K.window_hashes(value[word_offsets[i] : word_offsets[i + 1]], int(counts[i]))[0]
    label = K.occurrence_labels(out, out_offsets)
    return K.mix(out + label.astype(U64) * U64(0xD6E8FEB86659FD93)), out_offsets


def sketch(shingles: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One hash per random order: of its least shingles, in the order of the text."""
    orders = _ORDERS[:sketches, None]
    best = np.zeros((sketches, 0), np.int64)
    for a in range(0, len(shingles), STEP):
        at = np.concatenate([best, np.broadcast_to(np.arange(a, min(a + STEP, len(shingles))), (sketches, min(STEP, len(shingles) - a)))], axis=1) if best.shape[1] else None
        ranks = shingles[at] * orders if at is not None else shingles[None, a : a + STEP] * orders
        rows = np.arange(sketches)
        found = []
        for _ in range(min(picked, ranks.shape[1])):
            j = ranks.argmin(axis=1)
            found.append(j)
            ranks[rows, j] = U64(2**64 - 1)
        j = np.stack(found, axis=1)
        best = np.take_along_axis(at, j, axis=1) if at is not None else j + a
    best = np.sort(best, axis=1)
    out = np.arange(sketches, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for k in range(best.shape[1]):
        out = K.mix(out + shingles[best[:, k]])
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> int:
    """How many shingles the best alignment in the band matches; 0 where the threshold can't be reached."""
    p, q = threshold
    short, long = sorted((len(a), len(b)))
    if q * short < p * long:
        return 0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if (p + q) * len(i) < p * (len(a) + len(b)):
        return 0
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = np.abs(i - j) * q <= (q - p) * long
    j = j[near]
    if (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> bool:
    m = aligned(a, b, threshold)
    return m > 0 and m * threshold[1] >= threshold[0] * (len(a) + len(b) - m)


def _sketched(batches):
    for batch in batches:
        data, offsets_all = K.flat(batch.column(3))
        sketches, sizes = [], []
        for i, j in K.steps(offsets_all):
            offsets = offsets_all[i : j + 1]
            values, at = labelled(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            sizes += np.diff(at).tolist()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                sketches.append(sketch(values[a:b]).view(np.int64) if b > a else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sketches, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "node", "check", "sketch", "size"])


def _verified(batches):
    for batch in batches:
        (data_a, at_a), (data_b, at_b) = K.flat(batch.column(2)), K.flat(batch.column(3))
        keep = []
        for i, j in K.steps(at_a + at_b, 2 * K.STEP_BYTES):
            own_a, own_b = at_a[i : j + 1], at_b[i : j + 1]
            left, l_at = labelled(data_a[own_a[0] : own_a[-1]], own_a - own_a[0])
            right, r_at = labelled(data_b[own_b[0] : own_b[-1]], own_b - own_b[0])
            keep += [similar(left[l_at[k] : l_at[k + 1]], right[r_at[k] : r_at[k + 1]]) for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(shared: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of all nodes that share a bucket: the one time that all texts move."""
    wanted = shared.select("node").distinct().join(nodes, "node").select(F.col("node").alias("w"), F.col("least").alias("of"))
    # Rows that are equal in both become one where they are, so that copies of a text do not move.
    once = rows.where("text is not null").dropDuplicates(["node", "doc_id"])
    texts = once.join(wanted, (F.col("node") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text")
    return texts


def _verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes that are linked."""
    first = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    both = first.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    return scratch.write(both.mapInArrow(K.released(_verified), "a long, b long"), "links")


def _apart(shared: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """node, size, root, bucket of the rows of shared whose bucket holds nodes of several components."""
    own = shared.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("node", "size", "bucket", F.coalesce("root", "node").alias("root"))
    mixed = scratch.write(own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("bucket").alias("m")), "mixed")
    return own.join(mixed, F.col("bucket") == F.col("m")).select("node", "size", "root", "bucket")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links between nodes of several components."""
    at = roots.withColumnsRenamed({"node": "n", "root": "of"})
    one = links.join(at, F.col("a") == F.col("n"), "left").select(F.coalesce("of", "a").alias("a"), "b")
    two = one.join(at, F.col("b") == F.col("n"), "left").select("a", F.coalesce("of", "b").alias("b"))
    joined = components(two, "near").withColumnsRenamed({"node": "was", "root": "now"})
    old = roots.join(joined, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    new = joined.join(at, F.col("was") == F.col("n"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return old.unionByName(new).distinct()


def _of_a_size() -> Column:
    """Whether a node and its lead have sizes that two texts at the threshold can have; others can't be linked."""
    p, q = THRESHOLD
    return q * F.least("size", "lead.size") >= p * F.greatest("size", "lead.size")


def _paired(step: int) -> Column:
    """Each sketch with the one `step` places on, as one bucket."""
    return F.transform("sketch", lambda x, i: F.xxhash64(x, F.get("sketch", F.pmod(i + step, F.lit(SKETCHES)))))


def _shingled(batches):
    for batch in batches:
        data, offsets_all = K.flat(batch.column(2))
        for i, j in K.steps(offsets_all):
            offsets = offsets_all[i : j + 1]
            values, at = labelled(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), lists], names=["node", "root", "size", "shingles"])


def _possible(texts: DataFrame, left: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of nodes of left (node, root) of different roots that can be at the threshold, and few others.

    Shingles have one order for all nodes: first those of one component only, which no pair has in common, then the
    rest, rare ones first. Two texts at the threshold share a shingle among the first of each (its prefix), and after the first
    that they share enough must be left on both sides.
    """
    p, q = THRESHOLD
    listed = scratch.write(texts.join(left, "node").select("node", "root", "text").mapInArrow(K.released(_shingled), "node long, root long, size long, shingles array<long>"), "shingles")
    each = listed.select("node", "root", "size", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select(F.col("shingle").alias("s"), "n")
    common = scratch.write(common, "common")
    own = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "shingle"))
    placed = each.join(common, F.col("shingle") == F.col("s")).select("node", "root", "size", "shingle", place.alias("place"))
    prefix = scratch.write(placed.where(f"place <= size - div({p} * size + {q - 1}, {q}) + 1"), "prefixes")
    # The component with most nodes of a shingle is met by the others only, not by itself.
    of = scratch.write(prefix.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("most")), "most")
    others = scratch.write(prefix.join(of, "shingle").where("root <> most").select("shingle", *(F.col(c).alias(f"{c}_o") for c in ("node", "root", "size", "place"))), "others")
    fits = f"{q} * least(size, size_o) >= {p} * greatest(size, size_o)"
    enough = f"{p + q} * (1 + least(size - place, size_o - place_o)) >= {p} * (size + size_o)"
    met = others.join(prefix, "shingle").where("root <> root_o").where(fits).where(enough)
    return met.select(F.least("node", "node_o").alias("a"), F.greatest("node", "node_o").alias("b")).distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The rows (doc_id, node, has: whether there is a word), the nodes with words (node, least), the linked ones (node, root)
    and the keys that several texts share, if there are any (node, low)."""
    scratch, text = Scratch(docs.sparkSession), F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(text).alias("node"), check_of(text).alias("check"), text.alias("text"))
    sketched = written(rows.mapInArrow(K.released(_sketched), "doc_id long, node long, check long, sketch array<long>, size long"), "sketches")
    # A text is known by 128 bits: a key of 64, and 64 more that tell apart the few texts that share a key.
    shared_keys = clashes(sketched)
    rows, sketched = told_apart(rows, shared_keys), told_apart(sketched, shared_keys)
    narrow = sketched.select("doc_id", "node", F.col("sketch").isNotNull().alias("has"))
    nodes = narrow.where("has").groupBy("node").agg(F.min("doc_id").alias("least"))

    single = sketched.where("sketch is not null").dropDuplicates(["node"]).select("node", "sketch", "size")
    members = scratch.write(single.select("node", "size", F.explode("sketch").alias("bucket")), "members")
    whole = F.struct("node", "size")
    ends = scratch.write(members.groupBy("bucket").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).where("low.node <> high.node"), "ends")
    shared = scratch.write(members.join(ends, "bucket").select("node", "size", "bucket", "low", "high"), "shared")
    met = shared.select("node", "size", F.explode(F.array("low", "high")).alias("lead")).where(_of_a_size() & F.expr("node <> lead.node"))
    tested = scratch.write(met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct(), "pairs")
    texts = scratch.write(_texts_of(shared, rows, nodes), "texts")
    links = _verify(tested, texts, scratch)
    roots = components(links, "near")

    # A link that was not met yet is between nodes of a bucket that holds several components. Their sketches are met again
    # two by two, which parts dissimilar texts, with other ends of the buckets in each round, while rounds add links.
    left = _apart(shared, roots, scratch).select("node").distinct()
    left = scratch.write(single.join(left, "node", "left_semi"), "left")
    texts = scratch.write(texts.join(left, "node", "left_semi"), "texts")
    for step in range(1, ROUNDS + 1):
        apart = scratch.write(_apart(left.select("node", "size", F.explode(_paired(step)).alias("bucket")), roots, scratch), "apart")
        order, whole = F.xxhash64("node", "bucket"), F.struct("node", "size", "root")
        ends = scratch.write(apart.groupBy("bucket").agg(F.min_by(whole, order).alias("low"), F.max_by(whole, order).alias("high")), "ends")
        met = apart.join(ends, "bucket").select("node", "size", "root", F.explode(F.array("low", "high")).alias("lead")).where(_of_a_size() & F.expr("root <> lead.root"))
        pairs = met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        pairs = scratch.write(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = _verify(pairs, texts, scratch)
        if links.isEmpty():
            break
        roots, tested = scratch.write(_merged(roots, links), "roots"), tested.unionByName(pairs)

    # What no lead was near to: every pair of components that can still be linked.
    left = scratch.write(_apart(shared, roots, scratch).select("node", "root").distinct(), "left")
    pairs = scratch.write(_possible(texts, left, scratch).join(tested, ["a", "b"], "left_anti"), "pairs")
    roots = written(_merged(roots, _verify(pairs, texts, scratch)), "roots")
    scratch.drop()
    return narrow, nodes, roots, shared_keys


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, component_id (the least doc_id of its group), kept."""
    narrow, nodes, roots, _ = _grouped(docs)
    joined = roots.join(nodes, "node").select("node", "root", "least")
    heads = joined.groupBy("root").agg(F.min("least").alias("head"))
    named = joined.join(heads, "root").select(F.col("node").alias("n"), "head")
    classed = nodes.join(named, F.col("node") == F.col("n"), "left").select(F.col("node").alias("n"), F.coalesce("head", "least").alias("head"))
    out = narrow.join(classed, (F.col("node") == F.col("n")) & F.col("has"), "left")
    component = F.when(F.col("has"), F.col("head")).otherwise(F.col("doc_id"))
    return out.select("doc_id", component.alias("component_id")).select("doc_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns as they are: one row of each group, and all rows without words.

    Rows are told apart by doc_id and text, so that a row goes only for its own text. The row that stays is of the least
    doc_id, null last, and of the least hash of a text among those; of rows equal in both one stays.
    """
    narrow, _, roots, shared_keys = _grouped(docs)
    keys = narrow.where("has").groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    least = keys.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("head"))
    of = least.join(roots.withColumnsRenamed({"node": "r"}), F.col("node") == F.col("r"), "left").select(F.col("node").alias("w"), F.coalesce("root", "node").alias("root"), "head")
    heads = of.select("w", "root").join(of.groupBy("root").agg(F.min("head").alias("head")), "root").select("w", "head")
    first = (F.col("node") == F.col("head.node")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    judged = written(keys.join(heads, F.col("node") == F.col("w")).select(F.col("doc_id").alias("j_id"), F.col("node").alias("j_node"), "n", first.alias("first")), "judged")
    text = F.col("text").cast("string")
    # By position, so that no name of docs can clash with a name in here.
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_wl_{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("own"), key_of(text).alias("node"), check_of(text).alias("check"))
    named = told_apart(plain, shared_keys)
    own = F.col("own").eqNullSafe(F.col("j_id")) & (F.col("node") == F.col("j_node"))
    out = named.join(judged.where("not first"), own, "left_anti")
    again = judged.where("first and n > 1")
    if not again.isEmpty():
        # dropDuplicates takes all columns of one row; only rows that are there several times move.
        one = out.join(again, own, "left_semi").dropDuplicates(["own", "node"])
        out = out.join(again, own, "left_anti").unionByName(one)
    return out.select(*(F.col(f"_wl_{i}").alias(c) for i, c in enumerate(docs.columns)))
