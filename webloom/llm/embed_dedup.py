"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Cells come from spherical k-means on a bounded sample (SAMPLE vectors, those with the least hash of their content;
one cell per PER_CELL vectors, MAX_CELLS at most). Every vector is at home in the cell of its nearest centre, and
visits each cell of lower number that may hold a near vector: for unit vectors at cosine t the distance is
r = sqrt(2 - 2 t), and if y is at home in c then x is at least (x.c_x - x.c) / |c_x - c| away from it, so x visits c
where that is at most r. No pair is lost whatever the sample is, and each is met once: in the lower of its two cells.

In a cell, home vectors and visitors are dealt to blocks of bounded size by a hash, and each pair of blocks is a task of its own, so
a hot cell is many tasks. A task multiplies its blocks in strips, screens in single precision and decides in double. It
returns per vector how many it is linked with, and links that span what it found connected - one a vector at most -
and not all pairs.

Copies of a vector are one from the start, with their number. Defined cases: a vector that is null, empty, zero or has
a null or non-finite component is linked with nothing, its copies included; vectors are compared with those of equal
length only; rows that repeat are vectors of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import U64, mix
from ._spark import Scratch, check_of, clashes, components, key_of, told_apart, written

SAMPLE, PER_CELL, MAX_CELLS, ROUNDS = 20_000, 2048, 1024, 8
#: Vectors whose largest component is below it or above its inverse are scaled by a power of two first.
SMALLEST = 1e-100
#: Home vectors and visitors in a block, and rows multiplied at a time.
HOME_BLOCK, VISIT_BLOCK, STRIP = 2048, 8192, 512


def matrix(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Unit vectors in double precision from little-endian bytes of equal lengths."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of unit vectors; a cell that runs empty takes the vector farthest from its own centre."""
    centres = x[np.random.default_rng(5).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        if len(empty):
            far = np.argsort((x * centres[near]).sum(axis=1))[: len(empty)]
            sums[empty], norm[empty] = x[far], 1
        centres = sums / norm[:, None]
    return centres


def visits(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and for all cells whether a vector visits it."""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 256 else np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    gap = dots[np.arange(len(x)), home][:, None] - dots
    near = gap <= radius * apart[home] + 1e-9
    return home, near & (np.arange(len(centres))[None, :] < home[:, None])


def _deal(fit: dict[int, np.ndarray], blocks: dict, radius: float, kind: str):
    """Copies of each vector for the tasks it has a part in; blocks: home and visitor blocks of (length, cell)."""

    width = int(kind[-1])

    def run(batches):
        for batch in batches:
            node, weight, raw = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_pylist()
            sizes = np.array([len(r) // width for r in raw])
            take, unit, side = [], [], []
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = matrix([raw[i] for i in at], kind)
                home, seen = visits(x, fit[size], radius) if size in fit else (np.zeros(len(at), int), np.zeros((len(at), 1), bool))
                salt = mix(node[at].astype(U64))
                for cell in np.unique(home).tolist():
                    here = np.flatnonzero(home == cell)
                    n_home, n_visit = blocks.get((int(size), cell), (1, 1))
                    own = (salt[here] % U64(n_home)).astype(int)
                    for i in range(n_home):
                        mine = at[here[own == i]]
                        for j in range(n_home):
                            a, b = min(i, j), max(i, j)
                            take.append(mine)
                            unit += [f"{size}/{cell}/h/{a}/{b}"] * len(mine)
                            side += [0 if i <= j else 1] * len(mine)
                        for v in range(n_visit):
                            take.append(mine)
                            unit += [f"{size}/{cell}/v/{i}/{v}"] * len(mine)
                            side += [0] * len(mine)
                for cell in np.flatnonzero(seen.any(axis=0)).tolist():
                    here = np.flatnonzero(seen[:, cell])
                    n_home, n_visit = blocks.get((int(size), cell), (1, 1))
                    own = (salt[here] % U64(n_visit)).astype(int)
                    for v in range(n_visit):
                        mine = at[here[own == v]]
                        for i in range(n_home):
                            take.append(mine)
                            unit += [f"{size}/{cell}/v/{i}/{v}"] * len(mine)
                            side += [1] * len(mine)
            index = pa.array(np.concatenate(take) if take else np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(side, pa.int32()), batch.column(0).take(index), weight.take(index), batch.column(2).take(index)], names=["unit", "side", "node", "weight", "raw"])

    return run


def linked(left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """Pairs of rows (i, j) with cosine at the threshold or above, a strip of left rows at a time; same: j > i."""
    screen = right.astype(np.float32)
    for a in range(0, len(left), STRIP):
        strip = left[a : a + STRIP]
        i, j = np.nonzero(strip.astype(np.float32) @ screen.T >= threshold - 1e-4)
        if same:
            i, j = i[j > i + a], j[j > i + a]
        for b in range(0, len(i), 1 << 18):
            p, q = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
            hit = np.einsum("ij,ij->i", strip[p], right[q]) >= threshold
            if hit.any():
                yield p[hit] + a, q[hit]


class Forest:
    """Connected parts of numbered nodes, from arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                return
            np.minimum.at(self.root, high[apart], low[apart])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            i, j = i[apart], j[apart]


def _compare(threshold: float, kind: str):
    def run(table):
        side = table.column("side").to_numpy()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        part, i, j = table.column("unit")[0].as_py().split("/")[2:]
        x = matrix(table.column("raw").to_pylist(), kind)
        same = part == "h" and i == j
        left = np.arange(len(x)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        count, forest = np.zeros(len(x), np.int64), Forest(len(x))
        if len(left) and len(right):
            for p, q in linked(x[left], x[right], same, threshold):
                p, q = left[p], right[q]
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                forest.add(p, q)
        at = np.flatnonzero(count)
        return pa.table({"node": pa.array(node[at]), "root": pa.array(node[forest.root[at]]), "links": pa.array(count[at])})

    return run


def _bytes(kind: str):
    def run(batches):
        """Vectors as bytes of their own precision; what can't be compared is null."""
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, dtype=kind) if v and None not in v else np.zeros(1)
                top = np.abs(x).max(initial=0) if np.isfinite(x).all() else 0
                if top > 0 and not SMALLEST < top < 1 / SMALLEST:  # its square would not be a number, or be zero; a power of two keeps directions
                    x = np.ldexp(x, -int(np.frexp(top)[1])).astype(kind)
                out.append(x.tobytes() if top > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    return run


def classes(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    radius = math.sqrt(2 - 2 * threshold) + 1e-9
    # Vectors travel in the precision they came in; all arithmetic on them is in double.
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    width = int(kind[-1])
    wide = "array<float>" if width == 4 else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(wide).alias("embedding")).mapInArrow(_bytes(kind), "vec_id long, raw binary")
    scratch = Scratch(vectors.sparkSession)
    rows = written(rows.withColumn("node", key_of(F.col("raw"))).withColumn("check", check_of(F.col("raw"))), "vectors")
    rows = told_apart(rows, clashes(rows.where("raw is not null")))
    nodes = written(rows.where("raw is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("raw").alias("raw")), "nodes")

    n = nodes.count()
    sample = [bytes(r.raw) for r in nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("raw").collect()]
    fit = {}
    for size in {len(r) // width for r in sample}:
        x = matrix([r for r in sample if len(r) == width * size], kind)
        k = max(1, min(MAX_CELLS, math.ceil(n * len(x) / len(sample) / PER_CELL), len(x)))
        fit[size] = spherical_kmeans(x, k)

    def cells(batches):
        """How many are at home in each cell and visit it."""
        found: dict[tuple, int] = {}
        for batch in batches:
            raw = batch.column(0).to_pylist()
            sizes = np.array([len(r) // width for r in raw])
            for size in np.unique(sizes).tolist():
                x = matrix([raw[i] for i in np.flatnonzero(sizes == size)], kind)
                home, seen = visits(x, fit[size], radius) if size in fit else (np.zeros(len(x), int), np.zeros((len(x), 1), bool))
                for part, counts in (("h", np.bincount(home)), ("v", seen.sum(axis=0))):
                    for cell in np.flatnonzero(counts).tolist():
                        found[size, cell, part] = found.get((size, cell, part), 0) + int(counts[cell])
        keys = list(found)
        yield pa.RecordBatch.from_pydict({"size": [k[0] for k in keys], "cell": [k[1] for k in keys], "kind": [k[2] for k in keys], "n": [found[k] for k in keys]}, pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("kind", pa.string()), ("n", pa.int64())]))

    # Two rows per cell, MAX_CELLS cells for each length of vectors.
    counted = nodes.select("raw").mapInArrow(cells, "size int, cell int, kind string, n long").groupBy("size", "cell", "kind").agg(F.sum("n").alias("n")).collect()
    blocks: dict[tuple[int, int], list[int]] = {}
    for r in counted:
        blocks.setdefault((r["size"], r["cell"]), [1, 1])[r["kind"] == "v"] = max(1, math.ceil(r["n"] / (VISIT_BLOCK if r["kind"] == "v" else HOME_BLOCK)))

    dealt = nodes.select("node", "weight", "raw").mapInArrow(_deal(fit, {k: tuple(v) for k, v in blocks.items()}, radius, kind), "unit string, side int, node long, weight long, raw binary")
    met = scratch.write(dealt.groupBy("unit").applyInArrow(_compare(threshold, kind), "node long, root long, links long"), "links")
    counts = written(met.groupBy("node").agg(F.sum("links").alias("links")), "counts")

    ids = nodes.select("node", "least")
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), "cells")
    scratch.drop()
    held = rows.where("raw is not null").select("vec_id", "node")
    grouped = ids.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    heads = grouped.groupBy("root").agg(F.min("least").alias("head"))
    named = grouped.join(heads, "root").select(F.col("node").alias("n"), "head")
    named = named.join(counts.withColumnRenamed("node", "c_node"), F.col("n") == F.col("c_node"), "left").join(nodes.select(F.col("node").alias("w_node"), "weight"), F.col("n") == F.col("w_node")).select("n", "head", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = held.join(named, F.col("node") == F.col("n")).select("vec_id", "n_links", F.col("head").alias("component_id"))
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
