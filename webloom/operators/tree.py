"""The folder tree of a site: roll-up, listing and layout.

A page stands in the folder of its path's segments but the last; a last segment without a dot in a URL that ends in /
is a folder itself. Hosts are one tree. Everything is computed from paths: no tree is built on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.shared import written

from .ranks import ranked

PAGES_SHOWN = 25


def folders() -> Column:
    """The segments of the folder that a page stands in."""
    s = F.filter(F.split(F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/")), "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
    leaf = (F.size(s) > 0) & (last.contains(".") | ~F.col("url").endswith("/"))
    return F.when(leaf, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)


def _path(parts: Column, length: Column) -> Column:
    return F.when(length == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), length), "/"), F.lit("/")))


def placed(pages: DataFrame) -> DataFrame:
    """pages with the segments of their folder and its path."""
    own = pages.withColumn("parts", folders())
    return own.withColumn("folder", _path(F.col("parts"), F.size("parts")))


def rollup(pages: DataFrame) -> DataFrame:
    """path, depth, name, pages, errors, direct_pages of every folder: all pages at or below it."""
    rows = placed(pages).select("parts", "status_code", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    here = F.size("parts") == F.col("depth")
    name = F.when(F.col("depth") == 0, "Root").otherwise(F.get("parts", F.col("depth") - 1))
    return (
        rows.select(_path(F.col("parts"), F.col("depth")).alias("path"), "depth", name.alias("name"), (F.coalesce(F.col("status_code"), F.lit(0)) >= 400).alias("error"), here.alias("here"))
        .groupBy("path", "depth", "name")
        .agg(F.count("*").alias("pages"), F.count_if("error").alias("errors"), F.count_if("here").alias("direct_pages"))
    )


def parent(path: Column) -> Column:
    return F.when(path == "/", F.lit(None)).otherwise(F.regexp_replace(path, "[^/]+/$", ""))


def children(tree: DataFrame) -> DataFrame:
    """path, subfolders, direct_pages."""
    counts = tree.select(parent(F.col("path")).alias("up")).where("up is not null").groupBy("up").agg(F.count("*").alias("n"))
    return tree.join(counts, F.col("path") == F.col("up"), "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("subfolders"), "direct_pages")


def prefixes(pages: DataFrame) -> DataFrame:
    """All folder paths, each once: the set that is open when everything is."""
    rows = placed(pages).select("parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    return rows.select(_path(F.col("parts"), F.col("depth")).alias("path")).distinct()


def shown_pages(pages: DataFrame, most: int = PAGES_SHOWN) -> DataFrame:
    """The first pages of each folder by URL, with their rank; the limit is the feature.

    Ranked in two steps - within a folder's hash parts, then over the few left - so that a folder with most of all pages is
    many tasks; the limit goes below the shuffle in both.
    """
    own = placed(pages).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(64)))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("folder", "part").orderBy("url"))).where(F.col("r") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy("url"))).where(F.col("rank") <= most).drop("r", "part")


def _hidden(paths: DataFrame, expanded: DataFrame) -> DataFrame:
    """The paths (path, its parts) with a folder above them that is not expanded (path)."""
    above = paths.select("path", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("n"), "parts").select("path", _path(F.col("parts"), F.col("n")).alias("up"))
    return above.join(expanded.select(F.col("path").alias("up")).distinct(), "up", "left_anti").select("path").distinct()


def layout(pages: DataFrame, inlinks: DataFrame | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """Nodes of the opened tree in drawing order: kind, path, url, label, depth, idx, radius, x, y, x3, y3, z3, ...

    Without expanded (path) all folders are open; with it those it names, and what lies in others is not drawn.
    Drawing order is folders before pages, depth first, by name: a sort key from the path says where a node stands, and
    idx and y are running sums over it, made in ranges. What is drawn is limited to PAGES_SHOWN pages a folder.
    """
    tree = rollup(pages).withColumn("open", F.lit(True))
    # A folder's key is its path with \x01 between segments; its pages come after all of its folders: \x7f.
    key = F.when(F.col("path") == "/", "").otherwise(F.translate(F.substring("path", 2, 1 << 30), "/", "\x01"))
    dirs = tree.select(F.lit("folder").alias("kind"), "path", F.lit(None).cast("string").alias("url"), "name", "depth", "pages", "errors", F.lit(None).cast("int").alias("status_code"), F.lit(True).alias("indexable"), key.alias("key"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("inlinks"), "open")
    shown = shown_pages(pages)
    if expanded is not None:
        named = tree.select("path", F.filter(F.split("path", "/"), lambda x: x != "").alias("parts"))
        shut = _hidden(named.where("path <> '/'"), expanded)
        open_ones = expanded.select(F.col("path").alias("e")).distinct()
        dirs = dirs.join(shut, "path", "left_anti").drop("open").join(open_ones, F.col("path") == F.col("e"), "left").withColumn("open", F.col("e").isNotNull()).drop("e")
        shown = shown.join(dirs.where("open").select(F.col("path").alias("d")), F.col("folder") == F.col("d"), "left_semi")
    if inlinks is not None:
        shown = shown.join(inlinks.select(F.col("dst"), F.col("n").alias("n_in")), F.col("url") == F.col("dst"), "left")
    else:
        shown = shown.withColumn("n_in", F.lit(0))
    own = F.when(F.col("folder") == "/", "").otherwise(F.translate(F.substring("folder", 2, 1 << 30), "/", "\x01"))
    leaves = shown.select(F.lit("page").alias("kind"), F.col("folder").alias("path"), "url", F.lit(None).cast("string").alias("name"), (F.size("parts") + 1).alias("depth"), F.lit(1).cast("long").alias("pages"), F.lit(0).cast("long").alias("errors"), "status_code", "indexable", F.concat(own, F.lit("\U0010ffff")).alias("key"), "rank", F.coalesce("n_in", F.lit(0)).cast("long").alias("inlinks"), F.lit(False).alias("open"))
    nodes = written(dirs.unionByName(leaves), "nodes")
    step = F.when(F.col("path").eqNullSafe("/") & (F.col("kind") == "folder"), 0.0).when(F.col("kind") == "folder", 65.0).otherwise(36.0)
    nodes = ranked(nodes, [F.col("key"), F.col("rank")], "idx", {"y": step}).withColumn("idx", (F.col("idx") - 1).cast("long"))
    # A folder has PAGES_SHOWN pages at most here, so no window is large.
    folder_idx = F.max(F.when(F.col("kind") == "folder", F.col("idx"))).over(Window.partitionBy("path"))
    nodes = nodes.withColumn("folder_idx", folder_idx)
    page = F.col("kind") == "page"
    fdepth = F.when(page, F.col("depth") - 1).otherwise(F.col("depth"))
    theta = fdepth * 0.7 + F.col("folder_idx") * 0.45 + F.when(page, (F.col("rank") - 1) * 0.15).otherwise(0.0)
    phi = F.pmod(F.col("folder_idx") * F.lit(0.35), F.lit(math.pi))
    r = F.lit(140.0) + fdepth * 90.0 + F.when(page, 60.0).otherwise(0.0)
    radius = F.when(page, F.least(F.lit(18.0), 6.0 + F.sqrt("inlinks") * 1.5)).otherwise(F.least(F.lit(35.0), 12.0 + F.sqrt("pages") * 2.2))
    label = F.when(page, text.tail_label(F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.col("url")))).otherwise(F.concat(F.when(F.col("path") == "/", "Root (/)").otherwise(F.col("name")), F.lit(" ("), F.col("pages").cast("string"), F.when(F.col("open"), ") [-]").otherwise(") [+]")))
    return nodes.select("kind", "path", "url", label.alias("label"), "depth", "idx", "folder_idx", "pages", "errors", "status_code", "indexable", radius.alias("radius"), (F.col("depth") * 240.0 - 450.0).alias("x"), "y", (r * F.sin(phi) * F.cos(theta)).alias("x3"), (r * F.sin(phi) * F.sin(theta)).alias("y3"), (r * F.cos(phi)).alias("z3"))


def layout_edges(nodes: DataFrame) -> DataFrame:
    """source, target by idx: of folders to their folders and pages."""
    heads = nodes.where("kind = 'folder'").select(F.col("path").alias("up"), F.col("idx").alias("source"))
    below = nodes.select(F.when(F.col("kind") == "page", F.col("path")).otherwise(parent(F.col("path"))).alias("of"), F.col("idx").alias("target"))
    return below.join(heads, F.col("of") == F.col("up")).select("source", "target")


def projected(nodes: DataFrame, yaw: float = 0.0, pitch: float = 0.0, camera: float = 600.0) -> DataFrame:
    """nodes seen by a camera: proj_x, proj_y, proj_z, proj_scale; draw by proj_z ascending."""
    cy, sy, cp, sp = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    x1, z1 = F.col("x3") * cy + F.col("z3") * sy, F.col("z3") * cy - F.col("x3") * sy
    y2, z2 = F.col("y3") * cp - z1 * sp, F.col("y3") * sp + z1 * cp
    scale = F.when(z2 + camera > 50, camera / (z2 + camera)).otherwise(0.1)
    return nodes.withColumns({"proj_x": x1 * scale, "proj_y": y2 * scale, "proj_z": z2, "proj_scale": scale})


def painted(nodes: DataFrame) -> DataFrame:
    """Projected nodes with `paint`, their place in the order they are drawn in: the least proj_z first."""
    return ranked(written(nodes, "projected"), [F.col("proj_z"), F.col("idx")], "paint")


def colour() -> Column:
    """The colour class of a node."""
    status = F.col("status_code")
    page = F.when(status.isNull(), "none").when(status.between(200, 299), F.when(F.col("indexable"), "ok").otherwise("not_indexable")).when(status.between(300, 399), "redirect").otherwise("error")
    return F.when(F.col("kind") == "folder", F.when(F.col("errors") > 0, "folder_error").otherwise("folder_ok")).otherwise(page)


def label_shown(total: Column, mode: str = "auto", hit: Column | None = None, three_d: bool = False) -> Column:
    """Whether a node's label is drawn: on hits only, always, or for folders that matter."""
    hit = F.lit(False) if hit is None else hit
    folder = F.col("kind") == "folder"
    if mode == "hover":
        return hit
    if mode == "all":
        return F.lit(True)
    if three_d:
        return hit | ((F.col("proj_scale") > 0.82) & (folder | (F.col("pages") >= F.floor(total / 15))))
    return hit | (F.col("path") == "/") | (folder & (F.col("pages") >= F.greatest(F.floor(total / 35), F.lit(2))))


def node_search(query: str) -> Column:
    """Nodes whose folder or label holds the query, whatever the case; an empty one finds none."""
    wanted = query.lower()
    return F.lit(False) if not wanted else F.lower("path").contains(wanted) | F.lower("label").contains(wanted)


def hit_test(nodes: DataFrame, x: float, y: float, three_d: bool = False) -> DataFrame:
    """The first node under a point."""
    px, py = (F.col("proj_x"), F.col("proj_y")) if three_d else (F.col("x"), F.col("y"))
    reach = F.greatest(F.col("radius"), F.lit(12.0))
    return nodes.where((px - x) * (px - x) + (py - y) * (py - y) <= reach * reach).orderBy("idx").limit(1)


def in_view(nodes: DataFrame, width: float, height: float, margin: float = 50.0) -> DataFrame:
    return nodes.where(F.col("x").between(-margin, width + margin) & F.col("y").between(-margin, height + margin))
