"""Density clustering of points on a grid, for groups of any size.

Cells have side eps / sqrt(2), so points of one cell are always neighbours: a cell with min_samples
points is all core and needs no distances. Distances are taken only between points of smaller cells
(fewer than min_samples each), which keeps the work linear in the points however they pile up. Full
cells are quad-trees of bounding boxes: two of them, or one and a point of a smaller cell, are compared
by boxes that are split only where the answer is in doubt. Joins of points by cell go by a slice of the
cell too, so a crowded cell is no single task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.operators.sequence import cut_lineage

# Parts of a cell that points are joined by.
SLICES = 64
# Cells whose points can be within eps of a cell's points (corners of the 5 x 5 square cannot).
NEAR = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if not (abs(i) == 2 and abs(j) == 2)]


def _gap2(a: str, b: str) -> Column:
    """Smallest squared distance of two boxes."""
    total = F.lit(0.0)
    for c in "xy":
        d = F.greatest(F.col(f"{a}{c}0") - F.col(f"{b}{c}1"), F.col(f"{b}{c}0") - F.col(f"{a}{c}1"), F.lit(0.0))
        total = total + d * d
    return total


def _reach2(a: str, b: str) -> Column:
    """Largest squared distance of two boxes."""
    total = F.lit(0.0)
    for c in "xy":
        d = F.greatest(F.col(f"{a}{c}1") - F.col(f"{b}{c}0"), F.col(f"{b}{c}1") - F.col(f"{a}{c}0"))
        total = total + d * d
    return total


def _boxes(points: DataFrame, keys: list[str], side: float, level: int) -> DataFrame:
    """Bounding boxes of the points of each cell split 4^level ways per axis."""
    s = side / 4 ** level
    box = [F.count(F.lit(1)).alias("w"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    return points.groupBy(*keys, "cx", "cy", F.floor(F.col("x") / s).alias("u"), F.floor(F.col("y") / s).alias("v")).agg(*box)


def _named(boxes: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return boxes.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in ("cx", "cy", "u", "v", "x0", "x1", "y0", "y1")])


def _full_cell_links(core: DataFrame, keys: list[str], side: float, eps: float) -> DataFrame:
    """Pairs of neighbouring full cells with a pair of points within eps."""
    e2 = eps * eps
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEAR if (i, j) > (0, 0)])
    whole = _boxes(core, keys, side, 0)
    a = _named(whole, "a", keys).withColumn("o", F.explode(half))
    a = a.withColumns({"bcx": F.col("acx") + F.col("o.i"), "bcy": F.col("acy") + F.col("o.j")}).drop("o")
    pairs = a.join(_named(whole, "b", keys), [*keys, "bcx", "bcy"])
    cell = [*keys, "acx", "acy", "bcx", "bcy"]
    links, level = None, 0
    while True:
        pairs = cut_lineage(pairs.withColumns({"_near": _gap2("a", "b") <= e2, "_sure": _reach2("a", "b") <= e2}).filter("_near"))
        found = pairs.filter("_sure").select(*cell).distinct()
        links = found if links is None else links.unionByName(found)
        open_ = pairs.filter(~F.col("_sure")).join(found, cell, "left_anti")
        if open_.isEmpty():
            return links
        level += 1
        # Split only the boxes still in doubt; a box of one place is always certain.
        fine = _boxes(core, keys, side, level).withColumns({
            "pu": F.floor(F.col("u") / 4), "pv": F.floor(F.col("v") / 4)})
        parents = open_.select(*cell, F.col("au").alias("apu"), F.col("av").alias("apv"), F.col("bu").alias("bpu"), F.col("bv").alias("bpv"))

        def child(p: str) -> DataFrame:
            return _named(fine, p, keys).join(
                fine.select(*keys, F.col("u").alias(f"{p}u"), F.col("v").alias(f"{p}v"), F.col("pu").alias(f"{p}pu"), F.col("pv").alias(f"{p}pv"),
                            F.col("cx").alias(f"{p}cx"), F.col("cy").alias(f"{p}cy")), [*keys, f"{p}cx", f"{p}cy", f"{p}u", f"{p}v"])

        pairs = parents.join(child("a"), [*keys, "acx", "acy", "apu", "apv"]).join(child("b"), [*keys, "bcx", "bcy", "bpu", "bpv"]) \
            .drop("apu", "apv", "bpu", "bpv")


def _full_cells_near(small: DataFrame, full: DataFrame, keys: list[str], side: float, eps: float, enough: int) -> DataFrame:
    """(keys, _id, qcx, qcy, cx, cy, _w): a point (qx, qy) of a small cell, a full cell in reach, how many of its points are within eps.

    Boxes wholly within eps count as they are, those wholly beyond drop out, the others are split. What is left of a
    cell isn't counted once the point is known to have `enough` neighbours and to reach the cell.
    """
    e2 = eps * eps
    point = [*keys, "_id", "qcx", "qcy", "cx", "cy"]
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEAR])
    q = small.withColumn("o", F.explode(near)).withColumns({"cx": F.col("qcx") + F.col("o.i"), "cy": F.col("qcy") + F.col("o.j")}).drop("o")
    q = q.withColumns({"qx0": F.col("qx"), "qx1": F.col("qx"), "qy0": F.col("qy"), "qy1": F.col("qy")}).drop("qx", "qy")
    ends = ["qx0", "qx1", "qy0", "qy1"]
    named = lambda b: b.select(*[c for c in b.columns if c not in ("x0", "x1", "y0", "y1")], *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
    pairs = q.join(named(_boxes(full, keys, side, 0)), [*keys, "cx", "cy"])
    sure, level = None, 0
    while True:
        pairs = cut_lineage(pairs.withColumns({"_near": _gap2("q", "b") <= e2, "_sure": _reach2("q", "b") <= e2}).filter("_near"))
        found = pairs.filter("_sure").select(*point, "w")
        sure = found if sure is None else sure.unionByName(found)
        known = sure.groupBy(*keys, "_id").agg(F.sum("w").alias("_w")).filter(F.col("_w") >= enough)
        met = sure.select(*keys, "_id", "cx", "cy").distinct().join(known, [*keys, "_id"], "left_semi")
        open_ = pairs.filter(~F.col("_sure")).join(met, [*keys, "_id", "cx", "cy"], "left_anti")
        if open_.isEmpty():
            return cut_lineage(sure.groupBy(*point).agg(F.sum("w").alias("_w")))
        level += 1
        fine = named(_boxes(full, keys, side, level)).withColumns({"pu": F.floor(F.col("u") / 4), "pv": F.floor(F.col("v") / 4)})
        parents = open_.select(*point, *ends, F.col("u").alias("pu"), F.col("v").alias("pv"))
        pairs = parents.join(fine, [*keys, "cx", "cy", "pu", "pv"]).drop("pu", "pv")


def _components(cells: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest cell of the component of each cell, by repeated minimum and pointer jumping."""
    node = F.struct("cx", "cy")
    both = links.select(*keys, F.struct(F.col("acx").alias("cx"), F.col("acy").alias("cy")).alias("s"),
                        F.struct(F.col("bcx").alias("cx"), F.col("bcy").alias("cy")).alias("t"))
    both = cut_lineage(both.unionByName(both.select(*keys, F.col("t").alias("s"), F.col("s").alias("t"))).distinct())
    roots = cells.select(*keys, node.alias("node"), node.alias("root"))
    while True:
        low = both.join(roots.select(*keys, F.col("node").alias("s"), "root"), [*keys, "s"]).groupBy(*keys, "t").agg(F.min("root").alias("_m"))
        step = roots.join(low.withColumnRenamed("t", "node"), [*keys, "node"], "left").select(
            *keys, "node", F.col("root").alias("_was"), F.least("root", F.coalesce("_m", "root")).alias("root"))
        step = cut_lineage(step)
        up = step.select(*keys, F.col("node").alias("root"), F.col("root").alias("_top"))
        new = cut_lineage(step.join(up, [*keys, "root"]).select(*keys, "node", "_was", F.col("_top").alias("root")))
        roots = new.select(*keys, "node", "root")
        if new.filter(F.col("_was") != F.col("root")).isEmpty():
            return roots


def dbscan(points: DataFrame, keys: list[str], id_: str, x: str, y: str, eps: float, min_samples: int) -> DataFrame:
    """(keys, id, cluster): clusters are numbered by their smallest core id, border points take the
    lowest cluster in reach, noise is -1."""
    side = eps / math.sqrt(2.0)
    p = points.select(*keys, F.col(id_).alias("_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    p = p.withColumn("_slice", F.pmod(F.xxhash64("_id"), F.lit(SLICES)))
    cell, slice_ = [*keys, "cx", "cy"], [*keys, "cx", "cy", "_slice"]
    sizes = p.groupBy(*slice_).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cut_lineage(sizes.select(*slice_, (F.sum("_n").over(Window.partitionBy(*cell)) >= min_samples).alias("_full")))
    p = cut_lineage(p.join(sizes, slice_))
    small, full = p.filter(~F.col("_full")), p.filter("_full")
    here = small.select(*keys, "_id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("qcx"), F.col("cy").alias("qcy"))
    # Distances of points in small cells to the distinct places of small cells around them.
    places = small.groupBy(*cell, "x", "y").agg(F.count(F.lit(1)).alias("_w"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEAR])
    around = here.withColumn("o", F.explode(near))
    around = around.withColumns({"cx": F.col("qcx") + F.col("o.i"), "cy": F.col("qcy") + F.col("o.j")}).drop("o")
    d2 = (F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2
    close = cut_lineage(around.join(places, cell).filter(d2 <= eps * eps))
    crowds = _full_cells_near(here, full, keys, side, eps, min_samples)
    weights = close.select(*keys, "_id", "_w").unionByName(crowds.select(*keys, "_id", "_w"))
    lone = weights.groupBy(*keys, "_id").agg(F.sum("_w").alias("_w")).filter(F.col("_w") >= min_samples).select(*keys, "_id", F.lit(True).alias("_c"))
    p = cut_lineage(p.join(lone, [*keys, "_id"], "left").withColumn("core", F.col("_full") | F.coalesce("_c", F.lit(False))).drop("_c"))
    core = p.filter("core")
    core_places = core.filter(~F.col("_full")).select(*cell, "x", "y").distinct()
    meets = [*keys, "_id", "qcx", "qcy", "cx", "cy"]
    reach = close.join(core_places, [*cell, "x", "y"]).select(*meets).unionByName(crowds.select(*meets))
    # Links of cells: from small cells by distance, between full cells by boxes.
    from_core = reach.join(core.select(*keys, "_id"), [*keys, "_id"], "left_semi")
    links = from_core.select(*keys, F.col("qcx").alias("acx"), F.col("qcy").alias("acy"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy")).distinct()
    links = links.unionByName(_full_cell_links(core.filter("_full"), keys, side, eps))
    roots = _components(core.select(*keys, "cx", "cy").distinct(), links, keys)
    roots = roots.select(*keys, F.col("node.cx").alias("cx"), F.col("node.cy").alias("cy"), "root")
    in_cell = core.groupBy(*keys, "cx", "cy").agg(F.min("_id").alias("_first"))
    firsts = roots.join(in_cell, [*keys, "cx", "cy"]).groupBy(*keys, "root").agg(F.min("_first").alias("_first"))
    # One row per cluster, not per point.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    names = firsts.withColumn("cluster", number).drop("_first")
    labels = cut_lineage(roots.join(names, [*keys, "root"]).select(*keys, "cx", "cy", "cluster"))
    border = reach.join(labels, [*keys, "cx", "cy"]).groupBy(*keys, "_id").agg(F.min("cluster").alias("_b"))
    out = p.join(sizes.drop("_full").join(labels, cell), slice_, "left").join(border, [*keys, "_id"], "left")
    return out.select(*keys, F.col("_id").alias(id_),
                      F.when(F.col("core"), F.col("cluster")).otherwise(F.coalesce("_b", F.lit(-1))).cast("int").alias("cluster"))


def box_clusters(boxes: DataFrame, keys: list[str], id_: str, eps: float = 100.0, min_samples: int = 3) -> DataFrame:
    """Detections with the person they belong to: clusters of box centres, noise dropped."""
    centre = boxes.withColumns({"_x": (F.col("x1") + F.col("x2")) / 2, "_y": (F.col("y1") + F.col("y2")) / 2})
    found = dbscan(centre, keys, id_, "_x", "_y", eps, min_samples).filter(F.col("cluster") >= 0)
    return boxes.join(found, [*keys, id_])
