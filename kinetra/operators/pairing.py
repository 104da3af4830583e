"""Joins of files, frames, annotations, predictions and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def align_strict(a: DataFrame, b: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of set 2 in the ids of set 1; a missing id fails the job."""
    found = b.withColumn("_found", F.lit(True))
    out = a.join(found, id_, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("id not in the second set: "), F.col(id_).cast("string"))).cast("string")) \
        .otherwise(F.col(id_).cast("string"))
    return out.select(checked.cast(dict(a.dtypes)[id_]).alias(id_), *[c for c in out.columns if c not in (id_, "_found")])


def align_lenient(a: DataFrame, b: DataFrame, id_: str = "id") -> DataFrame:
    """Rows whose id (as text) is in both sets."""
    return a.withColumn(id_, F.col(id_).cast("string")).join(b.withColumn(id_, F.col(id_).cast("string")), id_)


def coverage(a: DataFrame, b: DataFrame, id_: str = "id") -> DataFrame:
    """Ids in both sets and in one only."""
    l = a.select(F.col(id_).cast("string").alias(id_)).distinct().withColumn("_a", F.lit(1))
    r = b.select(F.col(id_).cast("string").alias(id_)).distinct().withColumn("_b", F.lit(1))
    return l.join(r, id_, "full_outer").agg(
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_first"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_second"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def with_media(rows: DataFrame, media: DataFrame, on: str = "stem") -> DataFrame:
    return rows.join(media.select(on), on, "left_semi")


def without_media(rows: DataFrame, media: DataFrame, on: str = "stem") -> DataFrame:
    return rows.join(media.select(on), on, "left_anti")


def unmatched_both(a: DataFrame, b: DataFrame, on: str = "stem") -> DataFrame:
    """Names on one side only, tagged with the side."""
    return without_media(a, b, on).select(on, F.lit("first").alias("side")).unionByName(
        without_media(b, a, on).select(on, F.lit("second").alias("side")))


def pair_images(labels: DataFrame, images: DataFrame, image_path: Column) -> DataFrame:
    """Each label file with the image at its rewritten path, where there is one."""
    return labels.withColumn("image_path", image_path).join(
        images.select(F.col("path").alias("image_path"), F.lit(True).alias("has_image")), "image_path", "left") \
        .withColumn("has_image", F.coalesce("has_image", F.lit(False)))


def merge_frames(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Outer join of two frame tables; columns in both are kept as <name>_l and <name>_r."""
    clash = {c for c in a.columns if c in b.columns and c not in keys}
    l = a.withColumnsRenamed({c: f"{c}_l" for c in clash})
    return l.join(b.withColumnsRenamed({c: f"{c}_r" for c in clash}), keys, "full_outer")


def match_depth_frames(frames: DataFrame, maps: DataFrame) -> DataFrame:
    """Depth map of each frame: the zero-padded number, else a name containing the number, else the
    map at that position of the sorted names, else an error row.

    frames(swing_id, frame); maps(swing_id, name, position) with `position` the sorted place.
    """
    stems = maps.withColumn("stem", stem(F.col("name")))
    exact = stems.filter(F.col("stem").rlike(r"^(\d{6}|[1-9]\d{6,})$")).select("swing_id", F.col("stem").alias("_padded"), F.col("name").alias("exact"))
    out = frames.withColumns({"_padded": F.format_string("%06d", "frame"), "_s": F.col("frame").cast("string")})
    out = out.join(exact, ["swing_id", "_padded"], "left").drop("_padded")
    # Numbers that name no map are looked for inside the names.
    open_ = out.filter(F.col("exact").isNull()).select("swing_id", F.col("_s").alias("short"))
    pairs = containing(open_, stems.select("swing_id", F.col("stem").alias("long")), ["swing_id"])
    inside = pairs.join(stems.select("swing_id", F.col("stem").alias("long"), "name"), ["swing_id", "long"]) \
        .groupBy("swing_id", F.col("short").alias("_s")).agg(F.min("name").alias("inside"))
    out = out.join(inside, ["swing_id", "_s"], "left").drop("_s")
    place = maps.select("swing_id", F.col("position").alias("frame"), F.col("name").alias("place"))
    out = out.join(place, ["swing_id", "frame"], "left")
    name = F.coalesce("exact", "inside", "place")
    return out.select("swing_id", "frame", name.alias("name"),
                      F.when(F.col("exact").isNotNull(), "exact").when(F.col("inside").isNotNull(), "contains")
                      .when(F.col("place").isNotNull(), "position").otherwise("error").alias("how"))


def depth_patch(points: DataFrame, depth: DataFrame, keys: list[str], radius: int = 2,
                width: int | None = None, height: int | None = None) -> DataFrame:
    """Median positive depth in a square around each rounded point, by a join on the keys.

    points(keys.., joint_idx, x, y); depth(keys.., px, py, depth). The few points of a frame are held and its pixels go by them in any
    order, so pixels that are partitioned by the keys already are neither shuffled nor sorted.
    """
    p = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *keys, "joint_idx", F.bround("x", 0).cast("int").alias("_x"), F.bround("y", 0).cast("int").alias("_y"))
    d = F.col("depth")
    inside = (F.col("px") >= 0) & (F.col("py") >= 0)
    if width:
        inside = inside & (F.col("px") < width)
    if height:
        inside = inside & (F.col("py") < height)
    good = depth.filter(inside & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")) & (d > 0)).select(*keys, "px", "py", "depth")
    near = (F.abs(F.col("px") - F.col("_x")) <= radius) & (F.abs(F.col("py") - F.col("_y")) <= radius)
    # At most the pixels of one square per group: sorting the short list beats a percentile buffer.
    found = good.join(p.hint("shuffle_hash"), keys).filter(near).groupBy(*keys, "joint_idx").agg(
        F.sort_array(F.collect_list("depth")).alias("_v"))
    n = F.size("_v")
    middle = (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2
    return found.select(*keys, "joint_idx", middle.alias("depth"))


def tile_of(c: Column, side: int) -> Column:
    return F.floor(c / side).cast("int")


def _pixels(points: DataFrame) -> DataFrame:
    """Points with a value and their rounded pixel (_x, _y)."""
    at = F.struct(*[F.when(~F.isnan(c), F.bround(c, 0).cast("int")).alias(f"_{c}") for c in ("x", "y")])
    # As the row of a generator, the pixel is computed once: a filter on x and y would be moved down and repeat what they are made of.
    return points.select("*", F.inline(F.array(at))).filter("_x IS NOT NULL AND _y IS NOT NULL")


def touched_tiles(points: DataFrame, radius: int, side: int) -> DataFrame:
    """Points with a value, their rounded pixel (_x, _y), and one row for each tile that the square around it touches (tx, ty)."""
    p = _pixels(points)
    for c, t in (("_x", "tx"), ("_y", "ty")):
        p = p.withColumn(t, F.explode(F.sequence(tile_of(F.col(c) - radius, side), tile_of(F.col(c) + radius, side))))
    return p


def depth_patch_tiles(points: DataFrame, tiles: DataFrame, keys: list[str], radius: int = 2, side: int = 8) -> DataFrame:
    """As `depth_patch`, on depth that is stored as tiles: a tile is one row, and no pixel becomes one.

    points(keys.., joint_idx, x, y); tiles(keys.., tx, ty, cells): the tile's `side` rows of `side` values, one after the other. The few points
    of a frame are held and its tiles go by them in any order, so tiles that are partitioned by the keys already are neither shuffled nor
    sorted; rows of the square are cut out of the tile's array, and the pieces of a point meet for the median. Points without a
    positive depth give no row.
    """
    p = _pixels(points).select(*keys, "joint_idx", "_x", "_y")
    touch = F.lit(True)
    for t, c in (("tx", "_x"), ("ty", "_y")):
        touch = touch & F.col(t).between(tile_of(F.col(c) - radius, side), tile_of(F.col(c) + radius, side))
    joined = tiles.join(p.hint("shuffle_hash"), keys).filter(touch)
    x0, x1 = (f(F.col("_x") + d - F.col("tx") * side, F.lit(e)) for f, d, e in ((F.greatest, -radius, 0), (F.least, radius, side - 1)))
    y0, y1 = (f(F.col("_y") + d - F.col("ty") * side, F.lit(e)) for f, d, e in ((F.greatest, -radius, 0), (F.least, radius, side - 1)))
    joined = joined.select(*keys, "joint_idx", "cells", x0.alias("_x0"), x1.alias("_x1"), F.sequence(y0, y1).alias("_rows"))
    piece = F.flatten(F.transform("_rows", lambda r: F.slice("cells", r * side + F.col("_x0") + 1, F.col("_x1") - F.col("_x0") + 1)))
    good = F.filter(piece, lambda d: d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf")))
    met = joined.select(*keys, "joint_idx", good.alias("_v")).groupBy(*keys, "joint_idx").agg(F.sort_array(F.flatten(F.collect_list("_v"))).alias("_v"))
    n = F.size("_v")
    middle = (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2
    return met.filter(n > 0).select(*keys, "joint_idx", middle.alias("depth"))


def depth_patch_maps(points: DataFrame, maps: DataFrame, keys: list[str], radius: int = 2) -> DataFrame:
    """As `depth_patch`, read straight from stored maps: maps(keys.., content) holds one .npy each.

    The joints of a frame travel to its map and no pixel becomes a row.
    """
    joints = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys).agg(
        F.collect_list(F.struct("joint_idx", F.bround("x", 0).cast("int").alias("px"), F.bround("y", 0).cast("int").alias("py"))).alias("_j"))

    def read(batches):
        import io

        import numpy as np
        import pandas as pd
        for pdf in batches:
            rows = []
            for *key, found, content in pdf[[*keys, "_j", "content"]].itertuples(index=False, name=None):
                a = np.load(io.BytesIO(content)).astype("float64")
                for j in found:
                    x, y = j["px"], j["py"]
                    p = a[max(y - radius, 0):max(y + radius + 1, 0), max(x - radius, 0):max(x + radius + 1, 0)]
                    p = p[np.isfinite(p) & (p > 0)]
                    if p.size:
                        rows.append((*key, j["joint_idx"], float(np.median(p))))
            yield pd.DataFrame(rows, columns=[*keys, "joint_idx", "depth"])

    types = dict(points.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["joint_idx int", "depth double"])
    return joints.join(maps.select(*keys, "content"), keys).mapInPandas(read, schema)


#: Length of the pieces that containment is looked up by; shorter texts are looked up whole.
GRAM = 8


def _grams(text: Column, length: Column) -> Column:
    """Distinct pieces of a text of one length."""
    starts = F.when((length > 0) & (F.length(text) >= length), F.sequence(F.lit(1), F.length(text) - length + 1))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length))), F.array().cast("array<string>"))


def containing(short: DataFrame, long: DataFrame, keys: list[str], gram: int = GRAM) -> DataFrame:
    """(keys.., short, long) for each distinct short text that a distinct long one of the same keys contains.

    short(keys.., short); long(keys.., long). Long texts are indexed by their pieces of `gram` characters, and of the
    lengths of shorter texts, so the index grows with their characters. A short text is looked up by its rarest piece alone, and the
    few long texts that have it are then searched for the whole. Empty and missing texts are contained nowhere.
    """
    short = short.select(*keys, "short").filter(F.length("short") > 0).distinct()
    long = long.select(*keys, "long").filter(F.length("long") > 0).distinct()
    # The lengths in use are at most `gram` numbers and reach all rows as one value.
    lengths = short.agg(F.collect_set(F.least(F.length("short"), F.lit(gram)))).scalar()
    index = long.withColumn("_n", lengths).select(
        *keys, "long", F.explode(F.flatten(F.transform("_n", lambda n: _grams(F.col("long"), n)))).alias("_gram"))
    wanted = short.select(*keys, "short", F.explode(_grams(F.col("short"), F.least(F.length("short"), F.lit(gram)))).alias("_gram"))
    index = index.join(wanted.select(*keys, "_gram").distinct(), [*keys, "_gram"], "left_semi")
    seen = index.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_seen"))
    # A piece that no long text has rules the short one out.
    found = wanted.join(seen, [*keys, "_gram"], "left").groupBy(*keys, "short").agg(
        F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_rarest"))
    found = found.filter(F.col("_rarest.n") > 0).select(*keys, "short", F.col("_rarest.gram").alias("_gram"))
    return found.join(index, [*keys, "_gram"]).filter(F.contains("long", "short")).select(*keys, "short", "long")


def match_predictions(annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Prediction of each annotation id: equal id, else the first (by seq) whose id contains it.

    annotations(id, ..); predictions(id, seq, pred).
    """
    p = predictions.groupBy("id").agg(F.min(F.struct("seq", "pred")).alias("_first"))
    out = annotations.join(p.withColumn("_hit", F.lit(True)), "id", "left")
    open_ids = out.filter(F.col("_hit").isNull()).select(F.col("id").alias("short"))
    pairs = containing(open_ids, p.select(F.col("id").alias("long")), [])
    inside = pairs.join(p.withColumnRenamed("id", "long"), "long").groupBy(F.col("short").alias("id")).agg(F.min("_first").alias("_in"))
    out = out.join(inside, "id", "left")
    return out.withColumn("pred", F.when(F.col("_hit"), F.col("_first.pred")).otherwise(F.col("_in.pred"))).drop("_first", "_hit", "_in")


def match_by_position(annotations: DataFrame, predictions: DataFrame, position: str = "seq") -> DataFrame:
    """Predictions without ids: the one at the annotation's place in the list."""
    return annotations.join(predictions.select(position, "pred"), position, "left")


def resume(items: DataFrame, manifest: DataFrame, path: str = "video_path") -> DataFrame:
    """Items not yet done; failed ones come back."""
    return items.join(manifest.filter(F.col("status") == "done").select(path), path, "left_anti")


def latest_manifest(events: DataFrame, path: str = "video_path", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Manifest after applying all upserts: the last row per path."""
    rest = [c for c in events.columns if c != path]
    return events.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(path, "_r.*")


def resolve_originals(backups: DataFrame, files: DataFrame) -> DataFrame:
    """Original of each backup at <cls>/<rel>, else true/<cls>/<rel>. backups(cls, rel); files(path)."""
    direct = F.concat_ws("/", "cls", "rel")
    nested = F.concat_ws("/", F.lit("true"), "cls", "rel")
    a = files.select(F.col("path").alias("_p1"), F.col("path").alias("_direct"))
    b = files.select(F.col("path").alias("_p2"), F.col("path").alias("_nested"))
    out = backups.withColumns({"_p1": direct, "_p2": nested}).join(a, "_p1", "left").join(b, "_p2", "left")
    return out.withColumn("original", F.coalesce("_direct", "_nested")).drop("_p1", "_p2", "_direct", "_nested")


def merge_inference(jobs: DataFrame, responses: DataFrame, id_: str = "job_id") -> DataFrame:
    """Job document with the response's result, or the whole response where it has none."""
    body = F.coalesce(F.get_json_object("response", "$.result"), F.col("response"))
    return jobs.join(responses.select(id_, body.alias("inference")), id_, "left")


def labels_of(ids: DataFrame, annotations: DataFrame, id_: str = "frame_dir") -> DataFrame:
    """Labels of listed ids, unknown ids dropped."""
    return ids.join(annotations.select(id_, "label"), id_)


def dataset_diff(a: DataFrame, b: DataFrame, id_: str, cols: list[str]) -> DataFrame:
    """Ids whose presence or columns differ between two annotation sets."""
    l = a.select(id_, F.struct(*cols).alias("_a"))
    r = b.select(id_, F.struct(*cols).alias("_b"))
    out = l.join(r, id_, "full_outer")
    diff = [(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(f"{c}_differs") for c in cols]
    out = out.select(id_, F.col("_a").isNotNull().alias("in_first"), F.col("_b").isNotNull().alias("in_second"), *diff)
    cond = ~F.col("in_first") | ~F.col("in_second")
    for c in cols:
        cond = cond | F.col(f"{c}_differs")
    return out.filter(cond)
