"""Scans of the file forms the data arrives in."""

from __future__ import annotations

import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinetra.operators import reshape
from kinetra.operators.pairing import stem
from kinetra.schema import INTRINSICS_BODY, INTRINSICS_KEYS, LABEL_JSON, POSE_JSON, PREDICTION

FILE = "_metadata.file_path"


def _path() -> Column:
    return F.url_decode(F.col(FILE))


def label_json(spark: SparkSession, root: str, marker: str = "[라벨]") -> DataFrame:
    """Label documents below folders whose path carries the marker, with their path."""
    df = (spark.read.schema(LABEL_JSON).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.json").json(root))
    return df.withColumn("path", _path()).filter(F.col("path").contains(marker))


def pose_json(spark: SparkSession, root: str, first_person: bool = False, prefix: int = 9) -> DataFrame:
    """Pose rows of frame files; a folder is a swing and its files in name order are the frames.

    Files without people give no rows but keep their frame number.
    """
    from kinetra.operators.sequence import number_rows

    df = (spark.read.schema(POSE_JSON).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.json").json(root))
    parts = F.split(_path(), "/")
    df = df.select("people", F.element_at(parts, -2).alias("swing_id"), F.element_at(parts, -1).alias("file"))
    # A prefix of one length rises with the names, padded or not, and slices a long recording.
    slice_ = F.substring("file", 1, prefix)
    names = number_rows(df, ["swing_id"], [F.col("file")], slice_, "frame").withColumn("frame", F.col("frame").cast("int"))
    rows = reshape.people_to_rows(names, ["swing_id", "frame"])
    return rows.filter("person_idx = 0") if first_person else rows


def _numbered(rows: DataFrame) -> DataFrame:
    """Add `frame`: the place of a row in its file. Splits of a large file are numbered apart."""
    from kinetra.operators.sequence import number_rows

    out = number_rows(rows, ["swing_id"], [F.col("_at")], F.col("_split"), "frame")
    return out.withColumn("frame", F.col("frame").cast("int")).drop("_at", "_split")


# A row's split and its place in the read order, which follows the file within a split.
_ORDER = (F.monotonically_increasing_id, "_metadata.file_block_start")


def _cells(line: Column, sep: Column) -> Column:
    """The cells of one delimited line, stripped of blanks; quoted ones may hold the separator and doubled quotes."""
    plain = F.split(line, sep, -1)
    cell = F.concat(F.lit('( *"(?:[^"]|"")*" *|[^'), sep, F.lit("]*)("), sep, F.lit("|$)"))
    whole = F.regexp_extract_all(line, cell, F.lit(1))
    # The pattern also meets the empty end of the line, unless the last cell is empty itself.
    whole_cells = F.when(F.endswith(line, sep), whole).otherwise(F.slice(whole, F.lit(1), F.size(whole) - 1))
    cells = F.transform(F.when(F.contains(line, F.lit('"')), whole_cells).otherwise(plain), lambda c: F.trim(c))
    bare = F.transform(cells, lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(cells)


def headed_rows(lines: DataFrame, file: str, part: str, at: str, value: str = "value", names: list[str] | None = None) -> DataFrame:
    """Rows of many delimited files, each mapped by the header of its own: file, frame, and a text column per name.

    `lines` has one row per line: its file, the part of the file it was read in, its place in that part and its text. Files may
    differ in separator (comma, else tab), order and number of columns, byte-order mark, blanks and quotes; of equal names in
    one header the first counts, and a file without a name, or a line that is too short, gives null there. `names` are the columns to read;
    without them all headers are looked through once, and the union of their names is taken in order of first letters.
    `frame` is the file's own where its header has one, else the row's place. Blank lines don't count.

    Headers and row counts come from one aggregation by (file, part) and return to the rows by that key, so that a
    large file stays spread over its parts.
    """
    key = F.struct(F.col(file).alias("file"), F.col(part).alias("part"))
    rows = lines.filter(F.trim(value) != "").select(key.alias("_key"), F.col(at).alias("_at"), F.col(value).alias("_line"))
    heads = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_line", "_at").alias("_first"))
    in_file = Window.partitionBy("_key.file").orderBy("_key.part")
    heads = heads.select("_key", F.first("_first").over(in_file).alias("_head"),
                         F.coalesce(F.sum("_n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    head = F.regexp_replace("_head", "^\ufeff", "")
    sep = F.when(~F.contains(head, F.lit(",")) & F.contains(head, F.lit("\t")), F.lit("\t")).otherwise(F.lit(","))
    heads = heads.select("_key", "_before", sep.alias("_sep"), F.transform(_cells(head, sep), lambda c: F.replace(c, F.lit("\ufeff"), F.lit(""))).alias("_names"))
    if names is None:
        found = heads.select(F.explode("_names").alias("name")).distinct().filter("name <> ''").collect()  # as many as the table is wide
        names = sorted(r.name for r in found)
    # Where each wanted name stands in a header is looked up once per part, not per row.
    wanted = F.array(*[F.lit(n) for n in ("frame", *names)])
    heads = heads.select("_key", "_before", "_sep", F.transform(wanted, lambda n: F.array_position("_names", n).cast("int")).alias("_places"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_at")) - 1
    body = rows.withColumn("_local", place).join(heads, "_key").withColumn("_row", F.col("_local") + F.col("_before")).filter("_row > 0")
    cells = body.select(F.col("_key.file").alias("_file"), "_row", "_places", _cells(F.col("_line"), F.col("_sep")).alias("_cells"))
    values = F.transform("_places", lambda i: F.when(i > 0, F.nullif(F.get(F.col("_cells"), i - 1), F.lit(""))))
    values = cells.select("_file", "_row", values.alias("_values"))
    frame = F.coalesce(F.col("_values")[0].try_cast("int"), (F.col("_row") - 1).cast("int"))
    return values.select(F.col("_file").alias(file), frame.alias("frame"), *[F.col("_values")[i + 1].alias(n) for i, n in enumerate(names) if n != "frame"])


def skeleton_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Wide skeleton rows (swing_id, frame and the columns as text) of files that may each have a header of their own; see `headed_rows`."""
    lines = spark.read.text(path).select(stem(_path()).alias("swing_id"), F.col(_ORDER[1]).alias("_split"), _ORDER[0]().alias("_at"), "value")
    return headed_rows(lines, "swing_id", "_split", "_at", names=names)


def check_columns(df: DataFrame) -> None:
    missing = reshape.missing_columns(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def flat_rows(lines: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """(keys.., joint_idx, x, y, conf) of headerless text lines x1,y1,c1,..."""
    joints = reshape.flat_numbers(F.split(text, ","))
    return lines.select(*keys, F.posexplode(joints).alias("joint_idx", "_j")).select(*keys, "joint_idx", "_j.*")


def flat_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rows x1,y1,c1,...; one text file per swing, one line per frame."""
    text = spark.read.text(path).select("value", stem(_path()).alias("swing_id"), _ORDER[0]().alias("_at"),
                                        F.col(_ORDER[1]).alias("_split"))
    return flat_rows(_numbered(text), ["swing_id", "frame"])


def listed_ids(lines: DataFrame, text: str = "value") -> DataFrame:
    """One id per line, blank lines ignored."""
    return lines.select(F.trim(text).alias("id")).filter(F.col("id") != "")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return listed_ids(spark.read.text(path))


def assemble_embeddings(ids: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors of the listed ids; ids without one are dropped, missing labels read -1."""
    out = ids.join(vectors, "id").join(labels.select("id", "label"), "id", "left")
    return out.withColumn("label", F.coalesce("label", F.lit(-1)))


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of <id>.npy files, one small vector or clip matrix each, flattened."""
    def parse(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vec": [np.load(io.BytesIO(b)).astype("float32").ravel().tolist() for b in pdf["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select(stem(F.url_decode("path")).alias("id"), "content").mapInPandas(parse, "id string, vec array<float>")


def depth_values(maps: DataFrame) -> DataFrame:
    """(swing_id, frame, py, px, depth) of stored maps (swing_id, frame, content), one map at a time."""
    def parse(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            for swing, frame, content in zip(pdf["swing_id"], pdf["frame"], pdf["content"]):
                a = np.load(io.BytesIO(content)).astype("float64")
                py, px = np.indices(a.shape)
                yield pd.DataFrame({"swing_id": swing, "frame": frame, "py": py.ravel(), "px": px.ravel(), "depth": a.ravel()})

    return maps.mapInPandas(parse, "swing_id string, frame int, py int, px int, depth double")


def depth_npy(spark: SparkSession, path: str) -> DataFrame:
    """(swing_id, frame, py, px, depth) of <swing>/%06d.npy maps."""
    return depth_values(depth_maps(spark, path))


def depth_tiles(spark: SparkSession, path: str, side: int = 8) -> DataFrame:
    """(swing_id, frame, tx, ty, cells) of <swing>/%06d.npy maps: a row per tile of side x side values, NaN beyond the map's edge."""
    def parse(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            for swing, frame, content in zip(pdf["swing_id"], pdf["frame"], pdf["content"]):
                a = np.load(io.BytesIO(content)).astype("float64")
                rows, cols = (-(-n // side) for n in a.shape)
                full = np.full((rows * side, cols * side), np.nan)
                full[:a.shape[0], :a.shape[1]] = a
                tiles = full.reshape(rows, side, cols, side).swapaxes(1, 2).reshape(rows * cols, side * side)
                ty, tx = np.indices((rows, cols))
                yield pd.DataFrame({"swing_id": swing, "frame": frame, "tx": tx.ravel(), "ty": ty.ravel(), "cells": list(tiles)})

    return depth_maps(spark, path).mapInPandas(parse, "swing_id string, frame int, tx int, ty int, cells array<double>")


def depth_maps(spark: SparkSession, path: str) -> DataFrame:
    """(swing_id, frame, content) of <swing>/%06d.npy maps, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    p = F.url_decode("path")
    return files.select(F.element_at(F.split(p, "/"), -2).alias("swing_id"), stem(p).try_cast("int").alias("frame"), "content") \
        .filter(F.col("frame").isNotNull())


def media_inventory(spark: SparkSession, root: str, pattern: str = "*.mp4", leaf: str | None = None) -> DataFrame:
    """Path, length and time of media files; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    df = df.select(F.url_decode("path").alias("path"), "length", "modificationTime")
    return df.filter(F.element_at(F.split("path", "/"), -2) == leaf) if leaf else df


def intrinsics_schema() -> str:
    """Columns of an intrinsics document: every accepted key, the bare values, and the capture's own data."""
    keyed = [f"{k} {INTRINSICS_BODY.simpleString()}" for k in INTRINSICS_KEYS]
    bare = [f"{f.name} {f.dataType.simpleString()}" for f in INTRINSICS_BODY]
    return ", ".join([*keyed, "meta struct<fps:int,width:int,height:int,depth_scale:double>", *bare])


def pick_intrinsics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Camera intrinsics under any accepted key, else the document itself when it has the values."""
    own = F.when(F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull(),
                 F.struct(*[f.name for f in INTRINSICS_BODY]))
    return docs.select(*keys, F.coalesce(*[F.col(k) for k in INTRINSICS_KEYS], own).alias("k"), "meta").select(*keys, "k.*", "meta")


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(intrinsics_schema()).option("multiLine", True).json(path)
    return pick_intrinsics(df.withColumn("swing_id", F.element_at(F.split(_path(), "/"), -2)), ["swing_id"])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return prediction_rows(spark.read.schema(PREDICTION).json(path))


def prediction_rows(df: DataFrame) -> DataFrame:
    """Prediction rows with either spelling of the score column."""
    return df.select("id", "clip", F.col("gt_label").alias("gt"), F.col("pred_label").alias("pred"),
                     F.coalesce("pred_scores", "pred_score").alias("scores"))


# Names that stand for both training and validation.
BOTH_SPLITS = ("trainval", "train_and_val", "both")


def split_names(split: str) -> list[str]:
    """The splits that 'a,b' or 'a+b' names, in order."""
    out: dict[str, None] = {}
    for name in re.findall(r"[^,+\s]+", split):
        out |= dict.fromkeys(("train", "val") if name.lower() in BOTH_SPLITS else (name,))
    return list(out)


def annotation_set(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Annotation rows of the named splits, also as xsub_<name> (partitions pruned); unknown splits read everything."""
    df = spark.read.parquet(path)
    if not split:
        return df
    picked = df.filter(F.col("split").isin([f"{p}{n}" for n in split_names(split) for p in ("", "xsub_")]))
    # Only the folders of those splits are looked into.
    return df if picked.isEmpty() else picked
