"""Tidy, wide and nested forms of pose data, and joint vocabularies."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetra.operators.sequence import BLK, CORE, Sequence
from kinetra.schema import KP17, MEDIAPIPE33, OPENPOSE18, VOCABULARIES

WIDE_AXES = {"x": "x", "y": "y", "c": "conf", "X": "X3", "Y": "Y3", "Z": "Z3"}


def wide_name(joint: str, axis: str) -> str:
    """Column of a joint axis in the wide form; Spark names ignore case, so 3D axes read X3."""
    return f"{joint}_{axis}3" if axis in "XYZ" else f"{joint}_{axis}"


def tidy_to_wide(
    df: DataFrame, joints: list[str] | None = None, axes: str = "xycXYZ", seq: Sequence | None = None,
    row_order: str | None = None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per frame with a column per joint axis; unused columns cost nothing.

    Rows laid out by `seq` are grouped inside their block without another shuffle. Of duplicate
    (frame, joint) rows the last by `row_order` wins. `extra` adds aggregates over all joints.
    """
    joints = joints or KP17
    keys = list(seq.keys) if seq else ["swing_id"]
    group = [*keys, "frame"] + [c for c in (BLK, CORE) if c in df.columns]
    out = []
    for j in joints:
        idx = KP17.index(j) if j in KP17 else int(j[1:])
        for a in axes:
            src = WIDE_AXES[a]
            if src not in df.columns:
                continue
            v = F.when(F.col("joint_idx") == idx, F.col(src))
            agg = F.max(v) if row_order is None else F.max_by(F.col(src), F.when(F.col("joint_idx") == idx, F.col(row_order)))
            out.append(agg.alias(wide_name(j, a)))
    return df.groupBy(*group).agg(*out, *[e.alias(n) for n, e in (extra or {}).items()])


def wide_to_long(df: DataFrame, keys: list[str], joints: list[str], axes: str = "xyc") -> DataFrame:
    """One row per joint; column names match without regard to case, missing joints read zero."""
    have = {c.lower(): c for c in df.columns}

    def value(j: str, a: str) -> Column:
        c = have.get(f"{j}_{a}".lower())
        return F.col(c).cast("double") if c else F.lit(0.0)

    rows = [F.struct(F.lit(i).alias("joint_idx"), F.lit(j).alias("joint"),
                     *[value(j, a).alias("conf" if a == "c" else a) for a in axes]) for i, j in enumerate(joints)]
    return df.select(*keys, F.inline(F.array(*rows)))


def people_to_rows(df: DataFrame, keys: list[str], people: str = "people") -> DataFrame:
    """Nested people lists of flat (x, y, conf, ...) numbers to one row per joint."""
    person = df.select(*keys, F.posexplode(people).alias("person_idx", "_p"))
    flat = F.col("_p.pose_keypoints_2d")
    triples = F.transform(
        F.when(F.size(flat) >= 3, F.sequence(F.lit(0), F.floor(F.size(flat) / 3).cast("int") - 1)),
        lambda i: F.slice(flat, i * 3 + 1, F.lit(3)))
    rows = person.select(*keys, "person_idx", F.posexplode(triples).alias("joint_idx", "_t"))
    return rows.select(*keys, "person_idx", "joint_idx", F.col("_t")[0].alias("x"), F.col("_t")[1].alias("y"),
                       F.col("_t")[2].alias("conf"))


def joint_map(spark: SparkSession) -> DataFrame:
    """(vocab, src_idx, joint_idx) from every vocabulary to the 17 joints; others are not listed."""
    rows = [(v, i, KP17.index(j), j) for v, names in VOCABULARIES.items() for i, j in enumerate(names) if j in KP17]
    return spark.createDataFrame(rows, "vocab string, src_idx int, joint_idx int, joint string")


def remap_joints(df: DataFrame, vocab: str) -> DataFrame:
    """Indices of a vocabulary to the 17 joints; joints without a counterpart (Neck) are dropped."""
    pairs = [(i, KP17.index(j)) for i, j in enumerate(VOCABULARIES[vocab]) if j in KP17]
    lookup = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return df.withColumn("joint_idx", lookup[F.col("joint_idx")]).filter(F.col("joint_idx").isNotNull())


def remap_detected(df: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """Swings with a joint index of 17 or more are read as 18 joints, others as the 17 joints."""
    pairs = [(i, KP17.index(j)) for i, j in enumerate(OPENPOSE18) if j in KP17]
    lookup = F.create_map(*[F.lit(x) for p in pairs for x in p])
    out = seq.attach(seq.lay_out(df), {"_top": F.max("joint_idx")})
    idx = F.when(F.col("_top") >= 17, lookup[F.col("joint_idx")]).otherwise(F.col("joint_idx"))
    return seq.done(out.withColumn("joint_idx", idx).drop("_top").filter(F.col("joint_idx").isNotNull()))


def rename_landmarks(df: DataFrame) -> DataFrame:
    """landmark_<i>_<axis> columns to joint names."""
    names = {f"landmark_{i}_{a}": f"{n}_{a}" for i, n in enumerate(MEDIAPIPE33) for a in "xyz"}
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def virtual_joints(df: DataFrame) -> DataFrame:
    """Neck and MidHip of a wide 2D table, where both sides are present."""
    new = {}
    for name, (l, r) in {"Neck": ("LShoulder", "RShoulder"), "MidHip": ("LHip", "RHip")}.items():
        for a in "xy":
            new[f"{name}_{a}"] = (F.col(f"{l}_{a}") + F.col(f"{r}_{a}")) / 2
    return df.withColumns(new)


def flat_numbers(cells: Column) -> Column:
    """A headerless row of text cells to joints: triples, else pairs, else 25 zero joints."""
    nums = F.filter(F.transform(cells, lambda c: c.try_cast("double")),
                    lambda v: v.isNotNull())
    n = F.size(nums)

    def chunks(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(n / k).cast("int") - 1), lambda i: F.struct(
            F.element_at(nums, i * k + 1).alias("x"), F.element_at(nums, i * k + 2).alias("y"),
            (F.element_at(nums, i * k + 3) if k == 3 else F.lit(None).cast("double")).alias("conf")))

    zero = F.array_repeat(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("conf")), 25)
    return F.when((n > 0) & (n % 3 == 0), chunks(3)).when((n > 0) & (n % 2 == 0), chunks(2)).otherwise(zero)


def _whole(rows: DataFrame, keys: list[str], frame: str, entry: Column, block: int) -> DataFrame:
    """keys and `_e`, the entries of all frames in order; blocks of frames are sorted first and then joined up."""
    blocks = rows.groupBy(*keys, F.floor(F.col(frame) / block).alias("_b")).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return blocks.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_e"))), lambda p: p["_e"])).alias("_e"))


def assemble_tensor(df: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Pose rows to keypoint[1][T][V][2] and keypoint_score[1][T][V], one row per sample of any length."""
    frame = df.groupBy(*keys, "frame").agg(
        F.sort_array(F.collect_list(F.struct("joint_idx", "x", "y", F.coalesce("conf", F.lit(1.0)).alias("conf")))).alias("_j"))
    out = _whole(frame, keys, "frame", F.struct("frame", "_j"), block)
    xy = F.transform("_e", lambda f: F.transform(f["_j"], lambda j: F.array(j["x"].cast("float"), j["y"].cast("float"))))
    sc = F.transform("_e", lambda f: F.transform(f["_j"], lambda j: j["conf"].cast("float")))
    return out.select(*keys, F.array(xy).alias("keypoint"), F.array(sc).alias("keypoint_score"), F.size("_e").alias("total_frames"))


def frame_map(df: DataFrame, keys: list[str], cols: list[str], frame: str = "frame", block: int = 4096) -> DataFrame:
    """Rows to one {"<frame>": {col: value or null}} per sequence as JSON text, in frame order."""
    entry = F.struct(F.col(frame).alias("_o"), F.col(frame).cast("string").alias("key"), F.struct(*cols).alias("value"))
    m = F.map_from_entries(F.transform("_e", lambda e: F.struct(e["key"], e["value"])))
    return _whole(df, keys, frame, entry, block).select(*keys, F.to_json(m, {"ignoreNullFields": "false"}).alias("document"))


def pick_timeseries(doc: Column) -> Column:
    """The first *timeseries* entry of a map of frame maps, else its first entry."""
    keys = F.map_keys(doc)
    named = F.filter(keys, lambda k: k.contains("timeseries"))
    return F.element_at(doc, F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(keys, F.lit(1))))


def flatten_document(df: DataFrame, keys: list[str], doc: str, value: str) -> DataFrame:
    """metrics_data text {"name": {"<frame>": {...}}} to one row per frame; `value` is a DDL struct."""
    parsed = F.from_json(F.col(doc), f"map<string, map<string, {value}>>")
    out = df.select(*keys, F.explode(pick_timeseries(parsed)).alias("frame", "_v"))
    return out.select(*keys, F.col("frame").cast("int").alias("frame"), "_v.*")


def person_points(annotations: Column, strict: bool = False) -> Column:
    """(x, y) pairs of the first person annotation, from flat triples or from pairs."""
    person = F.try_element_at(F.filter(annotations, lambda a: (a["class"] == "person") & a["points"].isNotNull()), F.lit(1))
    flat = F.from_json(person["points"], "array<double>")
    pairs = F.from_json(person["points"], "array<array<double>>")
    n = F.size(flat)
    triples = F.transform(F.when(n >= 3, F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1)),
                          lambda i: F.struct(F.get(flat, i * 3).alias("x"), F.get(flat, i * 3 + 1).alias("y")))
    numeric = F.forall(flat, lambda v: v.isNotNull())
    is_pairs = F.forall(pairs, lambda p: F.size(p) == 2)
    from_pairs = F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.when((n > 0) & numeric & (n % 3 == 0), triples).when(is_pairs & (F.size(pairs) > 0), from_pairs)


# How axis columns may end.
_AXIS_NAME = re.compile(r"(?P<joint>.+?)(?:_(?P<deep>[XYZ])3D|__(?P<double>[xyz])|_(?P<upper>[XYZ])|_(?P<lower>[xyz]))")
_FAMILY_OF = {"deep": "_X3D", "double": "__x", "upper": "_X", "lower": "_x"}


def resolve_axes(columns: list[str], prefer_2d: bool = False) -> dict[str, dict[str, str]]:
    """Which columns hold x, y, z of each joint.

    Every name is read once into joint, family and axis; a joint takes its best family that has x and y. The longest
    ending counts, so `Nose__x` is joint Nose.
    """
    best = ["_x", "__x", "_X", "_X3D"] if prefer_2d else ["_X3D", "__x", "_X", "_x"]
    read: dict[str, dict[str, dict[str, str]]] = defaultdict(lambda: defaultdict(dict))
    for name in columns:
        if m := _AXIS_NAME.fullmatch(name):
            kind = m.lastgroup
            read[m["joint"]][_FAMILY_OF[kind]][m[kind].lower()] = name
    whole = {joint: [f for f in best if {"x", "y"} <= families.get(f, {}).keys()] for joint, families in read.items()}
    return {joint: dict(sorted(read[joint][usable[0]].items())) for joint, usable in whole.items() if usable}


# Joint names by lower-case base name, and what measured quantities are called.
CANONICAL = {n.lower(): n for n in [*KP17, "Neck", "Chest", "MidHip"]}
QUANTITIES = {"x": "x", "y": "y", "c": "c", "conf": "c", "score": "c"}


def canonical_names(columns: list[str]) -> dict[str, str]:
    """Old to new name of joint columns; other columns are left out."""
    split = {name: name.lower().rpartition("_") for name in columns}
    return {name: f"{CANONICAL.get(base, base.capitalize())}_{QUANTITIES[q]}" for name, (base, bar, q) in split.items() if bar and q in QUANTITIES}


def sanitise(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Exactly 51 columns: per joint the first alias present; confidence defaults to zero."""
    have = {c.lower(): c for c in reversed(df.columns)}
    cols = []
    for j in KP17:
        for a, aliases in (("x", ("__x", "_x")), ("y", ("__y", "_y")), ("c", ("__c", "_c", "_conf", "_score"))):
            src = next((have[(j + s).lower()] for s in aliases if (j + s).lower() in have), None)
            v = F.col(f"`{src}`").try_cast("double") if src else F.lit(None).cast("double")
            cols.append((F.coalesce(v, F.lit(0.0)) if a == "c" else v).alias(f"{j}_{a}"))
    return df.select(*keep, *cols)


def missing_columns(columns: list[str]) -> list[str] | None:
    clean = {c.strip().replace("﻿", "") for c in columns}
    missing = [f"{j}_{a}" for j in KP17 for a in "xyc" if f"{j}_{a}" not in clean]
    return missing or None
