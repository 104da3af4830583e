"""Swing metrics: each takes pose rows and gives one summary row per swing and one row per frame."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import _load_from_socket

from kinetra.functions import rules
from kinetra.operators import kinematics as K
from kinetra.operators.clean import primary_person, speed_units, three_dimensional, unit_scale
from kinetra.operators.reshape import frame_map, tidy_to_wide
from kinetra.operators import sequence
from kinetra.operators.sequence import Sequence, cut_lineage
from kinetra.schema import Params


@dataclass
class MetricResult:
    summary: DataFrame
    frames: DataFrame


Metric = Callable[[DataFrame, Params, Sequence], MetricResult]


def by_length(metric: Metric) -> Metric:
    """Lets each swing have its own layout: windows over whole swings where they fit a block, blocks for longer ones.

    `on_parts` takes the parts of a table that several metrics share.
    """
    def on_parts(parts: list[tuple[DataFrame, Sequence]], p: Params) -> MetricResult:
        out = [metric(rows, p, seq) for rows, seq in parts]
        return out[0] if len(out) == 1 else MetricResult(out[0].summary.unionByName(out[1].summary), out[0].frames.unionByName(out[1].frames))

    @wraps(metric)
    def run(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
        return on_parts(seq.parts(pose), p)

    run.on_parts = on_parts
    return run


def _wide(pose: DataFrame, seq: Sequence, joints: list[str], axes: str, before: int, after: int = 0,
          extra: dict[str, Column] | None = None) -> DataFrame:
    """Wide frames of the first person: one shuffle serves the pivot and the windows after it."""
    laid = seq.lay_out(primary_person(pose), before, after, gather=True)
    return tidy_to_wide(laid, joints, axes, seq, extra=extra)


def _axes(p: Params) -> tuple[str, str]:
    """Wide axes and the suffix of the lateral one."""
    return ("XYZ", "X3") if p.dimension == "3d" else ("xy", "x")


def _stance(laid: DataFrame, x: str) -> DataFrame:
    return laid.withColumns({
        "stance_mid_x": (F.col(f"RAnkle_{x}") + F.col(f"LAnkle_{x}")) / 2,
        "stance_inst": F.abs(F.col(f"RAnkle_{x}") - F.col(f"LAnkle_{x}"))})


@by_length
def com_speed(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
    raw = ("X3", "Y3", "Z3") if p.dimension == "3d" else ("x", "y")
    axes = [f"com_{a[0].lower()}" for a in raw]
    laid = _wide(pose, seq, [], "", 1, extra=K.centre_of_mass(raw))
    frames = K.speed(laid, seq, {"com_speed": axes}, p.fps)
    if p.dimension != "3d":
        frames = frames.withColumn("com_z", F.lit(None).cast("double"))
    summary = seq.summarise(frames, {"mean_com_speed": F.avg("com_speed"), "max_com_speed": F.max("com_speed")})
    return MetricResult(summary.withColumn("unit", F.lit(K.speed_unit(p.dimension, p.fps))),
                        seq.done(frames).select(*seq.keys, "frame", "com_speed", "com_x", "com_y", "com_z"))


@by_length
def com_shift(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
    axes, x = _axes(p)
    joints = ["LAnkle", "RAnkle", "RWrist", "LShoulder", "RShoulder", "LHip", "RHip"]
    laid = _stance(_wide(pose, seq, joints, axes, 1), x)
    torso = [F.col(f"{j}_{x}") for j in ("LShoulder", "RShoulder", "LHip", "RHip")]
    n = sum((c.isNotNull().cast("int") for c in torso), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in torso), F.lit(0.0))
    laid = laid.withColumn("com_rel_x", F.when(n > 0, total / n) - F.col("stance_mid_x"))
    wrist = f"RWrist_{x}"
    laid = laid.withColumn("_cross", K.strict_crossing(wrist, "stance_mid_x", seq.window()))
    laid = K.find_impact(laid, seq, F.col("_cross"), wrist)
    before = F.col("frame") <= F.col("impact")
    if p.dimension == "3d":
        laid = K.widen(laid, seq, 1, 0)
        laid = K.choose_plane(K.xfactor_series(laid, seq, clip=False, gaps=p.angle_gaps), seq)
        top_of = F.abs("xf")
    else:
        laid = laid.withColumns({"plane": F.lit("2D"), "xf": F.lit(None).cast("double")})
        top_of = F.abs("com_rel_x")
    laid = seq.attach(laid, {"_top": K.first_max(top_of, among=before), "_addr": K.few_rows("com_rel_x", F.col("frame") < 5)},
                      {"stance_width": (F.col("stance_inst"), 0.5)})
    laid = laid.withColumns({"_top": F.coalesce("_top", F.lit(0)), "_addr": K.mean_in_order(F.col("_addr"))})
    laid = K.find_transition(laid, seq, "com_rel_x", "_top", "impact")
    rel = F.col("com_rel_x")
    out = seq.summarise(laid, {
        "impact_frame": F.max("impact"), "backswing_top_frame": F.max("_top"), "transition_frame": F.max("transition"),
        "chosen_plane": F.max("plane"), "stance_width": F.max("stance_width"), "addr_com_x": F.max("_addr"),
        "back_at_top_com_x": F.max(F.when(F.col("frame") == F.col("_top"), rel)),
        "impact_com_x": F.max(F.when(F.col("frame") == F.col("impact"), rel)),
        "_rms": F.sqrt(F.avg(F.when(F.col("frame") < F.col("impact"), F.pow(rel - F.col("_addr"), F.lit(2)))))})
    width = F.when(F.col("stance_width") != 0, F.col("stance_width"))

    def pct(a: str, b: str) -> Column:
        return 100.0 * (F.col(a) - F.col(b)) / width

    out = out.withColumns({
        "back_shift_pct": pct("back_at_top_com_x", "addr_com_x"), "down_shift_pct": pct("impact_com_x", "back_at_top_com_x"),
        "impact_offset_pct": pct("impact_com_x", "addr_com_x"),
        "rms_pct": F.when(F.col("impact_frame") > 0, 100.0 * F.col("_rms") / width)}).drop("_rms")
    out = out.withColumns({"back_shift_grade": rules.back_shift_grade(F.col("back_shift_pct")),
                           "down_shift_grade": rules.down_shift_grade(F.col("down_shift_pct"))})
    frames = seq.done(laid).select(*seq.keys, "frame", F.col("xf").alias("xfactor_deg"), "stance_mid_x", "com_rel_x")
    return MetricResult(out, frames)


@by_length
def head_speed(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
    """Head speed and stability, movement before impact, wrist chosen by trend."""
    axes, x = _axes(p)
    y = "Y3" if p.dimension == "3d" else "y"
    h = p.head_joint
    laid = _stance(_wide(pose, seq, [h, "LAnkle", "RAnkle", "LWrist", "RWrist"], axes, 1), x)
    w = seq.window()
    point = [f"{h}_{a}3" if p.dimension == "3d" else f"{h}_{a}" for a in axes]
    laid = laid.withColumn("deviation", F.coalesce(K.step_length(point, w), F.lit(0.0)))
    laid = K.speed(laid, seq, {"head_speed": point}, p.fps)
    laid = K.displacement(laid, seq, f"{h}_{x}", f"{h}_{y}")
    laid = seq.attach(laid, {"_top": F.max("frame")}, {"stance_width": (F.col("stance_inst"), 0.5)})
    n = F.col("_top") + 1
    skip = max(p.skip_ratio, 0.2)
    laid = laid.withColumn("_start", F.floor(n * F.lit(skip)).cast("int"))
    tail = F.col("frame") >= F.least(F.col("_start"), F.greatest(n - 3, F.lit(0)))
    wrists = {"R": f"RWrist_{x}", "L": f"LWrist_{x}"}
    # The gap fill is taken inside the tail: earlier frames neither give nor take values.
    laid = laid.withColumns({f"_t{s}": F.when(tail, F.col(c)) for s, c in wrists.items()})
    laid = K.fill_linear(laid, seq, {f"_f{s}": f"_t{s}" for s in wrists})
    laid = seq.attach(laid, {f"slope_{s}": F.regr_slope(F.when(tail, F.col(f"_f{s}")), F.when(tail, F.col("frame").cast("double")))
                             for s in wrists})
    right = F.coalesce("slope_R", F.lit(-1e9)) >= F.coalesce("slope_L", F.lit(-1e9))
    laid = laid.withColumns({"selected_wrist": F.when(right, "RWrist").otherwise("LWrist"),
                             "wrist_x": F.when(right, F.col(wrists["R"])).otherwise(F.col(wrists["L"]))})
    laid = K.widen(laid, seq, 1, 0)
    hit = K.above_and_rising("wrist_x", "stance_mid_x", seq.window()) & (F.col("frame") >= F.greatest(F.lit(1), F.col("_start")))
    laid = K.find_impact(laid, seq, hit, "wrist_x")
    d = F.when(F.col("frame") <= F.col("impact"), F.col("head_disp"))
    out = seq.summarise(laid, {
        "mean_head_speed": F.avg("head_speed"), "max_head_speed": F.max("head_speed"),
        "avg_deviation": F.avg("deviation"), "max_deviation": F.max("deviation"),
        "stability_score": 1.0 / (1.0 + F.stddev_pop("deviation")),
        "impact_frame": F.max("impact"), "selected_wrist": F.max("selected_wrist"),
        "stance_width_med": F.max("stance_width"), "_max": F.max(d), "_rms": F.sqrt(F.avg(d * d))})
    width = F.when(F.col("stance_width_med") > 0, F.col("stance_width_med"))
    out = out.withColumns({"disp_max_pct": F.col("_max") / width * 100.0, "disp_rms_pct": F.col("_rms") / width * 100.0,
                           "unit": F.lit(K.speed_unit(p.dimension, p.fps))}).drop("_max", "_rms")
    out = out.withColumn("grade", rules.head_grade(F.col("disp_max_pct")))
    frames = seq.done(laid).select(
        *seq.keys, "frame", *[F.col(c).alias(f"head_{a.lower()}") for c, a in zip(point, axes)],
        *[F.col(f"{s}Wrist_{q}").alias(f"{s.lower()}wrist_{a.lower()}") for s in "LR"
          for a, q in ((a, f"{a}3" if p.dimension == "3d" else a) for a in axes)],
        "head_speed", "head_dx", "head_dy", "head_disp",
        (F.col("head_disp") / F.when(F.col("stance_width") > 0, F.col("stance_width")) * 100.0).alias("head_disp_pct"))
    return MetricResult(out, frames)


PAIRS = [("LShoulder", "RShoulder"), ("LHip", "RHip"), ("LAnkle", "RAnkle")]


@sequence.by_length
def pair_calibration(pose: DataFrame, seq: Sequence, joint_a: str, joint_b: str, real_length_m: float) -> DataFrame:
    """Metres per pixel from the median distance of two joints of known length."""
    laid = _wide(pose, seq, [joint_a, joint_b], "xy", 0)
    laid = K.fill_linear(laid, seq, {f"{j}_{a}": f"{j}_{a}" for j in (joint_a, joint_b) for a in "xy"})
    d = F.sqrt(F.pow(F.col(f"{joint_a}_x") - F.col(f"{joint_b}_x"), 2) + F.pow(F.col(f"{joint_a}_y") - F.col(f"{joint_b}_y"), 2))
    laid = seq.attach(laid, quantiles={"px": (F.when(d > 0, d), 0.5)})
    return seq.summarise(laid, {"px_median": F.max("px")}).withColumn("m_per_px", F.lit(real_length_m) / F.col("px_median"))


@sequence.by_length
def auto_calibration(pose: DataFrame, p: Params, seq: Sequence) -> DataFrame:
    """Metres per pixel from the widest, then steadiest, of three joint pairs; the real length is the
    shoulder width whichever pair is used."""
    joints = [j for pair in PAIRS for j in pair]
    laid = _wide(pose, seq, joints, "xy", 0)
    cols = [f"{j}_{a}" for j in joints for a in "xy"]
    laid = K.fill_linear(laid, seq, {c: c for c in cols})
    dist = {}
    for i, (a, b) in enumerate(PAIRS):
        d = F.sqrt(F.pow(F.col(f"{a}_x") - F.col(f"{b}_x"), 2) + F.pow(F.col(f"{a}_y") - F.col(f"{b}_y"), 2))
        dist[f"_d{i}"] = F.when(d > 0, d)
    laid = seq.attach(laid.withColumns(dist).drop(*cols), quantiles={f"_m{i}": (F.col(f"_d{i}"), 0.5) for i in range(3)})
    laid = seq.attach(laid, quantiles={f"_a{i}": (F.abs(F.col(f"_d{i}") - F.col(f"_m{i}")), 0.5) for i in range(3)})
    out = seq.summarise(laid, {f"{k}{i}": F.max(f"{k}{i}") for k in ("_m", "_a") for i in range(3)})
    best = F.array_min(F.array(*[
        F.when(F.col(f"_m{i}").isNotNull(), F.struct(
            (-F.col(f"_m{i}")).alias("m"), F.when(F.col(f"_m{i}") > 1e-6, F.col(f"_a{i}") / F.col(f"_m{i}")).otherwise(1e9).alias("cv"),
            F.lit(i).alias("o"), F.lit(f"{a}-{b}").alias("pair"))) for i, (a, b) in enumerate(PAIRS)]))
    if p.shoulder_width_m is not None:
        real = p.shoulder_width_m
    elif p.height_m is not None and p.height_m > 0:
        real = 0.259 * p.height_m
    else:
        real = 0.40
    return out.select(*seq.keys, best["pair"].alias("pair"), (-best["m"]).alias("px_median"), best["cv"].alias("cv"),
                      (F.lit(real) / -best["m"]).alias("m_per_px"))


@by_length
def swing_speed(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
    """Wrist speed, its peak around impact and the estimated club head speed; grip midpoint."""
    axes, x = _axes(p)
    j = p.wrist
    laid = _stance(_wide(pose, seq, ["LWrist", "RWrist", "LAnkle", "RAnkle"], axes, 1), x)
    q = [f"{a}3" if p.dimension == "3d" else a for a in axes]
    laid = laid.withColumn("_cross", K.strict_crossing(f"{j}_{x}", "stance_mid_x", seq.window()))
    if p.dimension == "3d":
        laid = K.speed(laid, seq, {f"{s.lower()}wrist_speed": [f"{s}Wrist_{a}" for a in q] for s in "LR"}, None)
    laid = K.find_impact(laid, seq, F.col("_cross"), f"{j}_{x}")
    fps = float(p.fps) if p.fps and p.fps > 0 else 30.0
    if p.dimension == "3d":
        laid = K.fill_linear(laid, seq, {f"_i{a}": f"{j}_{a}" for a in q})
        laid = K.widen(laid, seq, 1, 0)
        scale = unit_scale(F.lit(p.coord_unit))
        move = K.step_length([f"_i{a}" for a in q], seq.window()) * scale * fps
        has = F.col(f"_i{q[0]}").isNotNull() & F.col(f"_i{q[1]}").isNotNull() & F.col(f"_i{q[2]}").isNotNull()
        laid = seq.core(laid.withColumn("v_m_s", F.when(F.col("frame") == 0, 0.0).otherwise(F.when(has, move))))
        measured = True
    else:
        laid = K.speed(K.widen(laid, seq, 1, 0), seq, {"v_px_s": [f"{j}_x", f"{j}_y"]}, p.fps)
        measured = p.m_per_px is not None and p.m_per_px > 0
        laid = laid.withColumn("v_m_s", F.col("v_px_s") * p.m_per_px if measured else F.lit(None).cast("double"))
    kmh, mph = speed_units(F.col("v_m_s"))
    laid = laid.withColumns({"v_km_h": kmh, "v_mph": mph})
    main = F.col("v_km_h") if p.dimension == "3d" else F.col("v_px_s")
    near = F.col("frame").between(F.col("impact") - 2, F.col("impact") + 2)
    laid = seq.attach(laid, {"_peak": K.first_max(main, among=near)})
    at_peak = F.col("frame") == F.col("_peak")
    aggs = {"impact_frame": F.max("impact"), "peak_frame": F.max("_peak")}
    if p.dimension != "3d":
        aggs["wrist_peak_px_s"] = F.max(F.when(at_peak, F.col("v_px_s")))
    aggs["wrist_peak_kmh"] = F.max(F.when(at_peak, F.col("v_km_h")))
    out = seq.summarise(laid, aggs)
    # The peak in mph goes through km/h with its own constant.
    out = out.withColumn("wrist_peak_mph", F.col("wrist_peak_kmh") / 1.609344)
    # Club head estimate and range as multiples of the wrist speed.
    for name, k in (("", 1.35), ("_min", 1.25), ("_max", 1.55)):
        out = out.withColumns({f"club_kmh{name}": F.col("wrist_peak_kmh") * k, f"club_mph{name}": F.col("wrist_peak_mph") * k})
    out = out.withColumn("speed_group", rules.nearest_speed_group(F.col("club_mph"))["name"])
    cols = ["v_m_s", "v_km_h", "v_mph"]
    if p.dimension == "3d":
        grip = {f"grip_{a.lower()}": (F.col(f"RWrist_{c}") + F.col(f"LWrist_{c}")) / 2 for a, c in zip(axes, q)}
        laid = laid.withColumns(grip)
        cols += [*grip, "lwrist_speed", "rwrist_speed"]
    else:
        cols.append("v_px_s")
    return MetricResult(out, seq.done(laid).select(*seq.keys, "frame", *cols))


@by_length
def xfactor(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
    joints = ["LShoulder", "RShoulder", "LHip", "RHip", "LAnkle", "RAnkle", "RWrist"]
    laid = _stance(_wide(pose, seq, joints, "XYZ", 1), "X3")
    laid = laid.withColumn("_rise", K.above_and_rising("RWrist_X3", "stance_mid_x", seq.window()))
    laid = K.find_impact(laid, seq, F.col("_rise"), "RWrist_X3")
    laid = K.widen(laid, seq, 1, 0)
    laid = K.choose_plane(K.xfactor_series(laid, seq, clip=True, gaps=p.angle_gaps), seq)
    before = F.col("frame") <= F.col("impact")
    out = seq.summarise(laid, {
        "chosen_plane": F.max("plane"), "xfactor_max_deg": F.max(F.when(before, F.abs("xf"))),
        "xfactor_max_frame": F.coalesce(K.first_max(F.abs("xf"), among=before), F.lit(0)),
        "xfactor_at_impact_deg": F.max(F.when(F.col("frame") == F.col("impact"), F.col("xf"))),
        "impact_frame": F.max("impact")})
    cat = rules.xfactor_category(F.col("xfactor_max_deg"))
    out = out.withColumns({"range": cat["range"], "label": cat["label"], "messages": cat["messages"]})
    frames = seq.done(laid).select(*seq.keys, "frame", *["xf_" + q.replace("-", "_") for q in K.PLANES])
    return MetricResult(out, frames)


def plane_stats(frames: DataFrame, seq: Sequence) -> DataFrame:
    """Per plane: largest |angle| up to impact, its first frame, and the angle at impact."""
    planes = F.array(*[F.struct(F.lit(q).alias("plane"), F.col("xf_" + q.replace("-", "_")).alias("xf")) for q in K.PLANES])
    tall = frames.select(*seq.keys, "frame", "impact", F.inline(planes))
    before = F.col("frame") <= F.col("impact")
    return tall.groupBy(*seq.keys, "plane").agg(
        F.max(F.when(before, F.abs("xf"))).alias("xfactor_max_deg"),
        F.coalesce(K.first_max(F.abs("xf"), among=before), F.lit(0)).alias("xfactor_max_frame"),
        F.max(F.when(F.col("frame") == F.col("impact"), F.col("xf"))).alias("xfactor_at_impact_deg"))


@by_length
def shoulder_sway(pose: DataFrame, p: Params, seq: Sequence) -> MetricResult:
    """Vertical lines outside the frame-0 shoulders and whether a shoulder leaves them."""
    laid = _wide(pose, seq, ["LShoulder", "RShoulder"], "xy", 0)
    first = F.col("frame") == 0
    laid = seq.attach(laid, {"_l": F.max(F.when(first, F.col("LShoulder_x"))), "_r": F.max(F.when(first, F.col("RShoulder_x")))})
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    width = F.when(both, F.abs(F.col("_r") - F.col("_l"))).otherwise(0.1 * p.image_width)
    mid = F.when(both, (F.col("_r") + F.col("_l")) / 2).otherwise(p.image_width / 2)
    off = max(0.0, p.sway_outward_ratio) * width

    def line(base: Column, outward: Column) -> Column:
        x = (base + outward * off).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(p.image_width - 1), x))

    l, r = F.col("_l"), F.col("_r")
    laid = laid.withColumns({
        "left_line": F.when(l.isNotNull(), line(l, F.when(l < mid, -1).otherwise(1))),
        "right_line": F.when(r.isNotNull(), line(r, F.when(r > mid, 1).otherwise(-1)))})
    lo, hi = F.least("left_line", "right_line"), F.greatest("left_line", "right_line")
    xs = [F.col("LShoulder_x"), F.col("RShoulder_x")]
    laid = laid.withColumns({"sway_left": F.least(*xs) < lo, "sway_right": F.greatest(*xs) > hi})
    out = seq.summarise(laid, {
        "left_line": F.max("left_line"), "right_line": F.max("right_line"),
        "frames_left": F.count(F.when(F.col("sway_left"), 1)), "frames_right": F.count(F.when(F.col("sway_right"), 1))})
    return MetricResult(out, seq.done(laid).select(*seq.keys, "frame", "left_line", "right_line", "sway_left", "sway_right"))


REGISTRY: dict[str, Metric] = {
    "com_speed": com_speed, "com_shift": com_shift, "head_speed": head_speed, "swing_speed": swing_speed,
    "xfactor": xfactor, "shoulder_sway": shoulder_sway,
}


def list_metrics() -> list[str]:
    return list(REGISTRY)


def get_metric(name: str) -> Metric:
    return REGISTRY[name]


def register_metric(name: str, metric: Metric) -> None:
    REGISTRY[name] = metric


# Fixed value: why a metric is left out of two-dimensional runs.
NEEDS_3D = {"xfactor": "xfactor requires 3D metrics; skipped for 2D run"}


def skipped(p: Params, only: list[str] | None = None) -> dict[str, str]:
    """Metrics that don't apply, with the reason."""
    return {} if p.dimension == "3d" else {n: NEEDS_3D[n] for n in only or list_metrics() if n in NEEDS_3D}


def _shared(pose: DataFrame, seq: Sequence) -> list[tuple[DataFrame, Sequence]]:
    """The pose, read once for all metrics, in the parts that they work on; whole swings lie together, so that metrics need no shuffle of it."""
    if seq.longest is None:
        return [(cut_lineage(pose), seq)]
    if seq.fits:
        return [(seq.gather(pose), replace(seq, gathered=True))]
    (short, of_short), (long_, of_long) = seq.parts(pose)
    return [(of_short.gather(short), replace(of_short, gathered=True)), (cut_lineage(long_), of_long)]


def _planned(name: str, parts: list[tuple[DataFrame, Sequence]], p: Params) -> MetricResult:
    metric = REGISTRY[name]
    if hasattr(metric, "on_parts"):
        return metric.on_parts(parts, p)
    return by_length(metric).on_parts(parts, p)


def run_all(pose: DataFrame, p: Params, seq: Sequence, only: list[str] | None = None) -> tuple[dict[str, MetricResult], dict[str, str]]:
    """Every metric that applies; one that cannot be planned is reported, the others still run. The pose is read once."""
    results, errors, parts = {}, {}, _shared(pose, seq)
    for name in only or list_metrics():
        if name in skipped(p, only):
            continue
        try:
            results[name] = _planned(name, parts, p)
        except Exception as e:  # noqa: BLE001 - the message is the result
            errors[name] = f"{type(e).__name__}: {e}"
    return results, errors


def _first_line(e: Exception) -> str:
    return f"{type(e).__name__}: {e}".split("\n")[0]


def _settled(r: MetricResult) -> MetricResult:
    return MetricResult(cut_lineage(r.summary), cut_lineage(r.frames))


#: Shares that are tried side by side.
TRIALS = 8
#: Swings that go by trials of shares, each planned by itself; more are told apart by the tasks of one plan first.
FEW = 16
#: Swings of a task in the first round of that, and tasks of a job.
SWINGS, TASKS = 16, 16
#: A hash like any other.
NO_HASH = 0x5EED0FA11DEADBED


def _why(name: str, parts: list[tuple[DataFrame, Sequence]], p: Params) -> str | None:
    """The error that a metric ends with on these rows; None where it runs through."""
    try:
        r = _planned(name, parts, p)
        for df in (r.summary, r.frames):
            df.write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001 - the message is the result
        return _first_line(e)
    return None


def _by_task(name: str, laid: DataFrame, seq: Sequence, p: Params, cells: int) -> list[DataFrame] | None:
    """Results of a metric of which task i computes what partition i of `laid` has, and nothing else; None where its plan regroups rows."""
    keys = ", ".join(f"{k}#" for k in seq.keys)
    out = []
    for df in (lambda r: (r.summary, r.frames))(_planned(name, [(laid, replace(seq, gathered=True))], p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The one exchange is that of `laid`; other nodes that bring partitions together or apart have these names.
        for line in plan.split("\n"):
            dealt = re.sub(r"#\d+L?", "#", line)
            if "Exchange" in line and f"hashpartitioning({keys}, {cells}), REPARTITION_BY_NUM" not in dealt:
                return None
            if re.search(r"Coalesce(?!\()|Union|Cartesian|Broadcast|Subquery|Limit|LocalTableScan|AdaptiveSparkPlan", line):
                return None
        try:
            # All columns are computed, and hardly a row comes over.
            df = df.filter(F.xxhash64(*df.columns) == F.lit(NO_HASH))
            df.schema
        except Exception:  # noqa: BLE001 - a column of a kind that has no hash
            pass
        out.append(df)
    return out


def _tasks_that_fail(df: DataFrame, tasks: list[int]) -> dict[int, str]:
    """The error of each of these tasks that doesn't run through. A job ends with the first error, so it is run again in halves, down to single tasks."""
    sc, failed = df.sparkSession.sparkContext, {}
    rows = df.rdd._jrdd_deserializer

    def run(mine: list[int]) -> dict[int, str]:
        try:
            # As SparkContext.runJob, but without a Python worker for each task: one that fails takes its worker with it. Each job has an
            # RDD of its own, as Spark ends all jobs of an RDD with one.
            for _ in _load_from_socket(sc._jvm.PythonRDD.runJob(sc._jsc.sc(), df._jdf.javaToPython(), mine), rows):
                pass
        except Exception as e:  # noqa: BLE001 - the message is the result
            if len(mine) == 1:
                return {mine[0]: _first_line(e)}
            half = len(mine) // 2
            return run(mine[:half]) | run(mine[half:])
        return {}

    with ThreadPoolExecutor(TRIALS) as pool:
        for bad in pool.map(run, [tasks[i:i + TASKS] for i in range(0, len(tasks), TASKS)]):
            failed |= bad
    return failed


def _told_apart(name: str, rows: DataFrame, seq: Sequence, p: Params, many: int, most: int | None) -> tuple[list[tuple], DataFrame | None]:
    """(keys.., message) of swings that a metric fails on, and the rows of those that are still in doubt.

    The swings are dealt out over many small partitions. A metric that doesn't regroup them is planned once a round, and each partition is a
    task by itself; those that fail are dealt out anew, over more partitions than they have swings, until a task has one swing.
    """
    spark, keys, found, cells = rows.sparkSession, list(seq.keys), [], -(-many // SWINGS)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    while many > FEW:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            dfs = _by_task(name, rows.repartition(cells, *keys), seq, p, cells)
            if dfs is None or any(df.rdd.getNumPartitions() != cells for df in dfs):
                break
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        failed: dict[int, str] = {}
        for df in dfs:
            failed |= _tasks_that_fail(df, [i for i in range(cells) if i not in failed])
        cell = F.pmod(F.hash(*keys), F.lit(cells))
        mine = rows.withColumn("_cell", cell).filter(F.col("_cell").isin(list(failed)))
        of = (mine.select(*keys, "_cell").distinct().groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*keys)).alias("_swing")).collect())
        if {r["_cell"] for r in of} != set(failed):
            break
        found += [(*r["_swing"], failed[r["_cell"]]) for r in of if r["_n"] == 1]
        if most is not None and len(found) + sum(r["_n"] > 1 for r in of) > most:
            raise ValueError(f"{name} fails on more than {most} swings")
        doubt, left = [r["_cell"] for r in of if r["_n"] > 1], sum(r["_n"] for r in of if r["_n"] > 1)
        path = f"{sequence.shared_folder(spark)}/doubt-{uuid.uuid4().hex}"
        mine.filter(F.col("_cell").isin(doubt)).drop("_cell").write.parquet(path)
        rows, was, many = spark.read.schema(rows.schema).parquet(path), many, left
        if many > was // 2 and cells > was:
            break
        cells = 4 * many + 1
    return found, rows if many else None


def _failing(name: str, parts: list[tuple[DataFrame, Sequence]], p: Params, keys: list[str], fan: int, most: int | None) -> list[tuple]:
    """(keys.., message) of the swings that a metric fails on.

    The swings are cut into shares by hash, those that fail into `fan` again, until a share is one swing. A round writes the shares that
    are in doubt into a folder each, so that a trial reads its own rows only, and tries several at a time.
    """
    spark, found = parts[0][0].sparkSession, []
    hashed = F.xxhash64(*keys)

    def ids(shares: list[tuple[DataFrame, Sequence]]) -> DataFrame:
        out = shares[0][0].select(*keys)
        for rows, _ in shares[1:]:
            out = out.unionByName(rows.select(*keys))
        return out.distinct()

    many = ids(parts).count()
    if many > FEW and len(parts) == 1 and parts[0][1].fits:
        found, rest = _told_apart(name, *parts[0], p, many, most)
        parts = [] if rest is None else [(rest, replace(parts[0][1], gathered=False))]
        many = ids(parts).count() if parts else 0
    cells = max(fan, many // fan**2)
    while parts:
        folder, laid = f"{sequence.shared_folder(spark)}/shares-{uuid.uuid4().hex}", []
        for i, (rows, seq) in enumerate(parts):
            dealt = rows.withColumn("_share", F.pmod(hashed, F.lit(cells)))
            dealt.repartition("_share").write.partitionBy("_share").parquet(f"{folder}/{i}")
            laid.append((spark.read.schema(dealt.schema).parquet(f"{folder}/{i}"), replace(seq, gathered=False)))

        def trial(share: int) -> tuple[int, list[tuple]]:
            mine = [(rows.filter(F.col("_share") == share).drop("_share"), seq) for rows, seq in laid]
            why = _why(name, mine, p)
            return share, [] if why is None else [(*i, why) for i in ids(mine).limit(2).collect()]

        shares = sorted({r[0] for rows, _ in laid for r in rows.select("_share").distinct().collect()})
        with ThreadPoolExecutor(TRIALS) as pool:
            tried = list(pool.map(trial, shares))
        last = cells > 1 << 60
        found += [bad for _, swings in tried if last or len(swings) == 1 for bad in swings]
        if most is not None and len(found) > most:
            raise ValueError(f"{name} fails on more than {most} swings")
        doubt = [share for share, swings in tried if len(swings) > 1 and not last]
        parts = [(rows.filter(F.col("_share").isin(doubt)).drop("_share"), seq) for rows, seq in laid] if doubt else []
        cells *= fan
    return found


def run_guarded(
    pose: DataFrame, p: Params, seq: Sequence, only: list[str] | None = None, fan: int = 8, most: int | None = None,
) -> tuple[dict[str, MetricResult], dict[str, str], DataFrame]:
    """As `run_all`, with failures at run time kept to the swings they happen on: (results, errors of whole metrics, failures).

    Results are computed and stored here. A metric that fails is computed again without the swings that it fails on, which
    are found by cutting the table into ever smaller shares; failures has the keys, metric and error of each. With
    `most`, a metric that fails on more swings counts as failing as a whole, as one that can't be planned does.
    """
    keys, parts = list(seq.keys), _shared(pose, seq)
    results, errors, failures = {}, {}, []
    for name in only or list_metrics():
        if name in skipped(p, only):
            continue
        try:
            planned = _planned(name, parts, p)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        try:
            results[name] = _settled(planned)
        except Exception as e:  # noqa: BLE001
            try:
                bad = _failing(name, parts, p, keys, fan, most)
                ids = pose.sparkSession.createDataFrame([b[:-1] for b in bad], parts[0][0].select(*keys).schema)
                good = [(rows.join(F.broadcast(ids), keys, "left_anti"), seq) for rows, seq in parts]
                results[name] = _settled(_planned(name, good, p))
                failures += [(*b[:-1], name, b[-1]) for b in bad]
            except Exception:  # noqa: BLE001
                errors[name] = _first_line(e)
    schema = parts[0][0].select(*keys).schema.add("metric", "string").add("error", "string")
    return results, errors, pose.sparkSession.createDataFrame(failures, schema)


def by_dimension(pose: DataFrame, p: Params, seq: Sequence, metric: str) -> DataFrame:
    """Summary over swings with depth in 3D and over all others in 2D."""
    pose = cut_lineage(pose)
    is3 = cut_lineage(three_dimensional(pose, seq))
    out = None
    for dim, flag in (("3d", True), ("2d", False)):
        part = pose.join(is3.filter(F.col("is_3d") == flag).select(*seq.keys), list(seq.keys), "left_semi")
        s = REGISTRY[metric](part, replace(p, dimension=dim), seq).summary.withColumn("dimension", F.lit(dim))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def summary_document(results: dict[str, MetricResult], keys: list[str], dimension: str, errors: dict[str, str] | None = None,
                     skips: dict[str, str] | None = None, failures: DataFrame | None = None) -> DataFrame:
    """One JSON document per swing: the summaries, and for other metrics their error or why they were skipped.

    With `failures` (keys, metric, error) of `run_guarded`, a metric that failed on a swing shows its error there, beside
    the summaries of the other metrics; fields that don't apply are null.
    """
    parts = None
    for name, r in results.items():
        s = r.summary.select(*keys, F.struct(*[c for c in r.summary.columns if c not in keys]).alias(name))
        parts = s if parts is None else parts.join(s, keys, "full_outer")
    if failures is not None:
        failed = failures.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "error"))).alias("_failed"))
        parts = parts.join(failed, keys, "full_outer")

    def entry(name: str) -> Column:
        if failures is None:
            return F.struct(F.col(name).alias("summary"))
        return F.struct(F.col(name).alias("summary"), F.try_element_at("_failed", F.lit(name)).alias("error"))

    entries = [entry(n).alias(n) for n in results]
    entries += [F.struct(F.lit(text).alias("error")).alias(n) for n, text in (errors or {}).items()]
    entries += [F.struct(F.lit(True).alias("skipped"), F.lit(why).alias("reason")).alias(n) for n, why in (skips or {}).items()]
    doc = F.struct(F.col(keys[0]).cast("string").alias("job_id"), F.lit(dimension).alias("dimension"), F.struct(*entries).alias("metrics"))
    return parts.select(*keys, F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def frame_documents(results: dict[str, MetricResult], keys: list[str]) -> DataFrame:
    """Per swing and metric one frame map {"<frame>": {column: value or null}}."""
    out = None
    for name, r in results.items():
        cols = [c for c in r.frames.columns if c not in (*keys, "frame")]
        part = frame_map(r.frames, keys, cols).withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
