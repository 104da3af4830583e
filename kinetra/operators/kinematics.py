"""Motion series and events on wide frames laid out by a `Sequence`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.operators.sequence import Sequence, by_length
from kinetra.operators.smooth import lerp, median_then_mean

PLANES = {"X-Z": ("X", "Z"), "X-Y": ("X", "Y"), "Y-Z": ("Y", "Z")}


def valid(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def centre_of_mass(axes: tuple[str, ...]) -> dict[str, Column]:
    """Unweighted mean over the joints whose axes are all valid, as aggregates of a frame's joints."""
    ok = valid(*axes)
    return {f"com_{a[0].lower()}": F.avg(F.when(ok, F.col(a))) for a in axes}


def step_length(cols: list[str], w) -> Column:
    """Distance to the previous frame, NULL unless both are valid."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.pow(F.col(c) - F.lag(c).over(w), 2)
    return F.sqrt(total)


def speed(laid: DataFrame, seq: Sequence, out: dict[str, list[str]], fps: float | None = None) -> DataFrame:
    """Frame speed of each named point: carried over gaps, zero before the first step."""
    scale = float(fps) if fps and fps > 0 else 1.0
    w = seq.window()
    laid = laid.select("*", *[(step_length(cols, w) * scale).alias(f"_sp_{n}") for n, cols in out.items()])
    laid = seq.scan(laid, last={n: F.col(f"_sp_{n}") for n in out})
    return laid.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in out}).drop(*[f"_sp_{n}" for n in out])


def speed_unit(dimension: str, fps: float | None) -> str:
    return ("mm" if dimension == "3d" else "px") + ("/s" if fps and fps > 0 else "/frame")


def fill_linear(laid: DataFrame, seq: Sequence, cols: dict[str, str]) -> DataFrame:
    """Add gap-filled copies of columns {new: source}."""
    pos = F.col(seq.order)
    at = {c: F.when(F.col(c).isNotNull(), F.struct(pos.alias("p"), F.col(c).alias("v"))) for c in cols.values()}
    laid = seq.scan(laid, last={f"_b_{c}": e for c, e in at.items()}, nxt={f"_a_{c}": e for c, e in at.items()})
    laid = laid.withColumns({n: lerp(pos, F.col(f"_b_{c}"), F.col(f"_a_{c}"), F.col(c)) for n, c in cols.items()})
    return laid.drop(*[f"_{s}_{c}" for s in "ab" for c in cols.values()])


def widen(laid: DataFrame, seq: Sequence, before: int, after: int) -> DataFrame:
    """Renew the halo after operators that dropped it."""
    return laid if seq.fits else seq.lay_out(seq.done(laid), before, after)


def first_where(cond: Column, order: str = "frame") -> Column:
    return F.min(F.when(cond, F.col(order)))


def first_max(value: Column, order: str = "frame", among: Column | None = None) -> Column:
    """Row position of the largest value, the first one on ties; NULLs are skipped.

    Values equal to nine decimals tie: flat stretches of smoothed series differ by rounding alone.
    """
    ok = value.isNotNull() if among is None else value.isNotNull() & among
    return F.max_by(F.col(order), F.when(ok, F.struct(F.round(value, 9).alias("v"), (-F.col(order)).alias("o"))))


def few_rows(value: str, among: Column, order: str = "frame") -> Column:
    """Aggregate: (order, value) of the few rows that `among` picks, missing values left out."""
    return F.collect_list(F.when(among & F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))


def mean_in_order(rows: Column) -> Column:
    """Mean of collected (o, v) rows, added up in order: the same to the last bit however rows are split."""
    total = F.aggregate(F.array_sort(rows), F.lit(0.0), lambda acc, r: acc + r["v"])
    return F.when(F.size(rows) > 0, total / F.size(rows))


def strict_crossing(wrist: str, mid: str, w) -> Column:
    """The wrist passes the stance middle upwards between two valid frames."""
    x, m = F.col(wrist), F.col(mid)
    px, pm = F.lag(wrist).over(w), F.lag(mid).over(w)
    return (px < pm) & (x >= m) & (x - px > 0)


def above_and_rising(wrist: str, mid: str, w) -> Column:
    return (F.col(wrist) >= F.col(mid)) & (F.col(wrist) - F.lag(wrist).over(w) > 0)


def find_impact(laid: DataFrame, seq: Sequence, cond: Column, wrist: str, out: str = "impact") -> DataFrame:
    """Impact frame of the swing: first frame meeting `cond`, else the wrist's maximum, else the last."""
    laid = laid.withColumn("_hit", cond)
    laid = seq.attach(laid, {
        "_first": first_where(F.col("_hit"), seq.order), "_peak": first_max(F.col(wrist), seq.order),
        "_end": F.max(seq.order)})
    return laid.withColumn(out, F.coalesce("_first", "_peak", "_end")).drop("_hit", "_first", "_peak", "_end")


def continuous_directions(laid: DataFrame, seq: Sequence, vectors: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Flip vectors that point against the previous output; gaps and right angles start afresh.

    The sign is the parity of reversals since the last fresh start; <name>_flip tells where it is odd.
    """
    w = seq.window()

    def dot(cols) -> Column:
        total = F.lit(0.0)
        for c in cols:
            total = total + F.col(c) * F.lag(c).over(w)
        return total

    laid = laid.select("*", *[dot(cols).alias(f"_d_{n}") for n, cols in vectors.items()])
    laid = seq.scan(laid, total={f"_neg_{n}": F.when(F.col(f"_d_{n}") < 0, 1).otherwise(0) for n in vectors})
    laid = seq.scan(laid, last={
        f"_base_{n}": F.when(F.col(f"_d_{n}").isNull() | (F.col(f"_d_{n}") == 0), F.col(f"_neg_{n}")) for n in vectors}, settle=True)
    new = {}
    for n, cols in vectors.items():
        odd = (F.col(f"_neg_{n}") - F.col(f"_base_{n}")) % 2 == 1
        # A vector with a gap is left alone, as is the one after it.
        for c in cols:
            new[c] = F.when(odd & valid(*cols), -F.col(c)).otherwise(F.col(c))
        new[f"{n}_flip"] = odd & valid(*cols)
    return laid.withColumns(new).drop(*[f"_{k}_{n}" for k in ("d", "neg", "base") for n in vectors])


def signed_angle(b: Column, a: Column, flipped: Column) -> Column:
    """atan2(b, a) where a flipped vector keeps the sign of its zeros, which the built-in drops."""
    return F.when(flipped & (b == 0) & (a <= 0), -math.pi).otherwise(F.atan2(b, a))


def unwrapped(laid: DataFrame, seq: Sequence, angles: list[str], gaps: str = "skip") -> DataFrame:
    """Remove full turns between successive angles (radians) and convert to degrees.

    gaps="skip" compares with the last valid angle; "stop" leaves everything after a gap missing.
    """
    pi = math.pi
    laid = seq.scan(laid, prev={f"_p_{a}": F.col(a) for a in angles}, settle=True)
    corr = {}
    for a in angles:
        step = F.col(a) - F.col(f"_p_{a}")
        turn = step + pi
        m = turn - F.floor(turn / (2 * pi)) * (2 * pi) - pi
        m = F.when((m == -pi) & (step > 0), pi).otherwise(m)
        corr[a] = F.when(F.abs(step) < pi, 0.0).otherwise(m - step)
    laid = seq.scan(laid, total={**{f"_c_{a}": corr[a] for a in angles},
                                 **{f"_g_{a}": F.col(a).isNull().cast("int") for a in angles}}, settle=True)
    new = {a: F.degrees(F.col(a) + F.col(f"_c_{a}")) for a in angles}
    if gaps == "stop":
        new = {a: F.when(F.col(f"_g_{a}") == 0, e) for a, e in new.items()}
    return laid.withColumns(new).drop(*[f"_{k}_{a}" for k in "pcg" for a in angles])


def xfactor_series(laid: DataFrame, seq: Sequence, clip: bool, gaps: str = "skip", window: int = 5) -> DataFrame:
    """Shoulder line against pelvis line per plane, smoothed: columns xf_X_Z, xf_X_Y, xf_Y_Z.

    Needs a halo of one frame; returns rows without halo.
    """
    vec = {f"{n}_{a}": F.col(f"R{j}_{a}3") - F.col(f"L{j}_{a}3")
           for n, j in (("sh", "Shoulder"), ("pe", "Hip")) for a in "XYZ"}
    laid = laid.withColumns(vec)
    laid = continuous_directions(laid, seq, {n: (f"{n}_X", f"{n}_Y", f"{n}_Z") for n in ("sh", "pe")})
    names = {p: "xf_" + p.replace("-", "_") for p in PLANES}
    angle = {f"{n}_{names[p]}": signed_angle(F.col(f"{n}_{b}"), F.col(f"{n}_{a}"), F.col(f"{n}_flip"))
             for n in ("sh", "pe") for p, (a, b) in PLANES.items()}
    laid = unwrapped(laid.withColumns(angle), seq, list(angle), gaps)
    laid = laid.withColumns({c: F.col(f"sh_{c}") - F.col(f"pe_{c}") for c in names.values()})
    laid = laid.drop(*vec, *angle, "sh_flip", "pe_flip")
    reach = 2 * (window // 2)
    laid = seq.core(median_then_mean(widen(laid, seq, reach, reach), list(names.values()), seq, window))
    if not clip:
        return laid
    # greatest and least skip NULL: a missing angle stays missing.
    return laid.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c))))
                             for c in names.values()})


def choose_plane(laid: DataFrame, seq: Sequence, impact: str = "impact") -> DataFrame:
    """Plane with the narrowest 10-90 % spread of |angle| up to impact among those with a median
    between 5 and 80 degrees; X-Z where none qualifies. Adds `plane` and its series `xf`."""
    specs = {}
    for p in PLANES:
        c = "xf_" + p.replace("-", "_")
        before = F.when(F.col(seq.order) <= F.col(impact), F.abs(c))
        specs.update({f"_{q}_{c}": (before, q / 100) for q in (10, 50, 90)})
    laid = seq.attach(laid, quantiles=specs)
    options = []
    for i, p in enumerate(PLANES):
        c = "xf_" + p.replace("-", "_")
        good = (F.col(f"_50_{c}") > 5) & (F.col(f"_50_{c}") < 80)
        options.append(F.when(good, F.struct((F.col(f"_90_{c}") - F.col(f"_10_{c}")).alias("s"),
                                             F.lit(i).alias("o"), F.lit(p).alias("p"))))
    best = F.array_min(F.array(*options))
    laid = laid.withColumn("plane", F.coalesce(best["p"], F.lit("X-Z"))).drop(*specs)
    pick = F.lit(None).cast("double")
    for p in PLANES:
        pick = F.when(F.col("plane") == p, F.col("xf_" + p.replace("-", "_"))).otherwise(pick)
    return laid.withColumn("xf", pick)


def gradient(c: str, w) -> Column:
    """Central difference, one-sided at the ends."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return (F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before)
            .otherwise((after - before) / 2))


def find_transition(laid: DataFrame, seq: Sequence, series: str, start: str, end: str) -> DataFrame:
    """First frame in [start, end) where the slope of the gap-filled series turns positive."""
    laid = fill_linear(laid, seq, {"_f": series}).withColumn("_f", F.coalesce("_f", F.lit(0.0)))
    laid = widen(laid, seq, 2, 1)
    w = seq.window()
    laid = laid.withColumn("_g", gradient("_f", w))
    laid = laid.withColumn("_turn", (F.lag("_g").over(w) <= 0) & (F.col("_g") > 0))
    at = F.col(seq.order)
    inside = (at >= F.greatest(F.col(start), F.lit(1))) & (at < F.col(end)) & (F.col(end) > F.col(start) + 1)
    laid = seq.attach(laid, {"transition": first_where(F.col("_turn") & inside, seq.order)})
    return laid.drop("_f", "_g", "_turn")


def displacement(laid: DataFrame, seq: Sequence, x: str, y: str) -> DataFrame:
    """Offset from frame 0 (missing when that frame is): head_dx, head_dy, head_disp."""
    first = F.col(seq.order) == 0
    laid = seq.attach(laid, {"_x0": F.max(F.when(first, F.col(x))), "_y0": F.max(F.when(first, F.col(y)))})
    laid = laid.withColumns({"head_dx": F.col(x) - F.col("_x0"), "head_dy": F.col(y) - F.col("_y0")})
    return laid.withColumn("head_disp", F.sqrt(F.pow("head_dx", F.lit(2)) + F.pow("head_dy", F.lit(2)))).drop("_x0", "_y0")


def keep_runs(laid: DataFrame, seq: Sequence, c: str, length: int) -> DataFrame:
    """0/1 column with runs of ones shorter than `length` removed; needs a halo of length - 1."""
    if length <= 1:
        return laid
    w = seq.window(0, length - 1)
    whole = F.count(c).over(w) == length
    laid = laid.withColumn("_shrunk", F.when(whole, F.min(c).over(w)).otherwise(0))
    return laid.withColumn(c, F.max("_shrunk").over(seq.window(-(length - 1), 0))).drop("_shrunk")


def clean_runs(laid: DataFrame, seq: Sequence, c: str, min_true: int, max_false: int) -> DataFrame:
    """Drop short runs of ones, then fill runs of zeros no longer than `max_false`, ends included.

    A run survives when some full window inside it covers the row, so only near rows matter.
    """
    laid = keep_runs(laid, seq, c, min_true)
    if max_false > 0:
        laid = laid.withColumn("_off", 1 - F.col(c))
        laid = keep_runs(laid, seq, "_off", max_false + 1)
        laid = laid.withColumn(c, 1 - F.col("_off")).drop("_off")
    return laid


@by_length
def motion_signal(pose: DataFrame, seq: Sequence) -> DataFrame:
    """Mean joint movement per frame, the most active person where there are several."""
    joint = seq.on(*seq.keys, "person_idx", "joint_idx")
    laid = joint.lay_out(pose, before=1)
    laid = joint.core(laid.withColumn("_m", step_length(["x", "y"], joint.window())))
    person = laid.groupBy(*seq.keys, seq.order, "person_idx").agg(F.avg("_m").alias("_m"))
    return person.groupBy(*seq.keys, seq.order).agg(F.coalesce(F.max("_m"), F.lit(0.0)).alias("motion"))


def box_smooth(c: str, window: int, seq: Sequence) -> Column:
    """Zero-padded box filter: rows i - w/2 .. i + (w-1)/2, always divided by w."""
    return F.sum(c).over(seq.window(-(window // 2), (window - 1) // 2)) / window


@by_length
def static_trim(
    pose: DataFrame, seq: Sequence, fps: int = 30, smooth_s: float = 0.2, min_true_s: float = 0.15,
    max_false_s: float = 0.3, pad_s: float = 0.1,
) -> DataFrame:
    """(start, end) frames per swing without the still lead-in and lead-out."""
    win, min_true = max(1, round(smooth_s * fps)), max(1, round(min_true_s * fps))
    max_false, pad = max(0, round(max_false_s * fps)), max(0, round(pad_s * fps))
    motion = motion_signal(pose, seq)
    laid = seq.lay_out(motion, win // 2, (win - 1) // 2)
    laid = seq.core(laid.withColumn("smooth", box_smooth("motion", win, seq)) if win > 1
                    else laid.withColumn("smooth", F.col("motion")))
    laid = seq.attach(laid, {"_max": F.max("smooth")}, {"_base": (F.col("smooth"), 0.2)})
    on = F.col("smooth") > F.col("_base") + 0.10 * (F.col("_max") - F.col("_base"))
    laid = laid.withColumn("_on", on.cast("int"))
    reach = (min_true - 1) + max_false
    laid = seq.core(clean_runs(widen(laid, seq, 2 * reach, 2 * reach), seq, "_on", min_true, max_false))
    at = F.col(seq.order)
    out = laid.groupBy(*seq.keys).agg(
        F.min(F.when(F.col("_on") == 1, at)).alias("_a"), F.max(F.when(F.col("_on") == 1, at)).alias("_b"),
        F.max(at).alias("_last"))
    start, end = F.greatest(F.col("_a") - pad, F.lit(0)), F.least(F.col("_b") + pad, F.col("_last"))
    use = F.col("_a").isNotNull() & (F.col("_last") >= 2) & (start < end)
    return out.select(*seq.keys, F.when(use, start).otherwise(0).alias("start"),
                      F.when(use, end).otherwise(F.col("_last")).alias("end"))


def rep_count(laid: DataFrame, seq: Sequence, y: str, threshold: Column) -> DataFrame:
    """Repetitions per sequence: the value rises above the threshold and comes back below it.

    The counter starts below, and values on the threshold change nothing.
    """
    side = F.when(F.col(y) > threshold, 1).when(F.col(y) < threshold, -1)
    laid = seq.scan(laid.withColumn("_side", side), prev={"_was": F.col("_side")})
    back = (F.col("_side") == -1) & (F.col("_was") == 1)
    return laid.groupBy(*seq.keys).agg(F.count(F.when(back, 1)).alias("reps"))
