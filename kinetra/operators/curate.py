"""Dataset curation: completeness, gaps, impact frames, segments, boxes, manifests, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.operators.sequence import Sequence, by_length


def clip_statistics(pose: DataFrame, keys: tuple[str, ...] = ("swing_id",), by: tuple[str, ...] = ("split", "label")) -> DataFrame:
    """Per clip statistics, then their mean per group (frames with the sample deviation)."""
    clip = pose.groupBy(*keys, *by).agg(
        F.count_distinct("frame").alias("frames"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"),
        F.stddev_pop("y").alias("sy"), F.avg("conf").alias("mc"), F.stddev_pop("conf").alias("sc"))
    return clip.groupBy(*by).agg(
        F.avg("frames").alias("frames_mean"), F.stddev_samp("frames").alias("frames_std"), F.avg("mx").alias("mean_x"),
        F.avg("my").alias("mean_y"), F.avg("sx").alias("std_x"), F.avg("sy").alias("std_y"),
        F.avg("mc").alias("conf_mean"), F.avg("sc").alias("conf_std"))


def keypoint_distribution(pose: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Range, moments and zero share of each axis; bad values are counted."""
    aggs = []
    for a in "xy":
        c = F.col(a)
        aggs += [F.min(c).alias(f"min_{a}"), F.max(c).alias(f"max_{a}"), F.avg(c).alias(f"mean_{a}"),
                 F.stddev_pop(c).alias(f"std_{a}"), F.avg((c == 0).cast("int")).alias(f"zero_ratio_{a}")]
    bad = [F.isnan(a) for a in "xy"], [F.abs(F.col(a)) == float("inf") for a in "xy"]
    for name, (p, q) in zip(("nan_count", "inf_count"), bad):
        aggs.append(F.sum(F.coalesce(p, F.lit(False)).cast("long") + F.coalesce(q, F.lit(False)).cast("long")).alias(name))
    return pose.groupBy(*by).agg(*aggs, (F.count(F.lit(1)) * 2).alias("total"))


def pose_boxes(pose: DataFrame, centre_joint: int = 8, min_conf: float = 0.05, centre_conf: float = 0.10) -> DataFrame:
    """Box of the confident joints per frame, kept where the centre joint is confident."""
    ok = F.col("conf") > min_conf
    at = F.col("joint_idx") == centre_joint
    out = pose.groupBy("swing_id", "frame").agg(
        F.min(F.when(ok, F.col("x"))).alias("x1"), F.min(F.when(ok, F.col("y"))).alias("y1"),
        F.max(F.when(ok, F.col("x"))).alias("x2"), F.max(F.when(ok, F.col("y"))).alias("y2"),
        F.max(F.when(at, F.col("x"))).alias("cx"), F.max(F.when(at, F.col("y"))).alias("cy"),
        F.max(F.when(at, F.col("conf"))).alias("_c"))
    return out.filter(F.col("_c") >= centre_conf).drop("_c")


# ---- numbered files ----------------------------------------------------------------------------

def sequence_completeness(files: DataFrame, keys: tuple[str, ...] = ("prefix",), number: str = "frame_no",
                          min_count: int = 50, max_gap: int = 5) -> DataFrame:
    """Count, range, missing numbers and verdict (keep | short | gap) of each numbered sequence."""
    out = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last"))
    out = out.withColumn("gap", F.col("last") - F.col("first") + 1 - F.col("n"))
    return out.withColumn("status", F.when(F.col("n") <= min_count, "short").when(F.col("gap") > max_gap, "gap").otherwise("keep"))


@by_length
def gap_clusters(files: DataFrame, seq: Sequence, gap: int = 5) -> DataFrame:
    """Cluster number per row: a new cluster starts where the number jumps by more than `gap`.

    A previous row within the gap lies in the halo, so the rows around a block border suffice.
    """
    laid = seq.lay_out(files, before=gap)
    jump = F.col(seq.order) - F.lag(seq.order).over(seq.window())
    laid = seq.core(laid.withColumn("_new", F.when(jump <= gap, 0).otherwise(1)))
    laid = seq.scan(laid, total={"cluster": F.col("_new")})
    return seq.done(laid.withColumn("cluster", (F.col("cluster") - 1).cast("int")).drop("_new"))


def front_impact(left_shoulder: Column, right_shoulder: Column, left_wrist: Column, right_wrist: Column) -> Column:
    """Both wrists' x lie between the shoulders' x."""
    return right_wrist.between(right_shoulder, left_shoulder) & left_wrist.between(right_shoulder, left_shoulder)


def side_impact(points: list[tuple[Column, Column]], limit: float) -> Column:
    """Summed L1 distance of the wrists' coordinates to those at address is below the limit."""
    total = F.lit(0.0)
    for now, then in points:
        total = total + F.abs(now - then)
    return total < limit


@by_length
def address_pose(files: DataFrame, seq: Sequence, wrists: list[str], points: str | None = None, need: int = 10) -> DataFrame:
    """Wrist coordinates of each title's first frame as a_<column>; titles whose first frame has
    fewer than `need` points are dropped."""
    laid = seq.lay_out(files)
    aggs = {f"a_{c}": F.min_by(c, seq.order) for c in wrists}
    if points:
        aggs["_points"] = F.min_by(points, seq.order)
    laid = seq.attach(laid, aggs)
    if points:
        laid = laid.filter(F.col("_points") >= need).drop("_points")
    return seq.done(laid)


@by_length
def late_detections(files: DataFrame, seq: Sequence, hit: str = "hit") -> DataFrame:
    """Rule A: of the detections after the first cluster, the last floor(n / 2); a single one stays."""
    found = F.when((F.col("cluster") >= 1) & F.col(hit), 1).otherwise(0)
    laid = seq.lay_out(files.withColumn("_d", found))
    laid = seq.attach(seq.scan(laid, total={"_run": F.col("_d")}), {"_n": F.sum("_d")})
    keep = (F.col("_d") == 1) & ((F.col("_n") == 1) | (F.col("_run") > F.col("_n") - F.floor(F.col("_n") / 2)))
    return seq.done(laid.filter(keep).drop("_d", "_run", "_n"))


def cluster_impact_ratio(files: DataFrame, keys: tuple[str, ...], hit: str = "hit") -> DataFrame:
    """Frames, detections and verdict of every cluster after the first."""
    out = files.filter(F.col("cluster") >= 1).groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(hit), 1)).alias("impacts"))
    return out.withColumn("is_impact", F.col("impacts") >= F.col("total") / 2)


@by_length
def majority_clusters(files: DataFrame, seq: Sequence, margin: int = 2, hit: str = "hit") -> DataFrame:
    """Rule B: every file within `margin` numbers of a cluster that is mostly detections."""
    inner = seq.on(*seq.keys, "cluster")
    laid = inner.attach(inner.lay_out(files), {"_n": F.count(F.lit(1)), "_k": F.count(F.when(F.col(hit), 1))})
    flag = (F.col("cluster") >= 1) & (F.col("_k") >= F.col("_n") / 2)
    rows = inner.done(laid.withColumn("_f", flag.cast("int")).drop("_n", "_k"))
    laid = seq.lay_out(rows, margin, margin)
    near = Window.partitionBy(*seq.part).orderBy(seq.order).rangeBetween(-margin, margin)
    return seq.done(laid.withColumn("_near", F.max("_f").over(near))).filter("_near = 1").drop("_f", "_near")


def slice_groups(files: DataFrame, prefix: str, part: str, name: str) -> DataFrame:
    """Slices of one recording in order: prefixes with more than one part, position and count."""
    from kinetra.operators.sequence import number_rows

    src = files.filter(F.col(prefix).isNotNull())
    out = number_rows(src, [prefix], [F.col(part), F.col(name)], F.col(part), "position", total="parts")
    return out.filter(F.col("parts") > 1)


@by_length
def sub_sequences(files: DataFrame, seq: Sequence, name: str, length: int = 5) -> DataFrame:
    """Every run of `length` consecutive files of a sequence."""
    laid = seq.lay_out(files, after=length - 1)
    w = seq.window(0, length - 1)
    laid = laid.withColumn("files", F.collect_list(name).over(w))
    return seq.done(laid).filter(F.size("files") == length)


# ---- clips -------------------------------------------------------------------------------------

def drop_short_clips(clips: DataFrame, duration: str = "duration", threshold: float = 1.5) -> DataFrame:
    """Clips of at least the threshold, and those of unknown (non-positive) duration."""
    return clips.filter(~((F.col(duration) > 0) & (F.col(duration) < threshold)))


@by_length
def cut_segments(cuts: DataFrame, seq: Sequence, cut: str = "cut", duration: str = "duration", min_length: float = 0.01) -> DataFrame:
    """Segments between 0, the cut times and the end, without empty ones; numbered per video."""
    laid = seq.lay_out(cuts, 1, 1)
    w = seq.window()
    end_row = F.lead(seq.order).over(w).isNull()
    laid = laid.withColumns({"_a": F.coalesce(F.lag(cut).over(w), F.lit(0.0)), "_end": end_row})
    dur = F.col(duration)

    def piece(n: Column, a: Column, b: Column) -> Column:
        return F.struct(n.cast("long").alias("_o"), F.greatest(a, F.lit(0.0)).alias("start"), F.least(b, dur).alias("end"))

    at = F.col(seq.order)
    pieces = F.array(piece(at, F.col("_a"), F.col(cut)), F.when(F.col("_end"), piece(at + 1, F.col(cut), dur)))
    out = seq.done(laid).select(*seq.keys, F.inline(F.filter(pieces, lambda p: p.isNotNull())))
    return renumber(out.filter(F.col("end") - F.col("start") > min_length), seq)


def renumber(segments: DataFrame, seq: Sequence) -> DataFrame:
    """(keys, segment, start, end) with dense numbers in `_o` order."""
    order = Sequence(seq.keys, "_o", seq.block, None if seq.longest is None else seq.longest + 1)
    laid = order.scan(order.lay_out(segments), total={"_k": F.lit(1)})
    return order.done(laid).select(*seq.keys, (F.col("_k") - 1).cast("long").alias("segment"), "start", "end")


def merge_pass(segments: DataFrame, seq: Sequence, min_length: float) -> DataFrame:
    """One left-to-right pass: a short segment takes in the next one, a short last one joins the
    previous. Whether a segment is being extended is a recurrence: open' = short * (1 - open)."""
    from kinetra.operators.recurrence import affine_scan, step

    short = (F.col("end") - F.col("start") < min_length).cast("double")
    laid = affine_scan(segments.withColumn("_s", short), seq, {"_open": step(-F.col("_s"), F.col("_s"), F.col("_s"))})
    laid = seq.lay_out(laid, 1, 1)
    w = seq.window()
    laid = laid.withColumns({"_taken": F.coalesce(F.lag("_open").over(w), F.lit(0.0)),
                             "_last": F.lead(seq.order).over(w).isNull()})
    join_previous = F.col("_last") & (F.col("_open") == 1) & (F.col(seq.order) > 0)
    laid = seq.core(laid.withColumn("_new", F.when((F.col("_taken") == 1) | join_previous, 0).otherwise(1)))
    laid = seq.scan(laid, total={"_g": F.col("_new")})
    out = laid.groupBy(*seq.keys, (F.col("_g") - 1).cast("long").alias(seq.order)).agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    return out


def merge_short_segments(segments: DataFrame, seq: Sequence, min_length: float) -> DataFrame:
    """Repeat `merge_pass` until no video with several segments has a short one.

    Every pass merges each short segment with a neighbour, so lengths at least double and the
    number of passes is logarithmic. Passes are settled: each is read twice.
    """
    from kinetra.operators.sequence import cut_lineage

    while True:
        segments = cut_lineage(merge_pass(segments, seq, min_length))
        left = segments.groupBy(*seq.keys).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.col("end") - F.col("start")).alias("d"))
        if left.filter((F.col("n") > 1) & (F.col("d") < min_length)).isEmpty():
            return segments


def merge_into_previous(segments: DataFrame, seq: Sequence, threshold: float) -> DataFrame:
    """Segments no longer than the threshold extend the previous one; leading ones run on into the
    first that makes the stretch long enough."""
    laid = seq.attach(seq.lay_out(segments), {"_s0": F.min("start")})
    laid = seq.attach(laid, {"_k": F.min(F.when(F.col("end") - F.col("_s0") > threshold, F.col(seq.order)))})
    at = F.col(seq.order)
    fresh = (at > F.col("_k")) & (F.col("end") - F.col("start") > threshold)
    laid = seq.scan(laid.withColumn("_new", F.coalesce(fresh, F.lit(False)).cast("int")), total={"_g": F.col("_new")})
    return laid.groupBy(*seq.keys, F.col("_g").cast("long").alias(seq.order)).agg(
        F.min("start").alias("start"), F.max("end").alias("end"))


def uniform_frames(videos: DataFrame, keys: list[str], frames: str, samples: int, pad: bool = False) -> DataFrame:
    """Evenly spaced frame numbers per video.

    pad=False: at most `samples` distinct numbers; pad=True: exactly `samples`, short videos repeat
    their last frame.
    """
    n = F.col(frames)
    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")
    out = videos.filter(n > 0).select(*keys, n.alias("_n"), k)
    return _spaced(out, samples, pad).select(*keys, "k", "frame") if pad else \
        _spaced(out, samples, pad).select(*keys, "frame").distinct()


def _spaced(out: DataFrame, samples: int, pad: bool) -> DataFrame:
    k, n = F.col("k"), F.col("_n")
    count = F.lit(samples) if pad else F.least(n, F.lit(samples))
    even = F.when(k == count - 1, n - 1).otherwise(F.floor(k * ((n - 1) / F.greatest(count - 1, F.lit(1)))))
    frame = F.when(n >= samples, even).otherwise(F.least(k, n - 1)) if pad else even
    out = out.withColumn("frame", frame.cast("int"))
    return out if pad else out.filter(k < count)


def clip_frames(videos: DataFrame, keys: list[str], frames: str, clips: int, samples: int) -> DataFrame:
    """`samples` evenly spaced frames of each of `clips` equal segments."""
    c = F.explode(F.sequence(F.lit(0), F.lit(clips - 1))).alias("clip")
    out = videos.select(*keys, F.col(frames).alias("_L"), c)
    edge = lambda i: F.floor(i * (F.col("_L") / clips))
    out = out.withColumns({"_a": edge(F.col("clip")),
                           "_b": F.when(F.col("clip") == clips - 1, F.col("_L")).otherwise(edge(F.col("clip") + 1))})
    out = out.select("*", (F.col("_b") - F.col("_a")).alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    out = _spaced(out.filter(F.col("_n") > 0), samples, True)
    return out.select(*keys, "clip", "k", (F.col("frame") + F.col("_a")).cast("int").alias("frame"))


# ---- boxes -------------------------------------------------------------------------------------

def union_boxes(boxes: DataFrame, keys: list[str], frame_w: int, frame_h: int, pad_x: float = 0.0, pad_y: float = 0.0,
                min_w: int = 0, min_h: int = 0) -> DataFrame:
    """Crop box (x, y, w, h) around all boxes of a person: padded, cut to the frame, even sized."""
    b = boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    out = b
    for o, s, lo, hi, pad in (("x", "w", "x1", "x2", pad_x), ("y", "h", "y1", "y2", pad_y)):
        size = F.col(hi) - F.col(lo)
        out = out.withColumns({o: (F.col(lo) - size * pad).cast("int"), s: (size + 2 * (size * pad)).cast("int")})
    out = out.drop("x1", "y1", "x2", "y2")
    for o, s, limit in (("x", "w", frame_w), ("y", "h", frame_h)):
        # A negative origin moves to zero without shrinking the box.
        out = out.withColumn(o, F.greatest(F.col(o), F.lit(0)))
        out = out.withColumn(s, F.when(F.col(o) + F.col(s) > limit, limit - F.col(o)).otherwise(F.col(s)))
    out = out.filter((F.col("w") > F.greatest(F.lit(0), F.lit(min_w))) & (F.col("h") > F.greatest(F.lit(0), F.lit(min_h))))
    for o, s, limit in (("x", "w", frame_w), ("y", "h", frame_h)):
        odd = F.col(s) % 2 == 1
        shift = odd & (F.col(o) + F.col(s) + 1 > limit)
        out = out.withColumns({o: F.when(shift, F.greatest(F.lit(0), F.col(o) - 1)).otherwise(F.col(o)),
                               s: F.when(odd, F.col(s) + 1).otherwise(F.col(s))})
    return out


def dominant_cluster(rows: DataFrame, keys: list[str], label: str = "cluster", noise: int = -1) -> DataFrame:
    """Most frequent label that is not noise, the lowest on ties; 0 where all is noise."""
    n = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.col(label), F.when(F.col(label) != noise, F.struct("_n", (-F.col(label)).alias("o"))))
    return n.groupBy(*keys).agg(F.coalesce(best, F.lit(0)).alias(label))


# ---- depth -------------------------------------------------------------------------------------

def depth_validity(depth: DataFrame, keys: list[str], value: str = "depth") -> DataFrame:
    """Pixel counts and range of each depth map; a map is one group by nature (height x width)."""
    d = F.col(value)
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    ok = finite & (d > 0)
    return depth.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(finite, 1)).alias("finite"), F.count(F.when(ok, 1)).alias("valid"),
        F.min(F.when(finite, d)).alias("min"), F.max(F.when(finite, d)).alias("max"),
        F.percentile(F.when(ok, d), F.lit(0.5)).alias("median_valid"))


def depth_scale(stats: DataFrame, keys: list[str], integer: bool, meta_scale: Column | None = None) -> DataFrame:
    """Factor to metres per recording, and whether every map is invalid (then it must not be used)."""
    mm = (F.col("median_valid") > 1000) | (F.lit(integer) & (F.coalesce("max", F.lit(0.0)) > 1000))
    out = stats.groupBy(*keys).agg(F.bool_or(F.coalesce(mm, F.lit(False))).alias("_mm"), F.bool_and(F.col("valid") == 0).alias("all_invalid"))
    meta = F.lit(None).cast("double") if meta_scale is None else meta_scale
    use = meta.isNotNull() & (meta != 0) & (meta != 1.0)
    return out.select(*keys, F.when(use, meta).when(F.col("_mm"), 0.001).otherwise(1.0).alias("factor"), "all_invalid")


# ---- sets of samples ---------------------------------------------------------------------------

def label_distribution(samples: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    return samples.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def value_counts(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Counts of every value of several fields, missing ones skipped."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    return docs.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


# Metadata fields that are counted.
META_FIELDS = [
    "image.action", "image.evaluation", "image.hitting", "environment.time", "environment.location",
    "environment.weather", "actor.grade", "actor.sex", "actor.age", "actor.size", "actor.height",
]


def has_points(annotations: Column) -> Column:
    """Whether any annotation carries points."""
    return F.coalesce(F.exists(annotations, lambda a: F.coalesce(F.length(F.regexp_replace(a["points"], r"[\[\]\s]", "")) > 0, F.lit(False))),
                      F.lit(False))


def id_integrity(rows: DataFrame, id_: str = "id") -> DataFrame:
    blank = F.col(id_).isNull() | (F.trim(F.col(id_).cast("string")) == "")
    per = rows.groupBy(id_).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum("_n").alias("n"), F.count(id_).alias("n_distinct"),
                   F.coalesce(F.sum(F.when(blank, F.col("_n"))), F.lit(0)).cast("long").alias("n_blank"))


def histogram(rows: DataFrame, value: str, by: str, bins: int = 30, density: bool = False) -> DataFrame:
    """Equal bins over each class's own range, the last one closed."""
    src = rows.filter(F.col(value).isNotNull())
    rng = src.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    rng = rng.withColumns({"_l": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
                           "_h": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    width = (F.col("_h") - F.col("_l")) / bins
    bin_ = F.least(F.floor((F.col(value) - F.col("_l")) / width), F.lit(bins - 1)).cast("int")
    out = src.join(rng, by).groupBy(by, bin_.alias("bin"), "_l", "_h", "_n").agg(F.count(F.lit(1)).alias("n"))
    cols = [by, "bin", (F.col("_l") + F.col("bin") * width).alias("low"), "n"]
    if density:
        cols.append((F.col("n") / (F.col("_n") * width)).alias("density"))
    return out.select(*cols)


def validate_samples(samples: DataFrame, joints: int = 17) -> DataFrame:
    """Violations of annotation rows (frame_dir, label, total_frames, keypoint[M][T][V][2])."""
    kp = F.col("keypoint")
    values = F.flatten(F.flatten(F.flatten(kp)))
    checks = {
        "missing_key": F.col("frame_dir").isNull() | F.col("label").isNull() | kp.isNull() | F.col("total_frames").isNull(),
        "no_frames": F.coalesce(F.col("total_frames"), F.lit(0)) <= 0,
        "wrong_shape": F.exists(kp, lambda m: F.exists(m, lambda t: (F.size(t) != joints) | F.exists(t, lambda v: F.size(v) != 2))),
        "frame_count": F.exists(kp, lambda m: F.size(m) != F.col("total_frames")),
        "not_finite": F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
        "all_zero": F.forall(values, lambda v: v == 0),
    }
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    return samples.select("frame_dir", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("violation"))
