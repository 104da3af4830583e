"""Queries on pose rows: cleaning, reshaping, smoothing, kinematics, metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from kinetra.catalog.registry import by_pi, query, r6
from kinetra.functions import rules
from kinetra.operators import clean, kinematics as K, reshape, smooth as S
from kinetra.operators.sequence import Sequence
from kinetra.plans import metrics as M
from kinetra.schema import KP17, Params
from kinetra.sources import fixtures as fx

W = "(PARTITION BY swing_id ORDER BY frame)"
WJ = "(PARTITION BY swing_id, joint_idx ORDER BY frame)"
P3, P2 = Params(), Params(dimension="2d")


def masked(spark, sf, by_frame: bool = False) -> DataFrame:
    return clean.mask_missing(fx.pose(spark, sf, by_frame))


def series(spark, sf) -> tuple[DataFrame, Sequence]:
    """The joints' image tracks with missing frames, as joint series."""
    df = masked(spark, sf)
    return (df.select("swing_id", "person_idx", "joint_idx", "frame", "x", "y"),
            fx.sequence(spark, sf, "swing_id", "person_idx", "joint_idx"))


def out(df: DataFrame, keys: str, vals: str) -> DataFrame:
    return df.select(*keys.split(), *[r6(v).alias(v) for v in vals.split()])


# ---- cleaning ----------------------------------------------------------------------------------

@query("prj5_zero_non_finite", """WITH $POSE SELECT swing_id, frame, joint_idx, r6(coalesce(X3, 0)) AS x, r6(coalesce(Y3, 0)) AS y FROM pose""")
def _(spark, sf):
    df = fx.pose(spark, sf).withColumns({"x": F.coalesce("X3", F.lit(float("nan"))), "y": F.col("Y3")})
    return out(clean.zero_non_finite(df), "swing_id frame joint_idx", "x y")


@query("prj6_mask_missing", "WITH $CLEAN SELECT swing_id, frame, joint_idx, r6(x) AS x, r6(conf) AS conf, r6(X3) AS x3 FROM clean")
def _(spark, sf):
    return masked(spark, sf).select("swing_id", "frame", "joint_idx", r6("x").alias("x"), r6("conf").alias("conf"), r6("X3").alias("x3"))


@query("prj7_mask_low_confidence", """WITH $POSE SELECT swing_id, frame, joint_idx,
 r6(CASE WHEN conf < 0.5 THEN NULL ELSE x END) AS x, r6(CASE WHEN conf < 0.5 THEN NULL ELSE Z3 END) AS z3 FROM pose""")
def _(spark, sf):
    return clean.mask_low_confidence(fx.pose(spark, sf), 0.5).select(
        "swing_id", "frame", "joint_idx", r6("x").alias("x"), r6("Z3").alias("z3"))


@query("prj8_zero_low_confidence", """WITH $POSE SELECT swing_id, frame, joint_idx,
 r6(CASE WHEN conf < 0.45 THEN 0 ELSE x END) AS x, r6(CASE WHEN conf < 0.45 THEN 0 ELSE conf END) AS conf FROM pose""")
def _(spark, sf):
    return out(clean.zero_low_confidence(fx.pose(spark, sf), 0.45), "swing_id frame joint_idx", "x conf")


@query("prj9_normalise_to_image", "WITH $CLEAN SELECT swing_id, frame, joint_idx, x / 1920 AS x, y / 1080 AS y FROM clean")
def _(spark, sf):
    # Plain quotients: both engines divide alike, but round halves differently.
    return clean.normalise_to_image(masked(spark, sf)).select("swing_id", "frame", "joint_idx", "x", "y")


@query("prj10_centre_on_joint", """WITH $POSE,
a AS (SELECT *, max(CASE WHEN joint_idx = 8 THEN x END) OVER w AS cx, max(CASE WHEN joint_idx = 8 THEN y END) OVER w AS cy
      FROM pose WINDOW w AS (PARTITION BY swing_id, frame)),
b AS (SELECT swing_id, frame, joint_idx, x - cx AS x, y - cy AS y FROM a),
t AS (SELECT swing_id, frame, x AS v FROM b UNION ALL SELECT swing_id, frame, y FROM b),
s AS (SELECT swing_id, frame, stddev_pop(v) AS s FROM t GROUP BY 1, 2)
SELECT swing_id, frame, joint_idx, r6(CASE WHEN s > 1e-5 THEN x / s ELSE x END) AS x, r6(CASE WHEN s > 1e-5 THEN y / s ELSE y END) AS y
FROM b JOIN s USING (swing_id, frame)""")
def _(spark, sf):
    return out(clean.centre_on_joint(fx.pose(spark, sf)), "swing_id frame joint_idx", "x y")


@query("prj11_match_distribution", """WITH $POSE,
t AS (SELECT swing_id, x AS v FROM pose UNION ALL SELECT swing_id, y FROM pose),
s AS (SELECT swing_id, avg(v) AS m, stddev_pop(v) AS s FROM t GROUP BY 1)
SELECT swing_id, frame, joint_idx, r6((x - m) / (s + 1e-8) * 0.25 + 0.5) AS x, r6((y - m) / (s + 1e-8) * 0.25 + 0.5) AS y
FROM pose JOIN s USING (swing_id)""")
def _(spark, sf):
    return out(clean.match_distribution(fx.pose(spark, sf), 0.5, 0.25, fx.sequence(spark, sf)), "swing_id frame joint_idx", "x y")


@query("prj12_primary_person", "WITH $POSE SELECT swing_id, count(*) AS n FROM pose WHERE person_idx = 0 GROUP BY 1")
def _(spark, sf):
    both = fx.pose(spark, sf)
    both = both.unionByName(both.withColumn("person_idx", F.lit(1)))
    return clean.primary_person(both).groupBy("swing_id").agg(F.count(F.lit(1)).alias("n"))


@query("prj17_min_length", "WITH $FRAMES SELECT swing_id, frame FROM frames WHERE n > 60")
def _(spark, sf):
    return clean.min_length(fx.frames(spark, sf), 60, True, fx.sequence(spark, sf)).select("swing_id", "frame")


@query("prj17_min_length_with_gaps", """WITH $FRAMES, g AS (SELECT swing_id, frame FROM frames WHERE frame % 3 <> 1), k AS (SELECT swing_id FROM g GROUP BY 1 HAVING count(*) >= 45)
SELECT swing_id, frame FROM g WHERE swing_id IN (SELECT swing_id FROM k)""")
def _(spark, sf):
    return clean.min_length(fx.frames(spark, sf).filter("frame % 3 <> 1"), 45, False, fx.sequence(spark, sf)).select("swing_id", "frame")


@query("prj18_reject_all_zero", """WITH $POSE, z AS (SELECT swing_id, frame, joint_idx, CASE WHEN swing_id % 5 = 0 THEN 0 ELSE x END AS x, CASE WHEN swing_id % 5 = 0 THEN 0 ELSE y END AS y FROM pose),
k AS (SELECT swing_id FROM z GROUP BY 1 HAVING bool_and(x = 0 AND y = 0))
SELECT swing_id, count(*) AS n, swing_id IN (SELECT swing_id FROM k) AS rejected FROM z GROUP BY 1""")
def _(spark, sf):
    blank = F.col("swing_id") % 5 == 0
    df = fx.pose(spark, sf).withColumns({c: F.when(blank, F.lit(0.0)).otherwise(F.col(c)) for c in ("x", "y")})
    kept, gone = clean.reject_all_zero(df, fx.sequence(spark, sf))
    sizes = df.groupBy("swing_id").agg(F.count(F.lit(1)).alias("n"))
    left = kept.groupBy("swing_id").agg(F.count(F.lit(1)).alias("n"))
    return (gone.join(sizes, "swing_id").select("swing_id", "n", F.lit(True).alias("rejected"))
            .unionByName(left.select("swing_id", "n", F.lit(False).alias("rejected"))))


@query("prj22_unit_scale", """SELECT l_orderkey, l_linenumber, l_partkey, r6(l_quantity * CASE l_suppkey % 4 WHEN 1 THEN 0.01 WHEN 2 THEN 0.001 ELSE 1 END) AS metres
FROM lineitem""")
def _(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("m", " CM", "Millimeters", "feet")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(F.col("l_quantity") * clean.unit_scale(unit)).alias("metres"))


@query("prj23_speed_units", "SELECT event_id, r6(value * 3.6) AS kmh, r6(value * 2.23694) AS mph FROM events")
def _(spark, sf):
    kmh, mph = clean.speed_units(F.col("value"))
    return fx.table(spark, sf, "events").select("event_id", r6(kmh).alias("kmh"), r6(mph).alias("mph"))


@query("prj24_deproject", """WITH $CLEAN, z AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 7 = 0 THEN NULL ELSE Z3 END AS d FROM clean)
SELECT swing_id, frame, joint_idx, r6(CASE WHEN d > 0 THEN (x - 959.5) * d / 1400 END) AS wx,
 r6(CASE WHEN d > 0 THEN (y - 539.5) * d / 1410 END) AS wy, r6(CASE WHEN d > 0 THEN d END) AS wz FROM z""")
def _(spark, sf):
    e = F.col("event_id")
    z = F.when(e % 13 == 0, F.lit(0.0)).when(e % 7 == 0, F.lit(float("nan"))).otherwise(F.col("Z3"))
    df = clean.deproject(masked(spark, sf).withColumn("d", z), F.lit(1400.0), F.lit(1410.0), F.lit(959.5), F.lit(539.5), F.col("d"))
    return df.select("swing_id", "frame", "joint_idx", r6("X3").alias("wx"), r6("Y3").alias("wy"), r6("Z3").alias("wz"))


@query("prj25_dimension", """WITH $POSE SELECT swing_id, bool_or(CASE WHEN swing_id % 2 = 0 THEN Z3 END IS NOT NULL) AS is_3d FROM pose GROUP BY 1""")
def _(spark, sf):
    df = fx.pose(spark, sf).withColumn("Z3", F.when(F.col("swing_id") % 2 == 0, F.col("Z3")))
    return clean.three_dimensional(df)


@query("prj26_normalised_flag", """WITH $CLEAN, s AS (SELECT swing_id, joint_idx, CASE WHEN swing_id % 2 = 0 THEN x / 1920 ELSE x END AS x,
 CASE WHEN swing_id % 2 = 0 THEN y / 1080 ELSE y END AS y FROM clean)
SELECT swing_id, max(abs(x)) < 1 AND max(abs(y)) < 2 AS is_normalised FROM s WHERE joint_idx < 10 GROUP BY 1""")
def _(spark, sf):
    even = F.col("swing_id") % 2 == 0
    df = masked(spark, sf).withColumns({"x": F.when(even, F.col("x") / 1920).otherwise(F.col("x")),
                                        "y": F.when(even, F.col("y") / 1080).otherwise(F.col("y"))})
    return clean.normalised_flag(df)


@query("prj27_fit_to_range", """WITH $CLEAN, s AS (SELECT swing_id, frame, joint_idx, CASE WHEN swing_id % 2 = 0 THEN x / 1920 ELSE x END AS x,
 CASE WHEN swing_id % 2 = 0 THEN y / 1080 ELSE y END AS y FROM clean),
r AS (SELECT swing_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM s GROUP BY 1)
SELECT swing_id, frame, joint_idx, r6(CASE WHEN greatest(abs(x0), abs(x1), abs(y0), abs(y1)) <= 2 THEN (0.1 + (x - x0) / (x1 - x0) * 0.8) * 1920 ELSE x END) AS x,
 r6(CASE WHEN greatest(abs(x0), abs(x1), abs(y0), abs(y1)) <= 2 THEN (0.1 + (y - y0) / (y1 - y0) * 0.8) * 1080 ELSE y END) AS y
FROM s JOIN r USING (swing_id)""")
def _(spark, sf):
    even = F.col("swing_id") % 2 == 0
    df = masked(spark, sf).withColumns({"x": F.when(even, F.col("x") / 1920).otherwise(F.col("x")),
                                        "y": F.when(even, F.col("y") / 1080).otherwise(F.col("y"))})
    return out(clean.fit_to_range(df, 1920, 1080, seq=fx.sequence(spark, sf)), "swing_id frame joint_idx", "x y")


# ---- reshape -----------------------------------------------------------------------------------

@query("rsh1_tidy_to_wide", "WITH $WIDE SELECT swing_id, frame, " + ", ".join(
    f"r6({j}_px) AS {j}_x, r6({j}_Z) AS {j}_z3" for j in KP17) + " FROM wide")
def _(spark, sf):
    w = reshape.tidy_to_wide(masked(spark, sf))
    return w.select("swing_id", "frame", *[c for j in KP17 for c in (r6(f"{j}_x").alias(f"{j}_x"), r6(f"{j}_Z3").alias(f"{j}_z3"))])


@query("rsh2_wide_to_long", "WITH $CLEAN SELECT swing_id, frame, joint_idx, r6(x) AS x, r6(y) AS y, r6(conf) AS conf FROM clean")
def _(spark, sf):
    w = reshape.tidy_to_wide(masked(spark, sf), axes="xyc")
    return out(reshape.wide_to_long(w, ["swing_id", "frame"], KP17), "swing_id frame joint_idx", "x y conf")


@query("rsh3_people_to_rows", "WITH $POSE SELECT swing_id, frame, 0 AS person_idx, joint_idx, r6(x) AS x, r6(y) AS y, r6(conf) AS conf FROM pose")
def _(spark, sf):
    flat = fx.pose(spark, sf).groupBy("swing_id", "frame").agg(
        F.sort_array(F.collect_list(F.struct("joint_idx", F.array("x", "y", "conf").alias("v")))).alias("j"))
    people = flat.select("swing_id", "frame", F.array(F.struct(F.flatten(F.transform("j", lambda r: r["v"])).alias("pose_keypoints_2d"))).alias("people"))
    return out(reshape.people_to_rows(people, ["swing_id", "frame"]), "swing_id frame person_idx joint_idx", "x y conf")


@query("rsh4_remap_joints", """WITH $POSE, m AS (SELECT * FROM (VALUES (0,0),(2,6),(3,8),(4,10),(5,5),(6,7),(7,9),(8,12),(9,14),(10,16),(11,11),(12,13),(13,15),(14,2),(15,1),(16,4),(17,3)) AS t(src, dst)),
s AS (SELECT swing_id, frame, CASE WHEN swing_id % 2 = 0 THEN joint_idx + 1 ELSE joint_idx END AS j, x FROM pose)
SELECT swing_id, frame, dst AS joint_idx, r6(x) AS x FROM s JOIN m ON j = src WHERE swing_id % 2 = 0
UNION ALL SELECT swing_id, frame, j, r6(x) FROM s WHERE swing_id % 2 = 1""")
def _(spark, sf):
    df = fx.pose(spark, sf).withColumn("joint_idx", F.col("joint_idx") + F.when(F.col("swing_id") % 2 == 0, 1).otherwise(0))
    return out(reshape.remap_detected(df, fx.sequence(spark, sf)), "swing_id frame joint_idx", "x")


@query("rsh6_virtual_joints", """WITH $WIDE SELECT swing_id, frame, r6((LShoulder_px + RShoulder_px) / 2) AS Neck_x, r6((LHip_py + RHip_py) / 2) AS MidHip_y FROM wide""")
def _(spark, sf):
    w = reshape.virtual_joints(reshape.tidy_to_wide(masked(spark, sf), axes="xy"))
    return out(w, "swing_id frame", "Neck_x MidHip_y")


def weighted(frames):
    """Sum over all frames and joints of value * frame * joint, both counted from 1: any cell out of place shows."""
    return F.aggregate(F.transform(frames, lambda f, t: F.aggregate(
        F.transform(f, lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v) * (t + 1)), F.lit(0.0), lambda a, v: a + v)


@query("rsh7_assemble_tensor", """WITH $POSE SELECT swing_id, CAST(max(frame) + 1 AS BIGINT) AS total_frames, 17 AS joints,
 r6(sum(CAST(x AS FLOAT)::DOUBLE * (frame + 1) * (joint_idx + 1)) / 1000000) AS xs, r6(sum(CAST(conf AS FLOAT)::DOUBLE * (frame + 1) * (joint_idx + 1)) / 1000000) AS scores FROM pose GROUP BY 1""")
def _(spark, sf):
    t = reshape.assemble_tensor(fx.pose(spark, sf), ["swing_id"])
    return t.select("swing_id", F.col("total_frames").cast("long").alias("total_frames"),
                    F.size(F.col("keypoint")[0][0]).alias("joints"),
                    r6(weighted(F.transform(F.col("keypoint")[0], lambda f: F.transform(f, lambda j: j[0].cast("double")))) / 1000000).alias("xs"),
                    r6(weighted(F.transform(F.col("keypoint_score")[0], lambda f: F.transform(f, lambda c: c.cast("double")))) / 1000000).alias("scores"))


@query("rsh8_frame_map", """WITH $WIDE SELECT swing_id, '{' || string_agg('"' || frame || '":{"seen":' || CASE WHEN Nose_X IS NULL THEN 'null' ELSE 'true' END || '}', ',' ORDER BY frame) || '}' AS document
FROM wide GROUP BY 1""")
def _(spark, sf):
    w = reshape.tidy_to_wide(masked(spark, sf), ["Nose"], "X").withColumn("seen", F.when(F.col("Nose_X3").isNotNull(), True))
    return reshape.frame_map(w, ["swing_id"], ["seen"]).select("swing_id", "document")


@query("rsh9_flatten_document", "WITH $FRAMES SELECT swing_id, frame, r6(v) AS v FROM frames")
def _(spark, sf):
    maps = reshape.frame_map(fx.frames(spark, sf), ["swing_id"], ["v"])
    docs = maps.withColumn("doc", F.concat(F.lit('{"other":{},"speed_timeseries":'), F.col("document"), F.lit("}")))
    return out(reshape.flatten_document(docs, ["swing_id"], "doc", "struct<v:double>"), "swing_id frame", "v")


# ---- smoothing ---------------------------------------------------------------------------------

def _series_sql(expr_x: str, cte: str = "") -> str:
    return f"""WITH $CLEAN, s AS (SELECT swing_id, joint_idx, frame, x, y FROM clean){cte}
SELECT swing_id, joint_idx, frame, {expr_x}"""


def _per_axis(template: str) -> str:
    return ", ".join(f"r6({template.replace('@', a)}) AS {a}" for a in "xy")


_FILL = """,
nb AS (SELECT *, """ + ", ".join(f"""
 last_value(CASE WHEN {a} IS NOT NULL THEN frame END IGNORE NULLS) OVER up AS bp_{a}, last_value({a} IGNORE NULLS) OVER up AS bv_{a},
 first_value(CASE WHEN {a} IS NOT NULL THEN frame END IGNORE NULLS) OVER dn AS ap_{a}, first_value({a} IGNORE NULLS) OVER dn AS av_{a}""" for a in "xy") + f"""
 FROM s WINDOW up AS (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 dn AS (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT swing_id, joint_idx, frame, """ + ", ".join(f"""
 coalesce({a}, CASE WHEN bp_{a} IS NOT NULL AND ap_{a} IS NOT NULL THEN bv_{a} + (av_{a} - bv_{a}) * (frame - bp_{a}) / (ap_{a} - bp_{a}) END, bv_{a}, av_{a}) AS {a},
 {a} AS raw_{a}, frame - bp_{a} AS db_{a}, ap_{a} - frame AS da_{a}""" for a in "xy") + " FROM nb)"


@query("win10_interpolate", _series_sql("r6(x) AS x, r6(y) AS y FROM f", _FILL))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.interpolate(df, ["x", "y"], seq), "swing_id joint_idx frame", "x y")


@query("win10_interpolate_limit", _series_sql(_per_axis("coalesce(CASE WHEN coalesce(db_@ <= 1, false) OR coalesce(da_@ <= 1, false) THEN @ END, 0)") + " FROM f", _FILL))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.interpolate(df, ["x", "y"], seq, limit=1, fill="zero"), "swing_id joint_idx frame", "x y")


_C5 = "OVER (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query("win3_median_then_mean", _series_sql(_per_axis(f"avg(@) {_C5}") + " FROM m", f""",
m AS (SELECT swing_id, joint_idx, frame, quantile_cont(x, 0.5) {_C5} AS x, quantile_cont(y, 0.5) {_C5} AS y FROM s)"""))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(seq.done(S.median_then_mean(seq.lay_out(df, 4, 4), ["x", "y"], seq)), "swing_id joint_idx frame", "x y")


@query("win4_moving_mean", _series_sql(_per_axis("avg(@) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)") + " FROM s"))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.moving(df, ["x", "y"], 5, seq=seq), "swing_id joint_idx frame", "x y")


@query("win4_moving_median_even", _series_sql(_per_axis("quantile_cont(@, 0.5) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)") + " FROM s"))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.moving(df, ["x", "y"], 4, True, "median", seq), "swing_id joint_idx frame", "x y")




@query("win5_ema", """WITH RECURSIVE $CLEAN, s AS (SELECT swing_id, joint_idx, frame, x FROM clean),
v AS (SELECT *, row_number() OVER w - 1 AS k, frame - lag(frame) OVER w AS gap FROM s WHERE x IS NOT NULL WINDOW w AS (PARTITION BY swing_id, joint_idx ORDER BY frame)),
r AS (SELECT swing_id, joint_idx, frame, k, x AS y FROM v WHERE k = 0
      UNION ALL SELECT v.swing_id, v.joint_idx, v.frame, v.k, (pow(0.8, v.gap) * r.y + 0.2 * v.x) / (pow(0.8, v.gap) + 0.2)
      FROM r JOIN v ON v.swing_id = r.swing_id AND v.joint_idx = r.joint_idx AND v.k = r.k + 1)
SELECT s.swing_id, s.joint_idx, s.frame, r6(last_value(r.y IGNORE NULLS) OVER (PARTITION BY s.swing_id, s.joint_idx ORDER BY s.frame)) AS x
FROM s LEFT JOIN r ON r.swing_id = s.swing_id AND r.joint_idx = s.joint_idx AND r.frame = s.frame""")
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.ema(df, ["x"], 0.2, "decay", seq), "swing_id joint_idx frame", "x")


@query("win5_ema_hold", """WITH RECURSIVE $CLEAN, s AS (SELECT swing_id, joint_idx, frame, x FROM clean),
v AS (SELECT *, row_number() OVER (PARTITION BY swing_id, joint_idx ORDER BY frame) - 1 AS k FROM s WHERE x IS NOT NULL),
r AS (SELECT swing_id, joint_idx, frame, k, x AS y FROM v WHERE k = 0
      UNION ALL SELECT v.swing_id, v.joint_idx, v.frame, v.k, 0.25 * v.x + 0.75 * r.y
      FROM r JOIN v ON v.swing_id = r.swing_id AND v.joint_idx = r.joint_idx AND v.k = r.k + 1)
SELECT s.swing_id, s.joint_idx, s.frame, r6(coalesce(last_value(r.y IGNORE NULLS) OVER w, first_value(r.y IGNORE NULLS)
 OVER (PARTITION BY s.swing_id, s.joint_idx ORDER BY s.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / pi()) AS x
FROM s LEFT JOIN r ON r.swing_id = s.swing_id AND r.joint_idx = s.joint_idx AND r.frame = s.frame
WINDOW w AS (PARTITION BY s.swing_id, s.joint_idx ORDER BY s.frame)""")
def _(spark, sf):
    # Quarters of quarters end at any decimal; as multiples of pi no value lies on a tie of the sixth.
    df, seq = series(spark, sf)
    held = S.ema(df, ["x"], 0.25, "hold", seq)
    return held.select("swing_id", "joint_idx", "frame", by_pi("x").alias("x"))


_EDGE = """,
e AS (SELECT swing_id, joint_idx, frame, x AS raw, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame),
 first_value(x IGNORE NULLS) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM s)"""
_K = S.gaussian_kernel(5, None, True)


@query("win6_gaussian", _series_sql("r6(CASE WHEN raw IS NOT NULL THEN " + " + ".join(
    f"{k!r} * coalesce({'lag' if i < 2 else 'lead'}(x, {abs(i - 2)}) OVER {WJ}, 0)" for i, k in enumerate(_K)) + " END) AS x FROM e", _EDGE))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.gaussian(df, ["x"], 5, seq=seq), "swing_id joint_idx frame", "x")


@query("win7_hampel", _series_sql("r6(CASE WHEN d > 1.4826 * mad * 3.0 THEN med ELSE x END) AS x FROM h2", f""",
h0 AS (SELECT *, quantile_cont(x, 0.5) {_C5} AS med FROM s), h1 AS (SELECT *, abs(x - med) AS d FROM h0),
h2 AS (SELECT *, quantile_cont(d, 0.5) {_C5} AS mad FROM h1)"""))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.hampel(df, ["x"], 5, seq=seq), "swing_id joint_idx frame", "x")


_DT = 1.0 / 30.0


def _gain(cut: str) -> str:
    return f"(1.0e0 / (1.0e0 + (1.0e0 / (6.283185307179586e0 * ({cut}))) / {_DT!r}))"


@query("win8_one_euro_raw", f"""WITH RECURSIVE $CLEAN, s AS (SELECT swing_id, joint_idx, frame, x FROM clean){_EDGE},
r AS (SELECT swing_id, joint_idx, frame, raw, x, x AS y, 0e0 AS dh FROM e WHERE frame = 0
      UNION ALL SELECT q.swing_id, q.joint_idx, q.frame, q.raw, q.x,
        {_gain('1.0e0 + 0.007e0 * abs(q.dh)')} * q.x + (1 - {_gain('1.0e0 + 0.007e0 * abs(q.dh)')}) * q.py, q.dh
      FROM (SELECT e.*, r.y AS py, {_gain('1.0e0')} * ((e.x - r.x) / {_DT!r}) + (1 - {_gain('1.0e0')}) * r.dh AS dh
            FROM r JOIN e ON e.swing_id = r.swing_id AND e.joint_idx = r.joint_idx AND e.frame = r.frame + 1) q)
SELECT swing_id, joint_idx, frame, r6(CASE WHEN raw IS NOT NULL THEN y END) AS x FROM r""")
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.one_euro(df, ["x"], 30.0, seq=seq), "swing_id joint_idx frame", "x")


@query("win8_one_euro_filtered", f"""WITH RECURSIVE $CLEAN, s AS (SELECT swing_id, joint_idx, frame, x FROM clean),
v AS (SELECT *, row_number() OVER (PARTITION BY swing_id, joint_idx ORDER BY frame) - 1 AS k FROM s WHERE x IS NOT NULL),
r AS (SELECT swing_id, joint_idx, frame, k, x AS y, 0e0 AS dh FROM v WHERE k = 0
      UNION ALL SELECT q.swing_id, q.joint_idx, q.frame, q.k,
        {_gain('1.0e0 + 0.007e0 * abs(q.dh)')} * q.x + (1 - {_gain('1.0e0 + 0.007e0 * abs(q.dh)')}) * q.py, q.dh
      FROM (SELECT v.*, r.y AS py, {_gain('1.0e0')} * (v.x - r.y) + (1 - {_gain('1.0e0')}) * r.dh AS dh
            FROM r JOIN v ON v.swing_id = r.swing_id AND v.joint_idx = r.joint_idx AND v.k = r.k + 1) q)
SELECT s.swing_id, s.joint_idx, s.frame, r6(coalesce(last_value(r.y IGNORE NULLS) OVER w, first_value(r.y IGNORE NULLS)
 OVER (PARTITION BY s.swing_id, s.joint_idx ORDER BY s.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS x
FROM s LEFT JOIN r ON r.swing_id = s.swing_id AND r.joint_idx = s.joint_idx AND r.frame = s.frame
WINDOW w AS (PARTITION BY s.swing_id, s.joint_idx ORDER BY s.frame)""")
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.one_euro(df, ["x"], 30.0, variant="filtered", seq=seq), "swing_id joint_idx frame", "x")


_JUMP = """,
j0 AS (SELECT *, CASE WHEN frame = 0 THEN 0 ELSE x - lag(x) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame) END AS d FROM f),
j1 AS (SELECT *, quantile_cont(abs(d), 0.5) OVER (PARTITION BY swing_id, joint_idx) AS med FROM j0),
j2 AS (SELECT *, med + 5 * 1.4826 * quantile_cont(abs(abs(d) - med), 0.5) OVER (PARTITION BY swing_id, joint_idx) AS thr FROM j1),
j3 AS (SELECT *, sum(CASE WHEN abs(d) > thr THEN 0 ELSE 1 END) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame) AS island FROM j2),
j4 AS (SELECT swing_id, joint_idx, frame, raw_x, first_value(x) OVER w + sum(CASE WHEN abs(d) > thr THEN sign(d) * thr ELSE 0 END) OVER w AS x
       FROM j3 WINDOW w AS (PARTITION BY swing_id, joint_idx, island ORDER BY frame))"""


@query("win9_suppress_jumps", _series_sql("r6(x) AS x FROM j4", _FILL + _JUMP))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.suppress_jumps(S.interpolate(df, ["x", "y"], seq), ["x"], seq=seq), "swing_id joint_idx frame", "x")


@query("win11_smooth_chain", _series_sql(
    "r6(avg(x) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS x FROM j4", _FILL + _JUMP))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.smooth(df, ["x"], "moving", 5, family="com", seq=seq), "swing_id joint_idx frame", "x")


@query("win11_smooth_chain_swing", _series_sql(
    """r6(CASE WHEN raw_x IS NOT NULL THEN avg(x) OVER (PARTITION BY swing_id, joint_idx ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END) AS x FROM j4""", _FILL + _JUMP))
def _(spark, sf):
    df, seq = series(spark, sf)
    return out(S.smooth(df, ["x"], "moving", 5, family="swing", seq=seq), "swing_id joint_idx frame", "x")
