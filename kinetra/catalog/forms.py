"""Queries on the forms that data arrives in: text lines, documents, column names of other tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.catalog.motion import masked
from kinetra.catalog.registry import query, r6
from kinetra.functions import rules
from kinetra.operators import reshape
from kinetra.schema import KP17, PREDICTION
from kinetra.sources import fixtures as fx, readers

_LINE = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS q, l_suppkey AS s FROM lineitem)"""


@query("src4_flat_lines", f"""WITH {_LINE},
t AS (SELECT *, l_partkey % 3 AS k FROM lines)
SELECT l_orderkey, l_linenumber, 0 AS joint_idx, CAST(q AS DOUBLE) AS x, CAST(s AS DOUBLE) AS y, CASE WHEN k = 0 THEN CAST(0.5 AS DOUBLE) END AS conf FROM t WHERE k < 2
UNION ALL SELECT l_orderkey, l_linenumber, 1, CAST(l_partkey AS DOUBLE), CAST(q AS DOUBLE), CASE WHEN k = 0 THEN CAST(0.25 AS DOUBLE) END FROM t WHERE k < 2
UNION ALL SELECT l_orderkey, l_linenumber, CAST(j AS INT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), NULL FROM t, (SELECT unnest(range(0, 25)) AS j) WHERE k = 2""")
def _(spark, sf):
    q, s, p = F.col("l_quantity").cast("int"), F.col("l_suppkey"), F.col("l_partkey")
    text = (F.when(p % 3 == 0, F.concat_ws(",", q, s, F.lit("0.5"), p, q, F.lit("0.25")))
            .when(p % 3 == 1, F.concat_ws(",", q, F.lit("none"), s, p, F.lit(""), q)).otherwise(F.lit("broken")))
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("value"))
    return readers.flat_rows(lines, ["l_orderkey", "l_linenumber"])


_AXES = [f"{j}_{a}" for j in KP17 for a in ("px", "py")]


@query("src3_files_with_own_headers", "WITH $WIDE SELECT 's' || swing_id AS swing_id, CAST(frame + CASE WHEN swing_id % 4 = 3 THEN 100 ELSE 0 END AS INT) AS frame, "
       + ", ".join(f"r6({c}) AS {c[:-2]}{c[-1]}" for c in _AXES) + ", CASE WHEN swing_id % 4 = 1 THEN 'a,\"b\" ' || frame END AS note FROM wide")
def _(spark, sf):
    """Four header forms: x before y, tabs with y before x, a byte-order mark with quotes and blanks, columns from the last joint on with a frame of their own."""
    wide = reshape.tidy_to_wide(masked(spark, sf), axes="xy")
    names = [f"{j}_{a}" for j in KP17 for a in "xy"]
    swapped = [f"{j}_{a}" for j in KP17 for a in "yx"]
    note = F.concat(F.lit('"a,""b"" '), F.col("frame").cast("string"), F.lit('"'))
    forms = [(",", names, "{}", "", []), (",", [*names, "note"], " {} ", "\ufeff", [note]), ("\t", swapped, "{}", "", []), (",", [*names[::-1], "frame"], '"{}"', "", [])]

    def line(form, head: bool):
        sep, cols, quote, mark, own = form
        if head:
            return F.lit(mark + sep.join(quote.format(c) for c in cols))
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols if c in names] + own
        return F.concat_ws(sep, *cells, *([(F.col("frame") + 100).cast("string")] if "frame" in cols else []))

    def text(head: bool):
        out = F.lit(None).cast("string")
        for k, form in enumerate(forms):
            out = F.when(F.col("swing_id") % 4 == k, line(form, head)).otherwise(out)
        return out

    file = F.concat(F.lit("s"), F.col("swing_id").cast("string")).alias("file")
    body = wide.select(file, F.floor(F.col("frame") / 32).alias("part"), F.col("frame").alias("at"), text(False).alias("value"))
    heads = wide.select("swing_id").distinct().select(file, F.lit(0).cast("long").alias("part"), F.lit(-1).alias("at"), text(True).alias("value"))
    rows = readers.headed_rows(body.unionByName(heads), "file", "part", "at")
    return rows.select(F.col("file").alias("swing_id"), "frame", *[r6(F.col(c).cast("double")).alias(c) for c in names], "note")


@query("src5_id_lines", "SELECT source || '_' || doc_id AS id FROM documents WHERE doc_id % 4 <> 0")
def _(spark, sf):
    named = F.concat(F.lit("  "), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(" "))
    lines = fx.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.lit("   ")).otherwise(named).alias("value"))
    return readers.listed_ids(lines)


@query("src9_intrinsics", """SELECT c_custkey, 640 AS width, 480 AS height, CAST(c_custkey AS DOUBLE) AS fx, CAST(600 AS DOUBLE) AS fy, CAST(320 AS DOUBLE) AS cx, CAST(c_nationkey AS DOUBLE) AS cy, 30 AS fps
FROM customer WHERE c_custkey % 6 < 5 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, 30 FROM customer WHERE c_custkey % 6 = 5""")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit('"width":640,"height":480,"fx":'), k, F.lit(',"fy":600.0,"cx":320,"cy":'), F.col("c_nationkey").cast("string"))
    names = F.array(*[F.lit(n) for n in ("color_intrinsics", "intrinsics", "intrinsics_color", "camera_intrinsics")])
    kind = (F.col("c_custkey") % 6).cast("int")
    inner = (F.when(kind < 4, F.concat(F.lit('"'), F.get(names, kind), F.lit('":{'), body, F.lit("}")))
             .when(kind == 4, body).otherwise(F.concat(F.lit('"width":640,"fx":'), k)))
    doc = F.from_json(F.concat(F.lit('{"meta":{"fps":30},'), inner, F.lit("}")), readers.intrinsics_schema())
    docs = fx.table(spark, sf, "customer").select("c_custkey", doc.alias("d")).select("c_custkey", "d.*")
    return readers.pick_intrinsics(docs, ["c_custkey"]).select("c_custkey", "width", "height", "fx", "fy", "cx", "cy", F.col("meta.fps").alias("fps"))


@query("src10_prediction_documents", """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 3 AS INT) AS clip, CAST(doc_id % 5 AS INT) AS gt, CAST(n_chars % 5 AS INT) AS pred,
 CASE WHEN doc_id % 7 > 0 THEN [CAST(n_chars AS DOUBLE), CAST(0.5 AS DOUBLE)][1 + doc_id % 2] END AS score FROM documents""")
def _(spark, sf):
    d = F.col("doc_id")
    scores = F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit(",0.5]"))
    key = F.when(d % 7 == 0, F.lit('"other":')).when(d % 7 < 4, F.lit('"pred_score":')).otherwise(F.lit('"pred_scores":'))
    doc = F.concat(F.lit('{"id":"'), d.cast("string"), F.lit('","clip":'), (d % 3).cast("string"), F.lit(',"gt_label":'), (d % 5).cast("string"),
                   F.lit(',"pred_label":'), (F.col("n_chars") % 5).cast("string"), F.lit(","), key, scores, F.lit("}"))
    parsed = fx.table(spark, sf, "documents").select("doc_id", F.from_json(doc, PREDICTION).alias("p")).select("doc_id", "p.*")
    rows = readers.prediction_rows(parsed)
    return rows.select("id", "clip", "gt", "pred", F.get("scores", (F.col("id").cast("long") % 2).cast("int")).alias("score"))


@query("prj1_resolved_axes", "WITH $WIDE SELECT swing_id, frame, " + ", ".join(f"{j}_px AS {j}_x, {j}_py AS {j}_y" for j in KP17) + " FROM wide")
def _(spark, sf):
    # Three spellings side by side, and a second family for one joint that has no y.
    style = ("{}__{}", "{}_{}3D", "{}_{}")
    names = {f"{j}_{a}": style[i % 3].format(j, a.upper() if i % 3 == 1 else a) for i, j in enumerate(KP17) for a in "xy"}
    wide = reshape.tidy_to_wide(masked(spark, sf), axes="xy").withColumnsRenamed(names).withColumn("Nose_X3D", F.lit(0.0))
    axes = reshape.resolve_axes(wide.columns, prefer_2d=True)
    return wide.select("swing_id", "frame", *[F.col(axes[j][a]).alias(f"{j}_{a}") for j in KP17 for a in "xy"])


@query("prj2_canonical_names", "WITH $WIDE SELECT swing_id, frame, " + ", ".join(f"{j}_px AS {j}_x, {j}_py AS {j}_y" for j in KP17[:9]) + " FROM wide")
def _(spark, sf):
    wide = reshape.tidy_to_wide(masked(spark, sf), KP17[:9], "xy")
    odd = wide.withColumnsRenamed({c: c.upper() if i % 2 else c.lower() for i, c in enumerate(wide.columns) if c not in ("swing_id", "frame")})
    return odd.withColumnsRenamed(reshape.canonical_names(odd.columns)).select("swing_id", "frame", *[f"{j}_{a}" for j in KP17[:9] for a in "xy"])


@query("prj3_sanitised", "WITH $WIDE SELECT swing_id, frame, Nose_px AS Nose_x, CAST(NULL AS DOUBLE) AS Nose_y, CAST(0 AS DOUBLE) AS Nose_c, "
       "CASE WHEN frame % 2 = 0 THEN LWrist_py END AS LWrist_y, CAST(0 AS DOUBLE) AS REye_c, 51 AS n FROM wide")
def _(spark, sf):
    wide = reshape.tidy_to_wide(masked(spark, sf), ["Nose", "LWrist"], "xy")
    odd = wide.select("swing_id", "frame", F.col("Nose_x").cast("string").alias("nose__x"),
                      F.when(F.col("frame") % 2 == 0, F.col("LWrist_y").cast("string")).otherwise(F.lit("bad")).alias("LWRIST_Y"), F.lit("?").alias("Nose_conf"))
    clean = reshape.sanitise(odd, ["swing_id", "frame"])
    return clean.select("swing_id", "frame", "Nose_x", "Nose_y", "Nose_c", "LWrist_y", "REye_c", F.lit(len(clean.columns) - 2).alias("n"))


_ALL = ", ".join(f"{j}_px AS {j}_x, {j}_py AS {j}_y" for j in KP17)


@query("prj2_all_joints", f"WITH $WIDE SELECT swing_id, frame, {_ALL} FROM wide")
def _(spark, sf):
    wide = reshape.tidy_to_wide(masked(spark, sf), axes="xy")
    odd = wide.withColumnsRenamed({c: c.upper() if i % 2 else c.lower() for i, c in enumerate(wide.columns) if c not in ("swing_id", "frame")})
    return odd.withColumnsRenamed(reshape.canonical_names(odd.columns)).select("swing_id", "frame", *[f"{j}_{a}" for j in KP17 for a in "xy"])


@query("prj3_all_columns", f"WITH $WIDE SELECT swing_id, frame, {_ALL}, " + ", ".join(
    f"CAST({i / 4 if i % 3 else 0} AS DOUBLE) AS {j}_c" for i, j in enumerate(KP17)) + " FROM wide")
def _(spark, sf):
    """Every joint under another spelling; a third of them has no confidence."""
    wide = reshape.tidy_to_wide(masked(spark, sf), axes="xy")
    x, y, c = ("{}__x", "{}_X", "{}_x"), ("{}_Y", "{}__y", "{}_y"), ("", "{}_conf", "{}_SCORE")
    odd = wide.select("swing_id", "frame", *[F.col(f"{j}_{a}").cast("string").alias(form[i % 3].format(j.lower() if i % 2 else j))
                                             for i, j in enumerate(KP17) for a, form in (("x", x), ("y", y))],
                      *[F.lit(str(i / 4)).alias(c[i % 3].format(j)) for i, j in enumerate(KP17) if i % 3])
    return reshape.sanitise(odd, ["swing_id", "frame"])


@query("prj4_missing_columns", "WITH $FRAMES SELECT DISTINCT swing_id, name FROM frames, (VALUES ('LHip_x'), ('LHip_y'), ('LHip_c')) AS v(name)")
def _(spark, sf):
    wide = reshape.tidy_to_wide(masked(spark, sf), [j for j in KP17 if j != "LHip"], "xyc")
    missing = reshape.missing_columns(wide.columns)
    return wide.select("swing_id").distinct().select("swing_id", F.explode(F.array(*[F.lit(c) for c in missing])).alias("name"))


@query("rsh5_landmark_names", "WITH $WIDE SELECT swing_id, frame, r6(Nose_px) AS nose_x, r6(LShoulder_py) AS left_shoulder_y, r6(RHip_px) AS right_hip_x FROM wide")
def _(spark, sf):
    wide = reshape.tidy_to_wide(masked(spark, sf), ["Nose", "LShoulder", "RHip"], "xy")
    marks = wide.withColumnsRenamed({"Nose_x": "landmark_0_x", "LShoulder_y": "landmark_11_y", "RHip_x": "landmark_24_x"})
    return reshape.rename_landmarks(marks).select("swing_id", "frame", *[r6(c).alias(c) for c in ("nose_x", "left_shoulder_y", "right_hip_x")])


def _advice() -> str:
    at = ("value IS NULL", "value < 25", "value <= 40", "value <= 50", "true")
    case = lambda pick: " ".join(f"WHEN {c} THEN '{pick(row)}'" for c, row in zip(at, rules.XFACTOR))
    return (f"SELECT event_id, CASE {case(lambda r: r[0])} END AS \"range\", CASE {case(lambda r: r[1])} END AS label, "
            f"CASE {case(lambda r: '|'.join(r[2]))} END AS advice FROM events")


@query("sc4_xfactor_advice", _advice())
def _(spark, sf):
    c = rules.xfactor_category(F.col("value"))
    return fx.table(spark, sf, "events").select("event_id", c["range"].alias("range"), c["label"].alias("label"), F.array_join(c["messages"], "|").alias("advice"))
