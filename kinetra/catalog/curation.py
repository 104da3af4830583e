"""Queries on files, labels, joins, sampling and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.catalog.registry import query, r6
from kinetra.functions import rules
from kinetra.operators import curate as C, pairing as P, reshape, sample as SM, sets
from kinetra.operators.sequence import Sequence, cut_lineage, number_rows
from kinetra.schema import LABEL_JSON
from kinetra.sources import fixtures as fx


def file_seq(spark, sf) -> Sequence:
    """Numbered files: the longest sequence is read off the highest file number."""
    return Sequence(("prefix",), "frame_no").measured(fx.files(spark, sf))


def docs(spark, sf):
    return fx.meta(spark, sf).withColumn("d", F.from_json("doc", LABEL_JSON))


# ---- labels and names --------------------------------------------------------------------------

SPELL = "list_extract(['best', 'Good', 'normal', 'BAD', 'worst', '', 'other'], CAST(event_id % 7 + 1 AS INT))"


@query("prj13_evaluation_class", f"""WITH $FRAMES, s AS (SELECT event_id, lower({SPELL}) AS e FROM frames)
SELECT event_id, CASE WHEN e IN ('best', 'good', 'normal') THEN 'true' WHEN e IN ('bad', 'worst') THEN 'false' WHEN e = '' THEN 'unknown' ELSE 'other' END AS class FROM s""")
def _(spark, sf):
    return docs(spark, sf).select("event_id", rules.evaluation_class(F.col("d.image.evaluation")).alias("class"))


_PATHS = """p AS (SELECT doc_id, '/data/' || list_extract(['worst', 'bad', 'misc', 'good/best', 'best'], CAST(doc_id % 5 + 1 AS INT)) || '/' || source AS path FROM documents)"""


@query("prj14_label_from_path", f"""WITH {_PATHS}, s AS (SELECT doc_id, string_split(path, '/') AS a FROM p)
SELECT doc_id, CASE WHEN list_contains(a, 'worst') THEN 0 WHEN list_contains(a, 'bad') THEN 1 WHEN list_contains(a, 'normal') THEN 2 WHEN list_contains(a, 'good') THEN 3 WHEN list_contains(a, 'best') THEN 4 ELSE 2 END AS label5,
 CASE WHEN list_contains(a, 'worst') OR list_contains(a, 'bad') THEN 0 WHEN list_contains(a, 'normal') THEN 1 WHEN list_contains(a, 'good') OR list_contains(a, 'best') THEN 2 ELSE 1 END AS label3 FROM s""")
def _(spark, sf):
    part = F.element_at(F.array(*[F.lit(x) for x in ("worst", "bad", "misc", "good/best", "best")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), part, F.lit("/"), F.col("source"))
    return fx.table(spark, sf, "documents").select("doc_id", rules.label_from_path(path).alias("label5"), rules.label_from_path(path, 3).alias("label3"))


@query("prj15_label_remaps", """WITH $PREDS SELECT id, clip, pred, CASE WHEN pred <= 1 THEN 0 WHEN pred = 2 THEN 1 WHEN pred <= 4 THEN 2 END AS three,
 CASE WHEN pred IS NOT NULL THEN CAST(pred >= 2 AS INT) END AS two, CASE WHEN pred IS NOT NULL THEN CAST(pred > 2 AS INT) END AS two_alt FROM preds""")
def _(spark, sf):
    p = F.col("pred")
    return fx.preds(spark, sf).select("id", "clip", "pred", rules.to_three(p).alias("three"), rules.to_two(p).alias("two"), rules.to_two(p, True).alias("two_alt"))


@query("prj16_class_subset", "WITH $SAMPLES SELECT id, label5 FROM samples WHERE label5 NOT IN (3, 4)")
def _(spark, sf):
    return fx.samples(spark, sf).filter(~F.col("label5").isin(3, 4)).select("id", "label5")


@query("prj19_drop_short_clips", "SELECT event_id, r6(value / 10 - 1) AS duration FROM events WHERE NOT (value / 10 - 1 > 0 AND value / 10 - 1 < 1.5)")
def _(spark, sf):
    clips = fx.table(spark, sf, "events").select("event_id", (F.col("value") / 10 - 1).alias("duration"))
    return C.drop_short_clips(clips).select("event_id", r6("duration").alias("duration"))


@query("prj20_title_and_frame", "WITH $FILES SELECT event_id, prefix AS title, frame_no FROM files")
def _(spark, sf):
    title, number = rules.title_and_frame(F.col("stem"))
    return fx.files(spark, sf).select("event_id", title.alias("title"), number.alias("frame_no"))


@query("prj20_crop_names", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'v_part' || lpad(l_linenumber::VARCHAR, 2, '0') || '_person' || lpad((l_partkey % 9)::VARCHAR, 2, '0')
 ELSE 'v_person' || lpad((l_partkey % 9)::VARCHAR, 2, '0') || '_crop' END AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS part, CAST(l_partkey % 9 AS INT) AS person FROM s""")
def _(spark, sf):
    n, p = F.col("l_linenumber"), F.lpad((F.col("l_partkey") % 9).cast("string"), 2, "0")
    name = F.when(n % 2 == 0, F.concat(F.lit("v_part"), F.lpad(n.cast("string"), 2, "0"), F.lit("_person"), p)).otherwise(
        F.concat(F.lit("v_person"), p, F.lit("_crop")))
    c = rules.crop_name(name)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c["part"].alias("part"), c["person"].alias("person"))


@query("prj21_source_path", "WITH $FILES SELECT event_id, replace(replace(path, '[라벨]', '[원천]'), '.json', '.jpg') AS image_path FROM files")
def _(spark, sf):
    return fx.files(spark, sf).select("event_id", rules.source_path(F.col("path")).alias("image_path"))


@query("prj28_parse_scalar", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50)::VARCHAR WHEN 1 THEN (event_id % 50)::VARCHAR || '.25' WHEN 2 THEN NULL ELSE 'x' || (event_id % 9)::VARCHAR END AS parsed FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    t = (F.when(e % 4 == 0, F.concat((e % 50).cast("string"), F.lit(".0"))).when(e % 4 == 1, F.concat((e % 50).cast("string"), F.lit(".25")))
         .when(e % 4 == 2, F.lit(" ")).otherwise(F.concat(F.lit("x"), (e % 9).cast("string"))))
    return fx.table(spark, sf, "events").select("event_id", rules.parse_scalar(t).alias("parsed"))


@query("rsh10_person_points", """SELECT event_id, unnest([0, 1]) AS i, unnest([event_id % 100, (event_id + 3) % 100])::DOUBLE AS x, unnest([event_id % 70, (event_id + 9) % 70])::DOUBLE AS y
FROM events WHERE event_id % 9 <> 0 AND event_id % 5 <> 0""")
def _(spark, sf):
    d = docs(spark, sf).select("event_id", reshape.person_points(F.col("d.annotations")).alias("p"))
    return d.select("event_id", F.posexplode("p").alias("i", "q")).select("event_id", "i", "q.x", "q.y")


@query("sc5_class_names", "WITH $PREDS SELECT id, clip, CASE pred WHEN 0 THEN 'worst' WHEN 1 THEN 'bad' WHEN 2 THEN 'normal' WHEN 3 THEN 'good' WHEN 4 THEN 'best' END AS name FROM preds")
def _(spark, sf):
    return fx.preds(spark, sf).select("id", "clip", rules.class_name(F.col("pred")).alias("name"))


@query("sc6_object_key", """SELECT event_id, user_id::VARCHAR AS owner, CASE WHEN event_id % 2 = 0 THEN '3d' ELSE '2d' END AS dimension, 'job-' || event_id::VARCHAR AS job_id FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.when(e % 2 == 0, "3D").otherwise("2d"),
                      F.concat(F.lit("job-"), e.cast("string"), F.lit(".zip")))
    k = rules.object_key(key)
    return fx.table(spark, sf, "events").select("event_id", k["owner"].alias("owner"), k["dimension"].alias("dimension"), k["job_id"].alias("job_id"))


@query("sc1_grades", """WITH s AS (SELECT event_id, value - 45 AS b, value - 5 AS d, value / 3 AS h, value AS x FROM events)
SELECT event_id, CASE WHEN b > -10 THEN '부족' WHEN b BETWEEN -25 AND -15 THEN '적정' WHEN b < -30 THEN '과다' ELSE '보통' END AS back,
 CASE WHEN d < 10 THEN '부족' WHEN d BETWEEN 20 AND 30 THEN '적정' WHEN d > 35 THEN '과다' ELSE '보통' END AS down,
 CASE WHEN h < 5 THEN 'Excellent' WHEN h < 10 THEN 'Good' WHEN h < 15 THEN 'Caution' ELSE 'Excessive' END AS head,
 CASE WHEN x < 25 THEN '< 25°' WHEN x <= 40 THEN '25°–40°' WHEN x <= 50 THEN '40°–50°' ELSE '> 50°' END AS xfactor FROM s""")
def _(spark, sf):
    v = F.col("value")
    return fx.table(spark, sf, "events").select(
        "event_id", rules.back_shift_grade(v - 45).alias("back"), rules.down_shift_grade(v - 5).alias("down"),
        rules.head_grade(v / 3).alias("head"), rules.xfactor_category(v)["range"].alias("xfactor"))


@query("srt2_nearest_speed_group", """WITH g AS (SELECT event_id, value + 60 AS mph, name, ref, row_number() OVER (PARTITION BY event_id ORDER BY abs(value + 60 - ref), o) AS rn FROM events,
 (VALUES ('Female Amateur', 78, 0), ('Male Amateur', 93, 1), ('LPGA Tour Pro', 94, 2), ('PGA Tour Pro (avg male pro)', 114, 3), ('Long Driver', 135, 4), ('World Record', 157, 5)) AS t(name, ref, o))
SELECT event_id, name, r6(mph - ref) AS diff FROM g WHERE rn = 1""")
def _(spark, sf):
    g = rules.nearest_speed_group(F.col("value") + 60)
    return fx.table(spark, sf, "events").select("event_id", g["name"].alias("name"), r6(g["diff"]).alias("diff"))


# ---- files -------------------------------------------------------------------------------------

@query("agg29_sequence_completeness", """WITH $FILES SELECT prefix, count(*) AS n, min(frame_no) AS first, max(frame_no) AS last, max(frame_no) - min(frame_no) + 1 - count(*) AS gap,
 CASE WHEN count(*) <= 60 THEN 'short' WHEN max(frame_no) - min(frame_no) + 1 - count(*) > 5 THEN 'gap' ELSE 'keep' END AS status FROM files GROUP BY 1""")
def _(spark, sf):
    return C.sequence_completeness(fx.files(spark, sf), min_count=60)


_CLUSTER = """gc AS (SELECT *, sum(CASE WHEN frame_no - coalesce(lg, -100) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY prefix ORDER BY frame_no) - 1 AS cluster
 FROM (SELECT *, lag(frame_no) OVER (PARTITION BY prefix ORDER BY frame_no) AS lg FROM files)),
gh AS (SELECT *, (event_id * 7) % 10 < 5 AS hit FROM gc)"""


def hits(spark, sf):
    seq = file_seq(spark, sf)
    return C.gap_clusters(fx.files(spark, sf), seq, 5).withColumn("hit", (F.col("event_id") * 7) % 10 < 5), seq


@query("win26_gap_clusters", f"WITH $FILES, {_CLUSTER} SELECT stem, cluster::INT AS cluster FROM gc")
def _(spark, sf):
    return hits(spark, sf)[0].select("stem", "cluster")


@query("win27_late_detections", f"""WITH $FILES, {_CLUSTER}, d AS (SELECT stem, prefix, row_number() OVER (PARTITION BY prefix ORDER BY frame_no DESC) AS r, count(*) OVER (PARTITION BY prefix) AS n FROM gh WHERE cluster >= 1 AND hit)
SELECT stem FROM d WHERE n = 1 OR r <= n // 2""")
def _(spark, sf):
    df, seq = hits(spark, sf)
    return C.late_detections(df, seq).select("stem")


@query("win27_majority_clusters", f"""WITH $FILES, {_CLUSTER}, k AS (SELECT prefix, cluster, min(frame_no) AS a, max(frame_no) AS b FROM gh WHERE cluster >= 1 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE hit) >= count(*) / 2.0)
SELECT DISTINCT f.stem FROM files f JOIN k ON k.prefix = f.prefix AND f.frame_no BETWEEN a - 12 AND b + 12""")
def _(spark, sf):
    df, seq = hits(spark, sf)
    return C.majority_clusters(df, seq, 12).select("stem")


@query("agg38_cluster_impact_ratio", f"""WITH $FILES, {_CLUSTER} SELECT prefix, cluster::INT AS cluster, count(*) AS total, count(*) FILTER (WHERE hit) AS impacts, count(*) FILTER (WHERE hit) >= count(*) / 2.0 AS is_impact
FROM gh WHERE cluster >= 1 GROUP BY 1, 2""")
def _(spark, sf):
    return C.cluster_impact_ratio(hits(spark, sf)[0], ("prefix",))


FILES_SQL = """fi0 AS (SELECT swing_id, event_id, event_type, frame, '20240101_G_' || CAST(swing_id AS VARCHAR) AS prefix,
        CAST(frame + CASE WHEN swing_id % 3 = 0 THEN 10 * (frame // 15) WHEN swing_id % 3 = 1 THEN frame // 20 ELSE 0 END AS INT) AS frame_no FROM frames),
files AS (SELECT *, prefix || '_' || lpad(CAST(frame_no AS VARCHAR), 4, '0') AS stem FROM fi0)"""
_WRISTS = """fp AS (SELECT f.prefix, f.stem, f.frame_no, p.lx, p.ly, p.rx, p.ry, p.lsx, p.rsx FROM files f JOIN (SELECT swing_id, frame,
 max(CASE WHEN joint_idx = 9 THEN x END) AS lx, max(CASE WHEN joint_idx = 9 THEN y END) AS ly, max(CASE WHEN joint_idx = 10 THEN x END) AS rx, max(CASE WHEN joint_idx = 10 THEN y END) AS ry,
 max(CASE WHEN joint_idx = 5 THEN x END) AS lsx, max(CASE WHEN joint_idx = 6 THEN x END) AS rsx FROM pose GROUP BY 1, 2) p ON p.swing_id = f.swing_id AND p.frame = f.frame)"""


def wrist_files(spark, sf):
    w = reshape.tidy_to_wide(fx.pose(spark, sf), ["LShoulder", "RShoulder", "LWrist", "RWrist"], "xy")
    w = w.select("swing_id", "frame", *[F.col(f"{j}_{a}").alias(n) for j, a, n in (
        ("LWrist", "x", "lx"), ("LWrist", "y", "ly"), ("RWrist", "x", "rx"), ("RWrist", "y", "ry"), ("LShoulder", "x", "lsx"), ("RShoulder", "x", "rsx"))])
    return fx.files(spark, sf).join(w, ["swing_id", "frame"])


@query("jn13_address_pose", "WITH $POSE, " + FILES_SQL + ", " + _WRISTS + """ SELECT stem, r6(first_value(lx) OVER w) AS a_lx, r6(first_value(ry) OVER w) AS a_ry FROM fp WINDOW w AS (PARTITION BY prefix ORDER BY frame_no)""")
def _(spark, sf):
    df = C.address_pose(wrist_files(spark, sf), file_seq(spark, sf), ["lx", "ly", "rx", "ry"])
    return df.select("stem", r6("a_lx").alias("a_lx"), r6("a_ry").alias("a_ry"))


@query("win27_impact_rules", "WITH $POSE, " + FILES_SQL + ", " + _WRISTS + """,
a AS (SELECT *, first_value(lx) OVER w AS alx, first_value(ly) OVER w AS aly, first_value(rx) OVER w AS arx, first_value(ry) OVER w AS ary FROM fp WINDOW w AS (PARTITION BY prefix ORDER BY frame_no))
SELECT stem, rx BETWEEN rsx AND lsx AND lx BETWEEN rsx AND lsx AS front, abs(lx - alx) + abs(ly - aly) + abs(rx - arx) + abs(ry - ary) < 150 AS side FROM a""")
def _(spark, sf):
    df = C.address_pose(wrist_files(spark, sf), file_seq(spark, sf), ["lx", "ly", "rx", "ry"])
    front = C.front_impact(F.col("lsx"), F.col("rsx"), F.col("lx"), F.col("rx"))
    side = C.side_impact([(F.col(c), F.col(f"a_{c}")) for c in ("lx", "ly", "rx", "ry")], 150)
    return df.select("stem", front.alias("front"), side.alias("side"))


@query("win29_cut_segments", """WITH $CUTS, p AS (SELECT video, seq, cut AS t, duration FROM cuts UNION ALL SELECT video, max(seq) + 1, max(duration), max(duration) FROM cuts GROUP BY 1),
s AS (SELECT video, seq, coalesce(lag(t) OVER (PARTITION BY video ORDER BY seq), 0) AS a, least(t, duration) AS b FROM p)
SELECT video, row_number() OVER (PARTITION BY video ORDER BY seq) - 1 AS segment, r6(a) AS start, r6(b) AS "end" FROM s WHERE b - a > 0.01""")
def _(spark, sf):
    return segments(spark, sf)[0].select("video", "segment", r6("start").alias("start"), r6("end").alias("end"))


def segments(spark, sf):
    n = fx.sequence(spark, sf).longest
    return C.cut_segments(fx.cuts(spark, sf), Sequence(("video",), "seq", longest=n)), Sequence(("video",), "segment", longest=n + 1)


@query("win30_merge_short_segments", """WITH RECURSIVE $CUTS, p AS (SELECT video, seq, cut AS t, duration FROM cuts UNION ALL SELECT video, max(seq) + 1, max(duration), max(duration) FROM cuts GROUP BY 1),
s AS (SELECT video, seq, coalesce(lag(t) OVER (PARTITION BY video ORDER BY seq), 0) AS a, least(t, duration) AS b FROM p),
w(video, v) AS (SELECT video, list({'a': a, 'b': b} ORDER BY seq) FROM s WHERE b - a > 0.01 GROUP BY 1
 UNION ALL SELECT video, list_transform(CASE WHEN len(o) > 1 AND o[-1].short THEN list_append(o[:-3], {'a': o[-2].a, 'b': o[-1].b, 'short': false}) ELSE o END, lambda x: {'a': x.a, 'b': x.b})
 FROM (SELECT video, list_reduce(list_transform(v, lambda x: [{'a': x.a, 'b': x.b, 'short': x.b - x.a < 3}]),
  lambda o, x: CASE WHEN o[-1].short THEN list_append(o[:-2], {'a': o[-1].a, 'b': x[1].b, 'short': false}) ELSE list_concat(o, x) END) AS o
  FROM w WHERE len(v) > 1 AND len(list_filter(v, lambda x: x.b - x.a < 3)) > 0)),
f AS (SELECT video, unnest(range(0, len(v))) AS segment, unnest(v) AS x FROM w WHERE len(v) <= 1 OR len(list_filter(v, lambda x: x.b - x.a < 3)) = 0)
SELECT video, segment, r6(x.a) AS start, r6(x.b) AS "end" FROM f""")
def _(spark, sf):
    """In SQL, a pass walks the segments of a video; a short one takes in the next; a last one that is still short joins the one before."""
    s, seq = segments(spark, sf)
    return C.merge_short_segments(s, seq, 3.0).select("video", "segment", r6("start").alias("start"), r6("end").alias("end"))


@query("win30_merge_into_previous", """WITH $CUTS, p AS (SELECT video, seq, cut AS t, duration FROM cuts UNION ALL SELECT video, max(seq) + 1, max(duration), max(duration) FROM cuts GROUP BY 1),
s AS (SELECT video, seq, coalesce(lag(t) OVER (PARTITION BY video ORDER BY seq), 0) AS a, least(t, duration) AS b FROM p),
g AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY seq) - 1 AS i, a, b FROM s WHERE b - a > 0.01),
k AS (SELECT video, min(a) AS s0 FROM g GROUP BY 1), k2 AS (SELECT g.video, min(CASE WHEN b - s0 > 0.8 THEN i END) AS k FROM g JOIN k USING (video) GROUP BY 1),
m AS (SELECT g.*, sum(CASE WHEN i > k2.k AND b - a > 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY g.video ORDER BY i) AS q FROM g JOIN k2 USING (video))
SELECT video, CAST(q AS BIGINT) AS segment, r6(min(a)) AS start, r6(max(b)) AS "end" FROM m GROUP BY 1, 2""")
def _(spark, sf):
    s, seq = segments(spark, sf)
    return C.merge_into_previous(s, seq, 0.8).select("video", "segment", r6("start").alias("start"), r6("end").alias("end"))


@query("win31_slice_groups", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, 'rec' || (l_orderkey % 400)::VARCHAR || '_' || (l_suppkey % 7)::VARCHAR AS prefix, CAST(10 + l_partkey % 80 AS INT) AS part,
 lpad(l_orderkey::VARCHAR, 8, '0') || lpad(l_linenumber::VARCHAR, 2, '0') || lpad(l_partkey::VARCHAR, 6, '0') || lpad((l_extendedprice * 100)::BIGINT::VARCHAR, 9, '0') AS name FROM lineitem)
SELECT prefix, name, row_number() OVER (PARTITION BY prefix ORDER BY part, name) - 1 AS position, count(*) OVER (PARTITION BY prefix) AS parts FROM s QUALIFY parts > 1""")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    stem = F.concat(F.lit("rec"), (F.col("l_orderkey") % 400).cast("string"), F.lit("_"), (F.col("l_suppkey") % 7).cast("string"), F.lit("_"),
                    (F.col("l_partkey") % 80 + 10).cast("string"))
    name = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
                    F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 9, "0"))
    prefix, part = rules.slice_part(F.col("stem"))
    files = li.select(stem.alias("stem"), name.alias("name")).select("name", prefix.alias("prefix"), part.alias("part"))
    return C.slice_groups(files, "prefix", "part", "name").select("prefix", "name", "position", "parts")


@query("win32_sub_sequences", """WITH $FILES, w AS (SELECT prefix, frame, list(stem) OVER (PARTITION BY prefix ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS f FROM files)
SELECT prefix, frame, array_to_string(f, ',') AS files FROM w WHERE len(f) = 5""")
def _(spark, sf):
    seq = Sequence(("prefix",), longest=fx.sequence(spark, sf).longest)
    return C.sub_sequences(fx.files(spark, sf), seq, "stem").select("prefix", "frame", F.array_join("files", ",").alias("files"))


_VID = "v AS (SELECT user_id AS video, count(*)::INT AS frames FROM events GROUP BY 1)"


def videos(spark, sf):
    return fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("video")).agg(F.count(F.lit(1)).cast("int").alias("frames"))


@query("win33_uniform_frames", f"""WITH {_VID}, k AS (SELECT video, frames, unnest(range(0, 70)) AS k FROM v), n AS (SELECT *, least(frames, 70) AS c FROM k)
SELECT DISTINCT video, CAST(CASE WHEN k = c - 1 THEN frames - 1 ELSE floor(k * ((frames - 1) / greatest(c - 1, 1))) END AS INT) AS frame FROM n WHERE k < c""")
def _(spark, sf):
    return C.uniform_frames(videos(spark, sf), ["video"], "frames", 70)


@query("win33_uniform_padded", f"""WITH {_VID}, n AS (SELECT video, frames, unnest(range(0, 64))::INT AS k FROM v)
SELECT video, k, CAST(CASE WHEN frames < 64 THEN least(k, frames - 1) WHEN k = 63 THEN frames - 1 ELSE floor(k * ((frames - 1) / 63)) END AS INT) AS frame FROM n""")
def _(spark, sf):
    return C.uniform_frames(videos(spark, sf), ["video"], "frames", 64, True)


@query("win34_clip_frames", f"""WITH {_VID}, c AS (SELECT video, frames, unnest(range(0, 4))::INT AS clip FROM v),
e AS (SELECT *, floor(clip * (frames / 4)) AS a, CASE WHEN clip = 3 THEN frames ELSE floor((clip + 1) * (frames / 4)) END AS b FROM c),
n AS (SELECT *, b - a AS n, unnest(range(0, 8))::INT AS k FROM e)
SELECT video, clip, k, CAST(a + CASE WHEN n < 8 THEN least(k, n - 1) WHEN k = 7 THEN n - 1 ELSE floor(k * ((n - 1) / 7)) END AS INT) AS frame FROM n""")
def _(spark, sf):
    return C.clip_frames(videos(spark, sf), ["video"], "frames", 4, 8)


@query("win35_row_order_frames", "WITH $FRAMES SELECT event_id, frame::BIGINT AS frame FROM frames")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return number_rows(ev, ["user_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "frame").select("event_id", "frame")


# ---- boxes and depth ---------------------------------------------------------------------------

@query("agg30_union_boxes", """WITH $BOXES, u AS (SELECT video, person, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 FROM boxes GROUP BY 1, 2),
a AS (SELECT video, person, CAST(trunc(x1 - (x2 - x1) * 0.15e0) AS INT) x, CAST(trunc(y1 - (y2 - y1) * 0.1e0) AS INT) y,
 CAST(trunc((x2 - x1) + 2 * ((x2 - x1) * 0.15e0)) AS INT) w, CAST(trunc((y2 - y1) + 2 * ((y2 - y1) * 0.1e0)) AS INT) h FROM u),
b AS (SELECT video, person, greatest(x, 0) x, greatest(y, 0) y, w, h FROM a),
c AS (SELECT video, person, x, y, CASE WHEN x + w > 1280 THEN 1280 - x ELSE w END w, CASE WHEN y + h > 500 THEN 500 - y ELSE h END h FROM b)
SELECT video, person, CASE WHEN w % 2 = 1 AND x + w + 1 > 1280 THEN greatest(0, x - 1) ELSE x END AS x, CASE WHEN h % 2 = 1 AND y + h + 1 > 500 THEN greatest(0, y - 1) ELSE y END AS y,
 CASE WHEN w % 2 = 1 THEN w + 1 ELSE w END AS w, CASE WHEN h % 2 = 1 THEN h + 1 ELSE h END AS h FROM c WHERE w > 200 AND h > 100""")
def _(spark, sf):
    return C.union_boxes(fx.boxes(spark, sf), ["video", "person"], 1280, 500, 0.15, 0.1, 200, 100)


@query("agg32_dominant_cluster", """WITH s AS (SELECT l_orderkey AS video, CAST(l_partkey % 4 - 1 AS INT) AS cluster FROM lineitem), n AS (SELECT video, cluster, count(*) AS n FROM s GROUP BY 1, 2),
b AS (SELECT video, cluster, row_number() OVER (PARTITION BY video ORDER BY n DESC, cluster) AS r FROM n WHERE cluster <> -1)
SELECT v.video, coalesce(b.cluster, 0) AS cluster FROM (SELECT DISTINCT video FROM s) v LEFT JOIN b ON b.video = v.video AND r = 1""")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video"), (F.col("l_partkey") % 4 - 1).cast("int").alias("cluster"))
    return C.dominant_cluster(rows, ["video"])


_DEPTH = """dm AS (SELECT l_suppkey % 20 AS rec, l_orderkey % 100 AS frame, CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity * (CASE WHEN l_suppkey % 2 = 0 THEN 100 ELSE 1 END) END AS depth FROM lineitem)"""


def depth_rows(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    d = F.when(p % 11 == 0, F.lit(0.0)).when(p % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") * F.when(s % 2 == 0, 100).otherwise(1))
    return fx.table(spark, sf, "lineitem").select((s % 20).alias("rec"), (F.col("l_orderkey") % 100).alias("frame"), d.alias("depth"))


@query("agg33_depth_validity", f"""WITH {_DEPTH} SELECT rec, frame, count(*) AS total, count(depth) AS finite, count(CASE WHEN depth > 0 THEN 1 END) AS valid, r6(min(depth)) AS min, r6(max(depth)) AS max,
 r6(quantile_cont(CASE WHEN depth > 0 THEN depth END, 0.5)) AS median_valid FROM dm GROUP BY 1, 2""")
def _(spark, sf):
    s = C.depth_validity(depth_rows(spark, sf), ["rec", "frame"])
    return s.select("rec", "frame", "total", "finite", "valid", r6("min").alias("min"), r6("max").alias("max"), r6("median_valid").alias("median_valid"))


@query("agg33_depth_scale", f"""WITH {_DEPTH}, s AS (SELECT rec, frame, quantile_cont(CASE WHEN depth > 0 THEN depth END, 0.5) AS m, count(CASE WHEN depth > 0 THEN 1 END) AS v FROM dm GROUP BY 1, 2)
SELECT rec, CASE WHEN rec = 3 THEN 0.0002e0 WHEN bool_or(coalesce(m > 1000, false)) THEN 0.001e0 ELSE 1e0 END AS factor, bool_and(v = 0) AS all_invalid FROM s GROUP BY 1""")
def _(spark, sf):
    s = C.depth_validity(depth_rows(spark, sf), ["rec", "frame"])
    return C.depth_scale(s, ["rec"], False, F.when(F.col("rec") == 3, 0.0002))


_PIX = """pts AS (SELECT swing_id, frame, joint_idx, x, y, event_id FROM clean WHERE joint_idx IN (9, 10) AND x IS NOT NULL),
pix AS (SELECT swing_id, frame, px, py, max(d) AS depth FROM (SELECT swing_id, frame, CAST(round_even(x, 0) AS INT) + dx AS px, CAST(round_even(y, 0) AS INT) + dy AS py,
 CASE WHEN (event_id + dx + dy) % 6 = 0 THEN 0 ELSE 2 + ((event_id * 31 + dx * 7 + dy * 3 + 40) % 13) / CAST(10 AS DOUBLE) END AS d
 FROM pts, (SELECT unnest(range(-3, 3)) AS dx), (SELECT unnest(range(-1, 3)) AS dy)) GROUP BY 1, 2, 3, 4)"""


def depth_pixels(spark, sf):
    from kinetra.catalog.motion import masked
    pts = masked(spark, sf, by_frame=True).filter(F.col("joint_idx").isin(9, 10) & F.col("x").isNotNull())
    off = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-3, 3) for b in range(-1, 3)])
    p = pts.select("swing_id", "frame", "event_id", "x", "y", F.inline(off))
    e, dx, dy = F.col("event_id"), F.col("dx"), F.col("dy")
    d = F.when((e + dx + dy) % 6 == 0, F.lit(0.0)).otherwise(2 + ((e * 31 + dx * 7 + dy * 3 + 40) % 13) / F.lit(10.0))
    pix = p.select("swing_id", "frame", (F.bround("x", 0).cast("int") + dx).alias("px"), (F.bround("y", 0).cast("int") + dy).alias("py"), d.alias("depth"))
    return pts, pix.groupBy("swing_id", "frame", "px", "py").agg(F.max("depth").alias("depth"))


@query("jn8_depth_patch", f"""WITH $CLEAN, {_PIX} SELECT p.swing_id, p.frame, p.joint_idx, r6(quantile_cont(d.depth, 0.5)) AS depth FROM pts p JOIN pix d ON d.swing_id = p.swing_id AND d.frame = p.frame
 AND d.px BETWEEN CAST(round_even(p.x, 0) AS INT) - 2 AND CAST(round_even(p.x, 0) AS INT) + 2 AND d.py BETWEEN CAST(round_even(p.y, 0) AS INT) - 2 AND CAST(round_even(p.y, 0) AS INT) + 2
 WHERE d.depth > 0 AND d.px >= 0 AND d.py >= 0 AND d.px < 1920 AND d.py < 1080 GROUP BY 1, 2, 3""")
def _(spark, sf):
    pts, pix = depth_pixels(spark, sf)
    return P.depth_patch(pts, pix, ["swing_id", "frame"], 2, 1920, 1080).select("swing_id", "frame", "joint_idx", r6("depth").alias("depth"))


_SIDE = 8


@query("jn8_depth_tiles", """WITH $CLEAN, p AS (SELECT swing_id, frame, joint_idx, event_id, CAST(round_even(x, 0) AS INT) + dx AS px, CAST(round_even(y, 0) AS INT) + dy AS py
 FROM clean, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT swing_id, frame, joint_idx, r6(quantile_cont(2 + ((event_id * 31 + px * 7 + py * 3) % 13) / CAST(10 AS DOUBLE), 0.5)) AS depth FROM p
WHERE px >= 0 AND py >= 0 AND (event_id + px + py) % 6 <> 0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    """All joints on depth maps that hold the tiles around them."""
    from kinetra.catalog.motion import masked
    pts = masked(spark, sf, by_frame=True).select("swing_id", "frame", "joint_idx", "event_id", "x", "y")
    near = P.touched_tiles(pts, 2, _SIDE).filter("tx >= 0 and ty >= 0").select("swing_id", "frame", "event_id", "tx", "ty").distinct()
    # What a cell holds hangs on two remainders at the tile's corner, so the 624 different tiles are drawn once. Remainders
    # of negative numbers are negative: sums that may cross zero inside a tile stand for themselves.
    e, x, y = F.col("event_id"), F.col("tx") * _SIDE, F.col("ty") * _SIDE
    a, b = F.pmod(e + x + y, F.lit(6)), e * 31 + x * 7 + y * 3
    b = F.when(b >= 0, b % 13).when(b >= -78, b).otherwise(-79 - (-79 - b) % 13)

    def depth(i):
        dx, dy = i % _SIDE, F.floor(i / _SIDE)
        return F.when((F.col("_a") + dx + dy) % 6 == 0, F.lit(0.0)).otherwise(2 + ((F.col("_b") + dx * 7 + dy * 3) % 13) / F.lit(10.0))

    drawn = spark.range(6 * 104).select((F.col("id") % 6).alias("_a"), (F.floor(F.col("id") / 6) - 91).alias("_b"))
    drawn = drawn.select("_a", "_b", F.transform(F.sequence(F.lit(0), F.lit(_SIDE * _SIDE - 1)), depth).alias("cells"))
    tiles = near.select("swing_id", "frame", "tx", "ty", a.alias("_a"), b.alias("_b")).join(F.broadcast(drawn), ["_a", "_b"]).drop("_a", "_b")
    found = P.depth_patch_tiles(pts, tiles, ["swing_id", "frame"], 2, _SIDE)
    return found.select("swing_id", "frame", "joint_idx", r6("depth").alias("depth"))


# ---- joins -------------------------------------------------------------------------------------

@query("jn3_with_media", "WITH $FILES SELECT stem FROM files WHERE event_id % 4 <> 0")
def _(spark, sf):
    f = fx.files(spark, sf)
    media = f.filter(F.col("event_id") % 4 != 0).select(P.stem(F.concat(F.lit("/v/"), F.col("stem"), F.lit(".mp4"))).alias("stem"))
    return P.with_media(f, media).select("stem")


@query("jn4_unmatched_both", """WITH $FILES SELECT stem, 'first' AS side FROM files WHERE event_id % 4 = 0 AND event_id % 3 <> 0 UNION ALL SELECT stem, 'second' FROM files WHERE event_id % 3 = 0 AND event_id % 4 <> 0""")
def _(spark, sf):
    f = fx.files(spark, sf)
    return P.unmatched_both(f.filter("event_id % 3 <> 0"), f.filter("event_id % 4 <> 0"))


@query("jn5_pair_images", """WITH $FILES SELECT event_id, event_id % 5 <> 0 AS has_image FROM files""")
def _(spark, sf):
    f = fx.files(spark, sf)
    img = f.filter("event_id % 5 <> 0").select(F.regexp_replace(F.regexp_replace("path", r"\[라벨\]", "[원천]"), "json$", "jpg").alias("path"))
    return P.pair_images(f, img, rules.source_path(F.col("path"))).select("event_id", "has_image")


@query("jn6_merge_frames", """WITH $FRAMES SELECT coalesce(a.swing_id, b.swing_id) AS swing_id, coalesce(a.frame, b.frame) AS frame, r6(a.v) AS v_l, r6(b.v * 2) AS v_r, b.n
FROM (SELECT swing_id, frame, v FROM frames WHERE frame % 3 <> 0) a FULL JOIN (SELECT swing_id, frame, v, n FROM frames WHERE frame % 2 = 0) b ON a.swing_id = b.swing_id AND a.frame = b.frame""")
def _(spark, sf):
    f = fx.frames(spark, sf)
    m = P.merge_frames(f.filter("frame % 3 <> 0").select("swing_id", "frame", "v"),
                       f.filter("frame % 2 = 0").select("swing_id", "frame", (F.col("v") * 2).alias("v"), "n"), ["swing_id", "frame"])
    return m.select("swing_id", "frame", r6("v_l").alias("v_l"), r6("v_r").alias("v_r"), "n")


@query("jn7_match_depth_frames", """WITH $FRAMES, m AS (SELECT swing_id, frame AS f0, CASE WHEN frame % 3 = 0 THEN lpad(frame::VARCHAR, 6, '0') || '.npy' ELSE 'd' || frame::VARCHAR || 'x.npy' END AS name FROM frames WHERE frame % 7 <> 6),
p AS (SELECT *, row_number() OVER (PARTITION BY swing_id ORDER BY name) - 1 AS position, replace(name, '.npy', '') AS stem FROM m),
j AS (SELECT f.swing_id, f.frame, (SELECT max(name) FROM p WHERE p.swing_id = f.swing_id AND p.stem = lpad(f.frame::VARCHAR, 6, '0')) AS e,
 (SELECT min(name) FROM p WHERE p.swing_id = f.swing_id AND contains(p.stem, f.frame::VARCHAR)) AS c, (SELECT max(name) FROM p WHERE p.swing_id = f.swing_id AND p.position = f.frame) AS o FROM frames f)
SELECT swing_id, frame, coalesce(e, c, o) AS name, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'contains' WHEN o IS NOT NULL THEN 'position' ELSE 'error' END AS how FROM j""")
def _(spark, sf):
    f = fx.frames(spark, sf).select("swing_id", "frame")
    name = F.when(F.col("frame") % 3 == 0, F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".npy"))).otherwise(
        F.concat(F.lit("d"), F.col("frame").cast("string"), F.lit("x.npy")))
    maps = f.filter("frame % 7 <> 6").select("swing_id", name.alias("name"))
    # Names are numbered per recording in sorted order; their first three letters slice a large one.
    maps = number_rows(maps, ["swing_id"], [F.col("name")], F.substring("name", 1, 3), "position").withColumn("position", F.col("position").cast("int"))
    return P.match_depth_frames(f, maps)


@query("jn10_match_predictions", """WITH p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'clip_' || doc_id::VARCHAR || '_v' ELSE doc_id::VARCHAR || '-' || source END AS id, doc_id AS seq, doc_id % 5 AS pred FROM documents),
a AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'clip_' || doc_id::VARCHAR ELSE doc_id::VARCHAR || '-' || source END AS id FROM documents)
SELECT a.id, coalesce((SELECT arg_min(pred, seq) FROM p WHERE p.id = a.id), (SELECT arg_min(pred, seq) FROM p WHERE contains(p.id, a.id))) AS pred FROM a""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    k, c = F.col("doc_id"), F.concat(F.lit("clip_"), F.col("doc_id").cast("string"))
    plain = F.concat(k.cast("string"), F.lit("-"), F.col("source"))
    p = d.select(F.when(k % 3 == 0, F.concat(c, F.lit("_v"))).otherwise(plain).alias("id"), k.alias("seq"), (k % 5).alias("pred"))
    a = d.select(F.when(k % 2 == 0, c).otherwise(plain).alias("id")).distinct()
    return P.match_predictions(a, p).select("id", "pred")


@query("jn11_split_membership", """WITH $SAMPLES SELECT id, CASE WHEN id % 6 = 0 THEN 'test' ELSE 'train' END AS part FROM samples""")
def _(spark, sf):
    s = fx.samples(spark, sf)
    ids = s.filter("id % 6 = 0").select("id")
    return s.join(ids, "id", "left_semi").select("id", F.lit("test").alias("part")).unionByName(
        s.join(ids, "id", "left_anti").select("id", F.lit("train").alias("part")))


@query("jn12_impact_images", f"""WITH $FILES, {_CLUSTER} SELECT stem || '.jpg' AS image, bool_or(hit) AS is_impact FROM gh GROUP BY 1""")
def _(spark, sf):
    df, _ = hits(spark, sf)
    df = cut_lineage(df.select("stem", "hit"))
    images = df.select("stem")
    impact = df.filter("hit").select("stem")
    both = P.with_media(images, impact).withColumn("is_impact", F.lit(True)).unionByName(
        P.without_media(images, impact).withColumn("is_impact", F.lit(False)))
    return both.select(F.concat("stem", F.lit(".jpg")).alias("image"), "is_impact")


@query("jn14_merge_inference", """SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 10)::VARCHAR WHEN event_id % 3 = 1 THEN '{"score":' || (event_id % 10)::VARCHAR || '}' END AS inference FROM events""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("event_id").alias("job_id"))
    k = F.col("job_id")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"result":'), (k % 10).cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"score":'), (k % 10).cast("string"), F.lit("}")))
    return P.merge_inference(ev, ev.filter(k % 3 != 2).withColumn("response", body))


@query("jn15_resume", """WITH m AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT user_id AS video_path FROM m WHERE last <> 'purchase'""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("video_path"), "ts", "event_id",
                                              F.when(F.col("event_type") == "purchase", "done").otherwise("failed").alias("status"))
    return P.resume(ev.select("video_path").distinct(), P.latest_manifest(ev, order=("ts", "event_id")))


@query("jn16_latest_manifest", """SELECT user_id AS video_path, arg_max(event_type, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("video_path"), F.col("event_type").alias("status"), "ts", "event_id")
    return P.latest_manifest(ev, order=("ts", "event_id")).drop("ts")


@query("jn17_resolve_originals", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '/' || event_id::VARCHAR WHEN event_id % 3 = 1 THEN 'true/' || event_type || '/' || event_id::VARCHAR END AS original FROM events""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", F.col("event_type").alias("cls"), F.col("event_id").cast("string").alias("rel"))
    e = F.col("event_id")
    files = ev.filter(e % 3 != 2).select(F.when(e % 3 == 0, F.concat_ws("/", "cls", "rel")).otherwise(F.concat_ws("/", F.lit("true"), "cls", "rel")).alias("path"))
    return P.resolve_originals(ev, files).select("event_id", "original")


@query("jn18_labels_of", "WITH $SAMPLES SELECT doc_id AS frame_dir, label FROM documents JOIN samples ON samples.id = doc_id WHERE doc_id % 2 = 0")
def _(spark, sf):
    ids = fx.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("frame_dir"))
    return P.labels_of(ids, fx.samples(spark, sf).withColumnRenamed("id", "frame_dir"))


@query("jn19_dataset_diff", """WITH $SAMPLES, a AS (SELECT id, label, n_chars FROM samples WHERE id % 7 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE label END AS label, n_chars + (id % 3 = 0)::INT AS n_chars FROM samples WHERE id % 11 <> 0)
SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_first, b.id IS NOT NULL AS in_second, a.label IS DISTINCT FROM b.label AS label_differs, a.n_chars IS DISTINCT FROM b.n_chars AS n_chars_differs
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label IS DISTINCT FROM b.label OR a.n_chars IS DISTINCT FROM b.n_chars""")
def _(spark, sf):
    s = fx.samples(spark, sf).select("id", "label", "n_chars")
    b = s.filter("id % 11 <> 0").select("id", F.when(F.col("id") % 5 != 0, F.col("label")).alias("label"), (F.col("n_chars") + (F.col("id") % 3 == 0).cast("int")).alias("n_chars"))
    return P.dataset_diff(s.filter("id % 7 <> 0"), b, "id", ["label", "n_chars"])


# ---- counts ------------------------------------------------------------------------------------

@query("agg15_label_distribution", "WITH $SAMPLES SELECT lang, label, count(*) AS n FROM samples GROUP BY 1, 2")
def _(spark, sf):
    return C.label_distribution(fx.samples(spark, sf), by=("lang",))


@query("agg16_value_counts", f"""WITH t AS (SELECT 'image.action' AS field, event_type AS value FROM events UNION ALL SELECT 'image.evaluation', {SPELL} FROM events UNION ALL SELECT 'image.hitting', 'hit' FROM events WHERE event_id % 4 <> 0
 UNION ALL SELECT 'environment.time', CASE WHEN event_id % 3 = 0 THEN 'day' ELSE 'night' END FROM events UNION ALL SELECT 'environment.location', 'range' FROM events
 UNION ALL SELECT 'actor.sex', CASE WHEN event_id % 2 = 0 THEN 'M' ELSE 'F' END FROM events UNION ALL SELECT 'actor.age', (20 + event_id % 30)::VARCHAR FROM events WHERE event_id % 6 <> 0)
SELECT field, value, count(*) AS n FROM t GROUP BY 1, 2""")
def _(spark, sf):
    return C.value_counts(docs(spark, sf), {f: F.col(f"d.{f}") for f in C.META_FIELDS})


@query("agg17_annotation_presence", "SELECT event_type AS action, count(*) FILTER (WHERE event_id % 9 <> 0 AND event_id % 5 <> 0) AS with_points, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    d = docs(spark, sf).select(F.col("d.image.action").alias("action"), C.has_points(F.col("d.annotations")).alias("p"))
    return d.groupBy("action").agg(F.count(F.when(F.col("p"), 1)).alias("with_points"), F.count(F.lit(1)).alias("n"))


@query("agg35_id_integrity", """WITH s AS (SELECT CASE WHEN event_id % 50 = 0 THEN ' ' WHEN event_id % 77 = 0 THEN NULL ELSE user_id::VARCHAR END AS id FROM events)
SELECT count(*) AS n, count(DISTINCT id) AS n_distinct, count(*) FILTER (WHERE id IS NULL OR trim(id) = '') AS n_blank FROM s""")
def _(spark, sf):
    e = F.col("event_id")
    ids = fx.table(spark, sf, "events").select(F.when(e % 50 == 0, " ").when(e % 77 != 0, F.col("user_id").cast("string")).alias("id"))
    return C.id_integrity(ids)


@query("agg36_histogram", """WITH r AS (SELECT event_type, min(value) lo, max(value) hi, count(*) n FROM events GROUP BY 1),
b AS (SELECT e.event_type, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, lo, hi, r.n AS total FROM events e JOIN r ON r.event_type = e.event_type)
SELECT event_type, bin, r6(max(lo) + bin * ((max(hi) - max(lo)) / 30)) AS low, count(*) AS n, r6(count(*) / (max(total) * ((max(hi) - max(lo)) / 30))) AS density FROM b GROUP BY 1, 2""")
def _(spark, sf):
    h = C.histogram(fx.table(spark, sf, "events"), "value", "event_type", density=True)
    return h.select("event_type", "bin", r6("low").alias("low"), "n", r6("density").alias("density"))


@query("agg37_validate_samples", """WITH $FRAMES, s AS (SELECT swing_id, max(n) AS n FROM frames GROUP BY 1)
SELECT swing_id::VARCHAR AS frame_dir, v AS violation FROM (SELECT swing_id, unnest([CASE WHEN swing_id % 10 = 0 THEN 'missing_key' END, CASE WHEN swing_id % 4 = 0 THEN 'no_frames' END, CASE WHEN swing_id % 4 = 0 THEN 'frame_count' END,
 CASE WHEN swing_id % 6 = 0 THEN 'all_zero' END, CASE WHEN swing_id % 6 = 1 THEN 'not_finite' END, CASE WHEN swing_id % 6 = 2 THEN 'wrong_shape' END]) AS v FROM s) WHERE v IS NOT NULL""")
def _(spark, sf):
    t = reshape.assemble_tensor(fx.pose(spark, sf), ["swing_id"])
    s = F.col("swing_id")
    kp = F.transform("keypoint", lambda m: F.transform(m, lambda f: F.transform(F.when(s % 6 == 2, F.slice(f, 1, 16)).otherwise(f), lambda v: F.transform(
        v, lambda x: F.when(s % 6 == 0, F.lit(0.0).cast("float")).when(s % 6 == 1, F.lit(float("nan")).cast("float")).otherwise(x)))))
    rows = t.select(s.cast("string").alias("frame_dir"), F.when(s % 10 != 0, 1).alias("label"), F.when(s % 4 != 0, F.col("total_frames")).otherwise(0).alias("total_frames"), kp.alias("keypoint"))
    return C.validate_samples(rows)


# ---- sampling ----------------------------------------------------------------------------------

HASH = "(id * 7919 + 31) % 10007"


def order(id_: str = "id") -> SM.Order:
    return SM.Order.by((F.col(id_) * 7919 + 31) % 10007, id_)


def _rank(part: str = "") -> str:
    return f"row_number() OVER ({'PARTITION BY ' + part if part else ''} ORDER BY {HASH}, id) - 1"


@query("smp1_undersample", f"""WITH $SAMPLES, r AS (SELECT id, label, {_rank('label')} AS r FROM samples) SELECT id, label FROM r WHERE r < (SELECT min(c) FROM (SELECT count(*) AS c FROM samples GROUP BY label))""")
def _(spark, sf):
    return SM.undersample(fx.samples(spark, sf), order=order()).select("id", "label")


@query("smp1_undersample_exact", f"""WITH $SAMPLES, r AS (SELECT id, label, {_rank('label')} AS r FROM samples) SELECT id, label FROM r WHERE label = 0 OR r < (SELECT count(*) FROM samples WHERE label = 0)""")
def _(spark, sf):
    return SM.undersample_exact(fx.samples(spark, sf), order=order()).select("id", "label")


@query("smp2_oversample", f"""WITH $SAMPLES, c AS (SELECT count(*) FILTER (WHERE label = 0) AS f, count(*) FILTER (WHERE label <> 0) AS t FROM samples), r AS (SELECT id, label, {_rank('label')} AS r FROM samples)
SELECT id, label, unnest(range(1, 1 + CASE WHEN label = 0 THEN t // f + (r < t - (t // f) * f)::INT ELSE 1 END)) AS copy FROM r, c""")
def _(spark, sf):
    return SM.oversample(fx.samples(spark, sf), order=order()).select("id", "label", "copy")


@query("smp3_bootstrap", f"""WITH $SAMPLES, r AS (SELECT id, label, {_rank('label')} AS r FROM samples), d AS (SELECT r AS draw, (r * 7919 + 13) % (SELECT count(*) FROM samples WHERE label = 0) AS k FROM r WHERE label = 1)
SELECT draw, r.id FROM d JOIN r ON r.label = 0 AND r.r = d.k""")
def _(spark, sf):
    return SM.bootstrap(fx.samples(spark, sf), order=order(), pick=F.col("_draw") * 7919 + 13).select("draw", "id")


@query("smp4_augment_with_noise")
def _(spark, sf):
    e = fx.emb_a(spark, sf).withColumn("bin", (F.col("label") >= 3).cast("int"))
    out = SM.augment_with_noise(e, "vec", "bin", ratio=1.5)
    return out.select("id", "bin", "augmented", r6(F.col("vec")[0]).alias("v0"), F.size("vec").alias("width"))


@query("smp4_augment_counts", """WITH $EMB_A, b AS (SELECT (label >= 3)::INT AS bin FROM emb_a) SELECT bin, false AS augmented, count(*) AS n FROM b GROUP BY 1
UNION ALL SELECT 0, true, CAST(floor(count(*) * 1.5e0) AS BIGINT) FROM b WHERE bin = 0""")
def _(spark, sf):
    e = fx.emb_a(spark, sf).withColumn("bin", (F.col("label") >= 3).cast("int"))
    return SM.augment_with_noise(e, "vec", "bin", ratio=1.5).groupBy("bin", "augmented").agg(F.count(F.lit(1)).alias("n"))


@query("smp5_stratified_holdout", f"""WITH $SAMPLES, r AS (SELECT id, label5, {_rank('label5')} AS r, count(*) OVER (PARTITION BY label5) AS n FROM samples)
SELECT id, CASE WHEN r < greatest(1, floor(n * 0.15e0)) THEN 'val' ELSE 'train' END AS split FROM r""")
def _(spark, sf):
    return SM.stratified_holdout(fx.samples(spark, sf), 0.15, "label5", order()).select("id", "split")


@query("smp6_ratio_split", f"""WITH $SAMPLES, r AS (SELECT id, {_rank()} AS r, count(*) OVER () AS n FROM samples) SELECT id, CASE WHEN r < floor(n * 0.9e0) THEN 'train' ELSE 'valid' END AS split FROM r""")
def _(spark, sf):
    return SM.ratio_split(fx.samples(spark, sf), 0.9, order()).select("id", "split")


@query("smp7_three_way_split", f"""WITH $SAMPLES, r AS (SELECT id, label, {_rank('label')} AS r, count(*) OVER (PARTITION BY label) AS n FROM samples)
SELECT id, label, CASE WHEN r < floor(n * 0.8e0) THEN 'train' WHEN r < floor(n * 0.8e0) + floor(n * 0.1e0) THEN 'valid' ELSE 'test' END AS split FROM r""")
def _(spark, sf):
    return SM.three_way_split(fx.samples(spark, sf), order=order()).select("id", "label", "split")


@query("smp8_folds", f"WITH $SAMPLES SELECT id, CAST(({_rank('label')}) % 5 AS INT) AS fold FROM samples")
def _(spark, sf):
    return SM.folds(fx.samples(spark, sf), 5, "label", order()).select("id", "fold")


@query("smp9_all_validation", "WITH $SAMPLES SELECT id, 'xsub_val' AS split FROM samples")
def _(spark, sf):
    return SM.all_validation(fx.samples(spark, sf)).select("id", "split")


@query("smp10_balanced_sequences", f"""WITH $FILES, g AS (SELECT swing_id AS id, CAST(swing_id % 3 = 0 AS INT) AS label FROM files GROUP BY 1), r AS (SELECT *, {_rank('label')} AS r FROM g),
k AS (SELECT * FROM r WHERE r < (SELECT min(c) FROM (SELECT count(*) c FROM g GROUP BY label))),
w AS (SELECT k.label, k.r, f.frame, f.stem, count(*) OVER (PARTITION BY f.swing_id ORDER BY f.frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c FROM files f JOIN k ON k.id = f.swing_id),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r, frame) AS q FROM w WHERE c = 5)
SELECT label, stem AS first_file FROM s WHERE q <= (SELECT min(c) FROM (SELECT count(*) c FROM s GROUP BY label))""")
def _(spark, sf):
    f = fx.files(spark, sf)
    groups = f.select(F.col("swing_id").alias("id")).distinct().withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    kept = SM.balanced_groups(groups, order=order())
    seq = fx.sequence(spark, sf)
    rows = C.sub_sequences(f.join(kept.withColumnRenamed("id", "swing_id"), "swing_id"), seq, "stem")
    return SM.trim_to_equal(rows, "label", "group_rank", "frame").select("label", F.col("files")[0].alias("first_file"))


@query("smp11_resplit", f"""WITH $SAMPLES, r AS (SELECT id, {_rank('label')} AS r, count(*) OVER (PARTITION BY label) AS n FROM samples) SELECT id, CASE WHEN r < greatest(1, floor(n * 0.2e0)) THEN 'xsub_val' ELSE 'xsub_train' END AS split FROM r""")
def _(spark, sf):
    return SM.resplit(fx.samples(spark, sf).withColumn("split", F.lit("old")), 0.2, order=order()).select("id", "split")


@query("smp12_holdout_at_least_one", f"""WITH $SAMPLES, r AS (SELECT id, {_rank()} AS r, count(*) OVER () AS n FROM samples) SELECT id, CASE WHEN r < n - greatest(1, floor(n * 0.1e0)) THEN 'train' ELSE 'val' END AS split FROM r""")
def _(spark, sf):
    return SM.holdout_at_least_one(fx.samples(spark, sf), 0.1, order()).select("id", "split")


# ---- sets and order ----------------------------------------------------------------------------

_SPLITS = "sp AS (SELECT id, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'valid' ELSE 'test' END AS split FROM samples UNION ALL SELECT id, 'test' FROM samples WHERE id % 33 = 0)"


def splits(spark, sf):
    s, k = fx.samples(spark, sf), F.col("id") % 10
    a = s.select("id", F.when(k < 7, "train").when(k < 9, "valid").otherwise("test").alias("split"))
    return a.unionByName(s.filter("id % 33 = 0").select("id", F.lit("test").alias("split")))


@query("set1_split_overlap", f"""WITH $SAMPLES, {_SPLITS}, d AS (SELECT DISTINCT id, split FROM sp)
SELECT a.split AS first, b.split AS second, count(*) AS shared FROM d a JOIN d b ON a.id = b.id AND a.split < b.split GROUP BY 1, 2 UNION ALL SELECT 'any', 'any', count(DISTINCT id) FROM sp""")
def _(spark, sf):
    return sets.split_overlap(splits(spark, sf))


@query("set2_symmetric_difference", """WITH $SAMPLES SELECT id, 'first' AS side FROM samples WHERE id % 2 = 0 AND id % 3 <> 0 UNION ALL SELECT id, 'second' FROM samples WHERE id % 3 = 0 AND id % 2 <> 0""")
def _(spark, sf):
    s = fx.samples(spark, sf).select("id")
    return sets.symmetric_difference(s.filter("id % 2 = 0"), s.filter("id % 3 = 0"))


@query("set3_stack", """WITH $SAMPLES SELECT id, label, 'a' AS tag, NULL::VARCHAR AS lang FROM samples WHERE id % 2 = 0 UNION ALL SELECT id, label, 'b', lang FROM samples WHERE id % 3 = 0""")
def _(spark, sf):
    s = fx.samples(spark, sf)
    return sets.stack({"a": s.filter("id % 2 = 0").select("id", "label"), "b": s.filter("id % 3 = 0").select("id", "label", "lang")})


@query("set4_first_by_name", "SELECT source AS name, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("name"), "doc_id", "lang")
    return sets.first_by(d, ["name"], "doc_id")


@query("set5_merge_annotation_sets", """WITH $SAMPLES SELECT id, label, 'xsub_train' AS split FROM samples WHERE id % 4 <> 0 UNION ALL SELECT id, label, 'xsub_val' FROM samples WHERE id % 4 = 0""")
def _(spark, sf):
    s = fx.samples(spark, sf).select("id", "label")
    return sets.merge_annotations({"xsub_train": [s.filter("id % 4 = 1"), s.filter("id % 4 > 1")], "xsub_val": [s.filter("id % 4 = 0")]})


@query("set6_one_row_per_joint", """WITH $POSE SELECT swing_id, frame, joint_idx, r6(X3) AS x FROM pose WHERE X3 IS NOT NULL""")
def _(spark, sf):
    p = fx.pose(spark, sf, by_frame=True)
    rows = [(F.col("event_id"), F.col("X3")), (F.col("event_id") + 1000000000, F.col("X3") + 5)]
    twice = p.select(*[c for c in p.columns if c != "X3"], F.inline(F.array(*[F.struct(s.alias("seq"), x.alias("X3")) for s, x in rows])))
    return sets.one_per_joint(twice, "seq").select("swing_id", "frame", "joint_idx", r6("X3").alias("x"))


@query("srt1_natural_sort", """WITH s AS (SELECT DISTINCT source FROM documents) SELECT source, row_number() OVER (ORDER BY regexp_replace(source, '[0-9]+', ''), CAST(regexp_extract(source, '([0-9]+)', 1) AS INT)) - 1 AS place FROM s""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select("source").distinct()
    return sets.number_in_order(d, [sets.natural_key(F.col("source")), F.col("source")]).select("source", "place")


@query("srt1_one_common_prefix", """WITH p AS (SELECT doc_id, 'scan_' || CAST(n_chars AS VARCHAR) || '_take' || CAST(doc_id AS VARCHAR) AS name, n_chars FROM documents)
SELECT name, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM p""")
def _(spark, sf):
    """Names that share their text and differ in two numbers."""
    d = fx.table(spark, sf, "documents").select(F.concat(F.lit("scan_"), "n_chars", F.lit("_take"), "doc_id").alias("name"))
    return sets.number_in_order(d, [sets.natural_key(F.col("name")), F.col("name")])


@query("srt4_preview", "SELECT doc_id, quality FROM labels ORDER BY doc_id LIMIT 25")
def _(spark, sf):
    return fx.table(spark, sf, "labels").orderBy("doc_id").limit(25).select("doc_id", "quality")
