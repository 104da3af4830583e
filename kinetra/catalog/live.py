"""Queries on job events and live filters, as streams over the event table and as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.catalog.registry import query, r6
from kinetra.operators import cluster
from kinetra.operators.sequence import number_rows
from kinetra.sources import fixtures as fx, writers
from kinetra.streaming import jobs, keyed, ledger, run

_LATEST = """WITH $JOBS SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(result_path, (ts, event_id)) FILTER (WHERE result_path IS NOT NULL) AS result_path, count(*) AS updates FROM jobs GROUP BY 1"""


@query("str1_latest_status", _LATEST)
def _(spark, sf):
    return jobs.latest_status(fx.jobs(spark, sf))


@query("str1_latest_status_stream", _LATEST)
def _(spark, sf):
    stream = fx.jobs_of(run.stream_table(spark, sf, "events"))
    return run.run_complete(spark, jobs.latest_status(stream))


@query("str1_irregular_steps", """WITH $JOBS, s AS (SELECT job_id, event_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM jobs),
p AS (SELECT *, list_position(['PENDING', 'PROCESSING', 'COMPLETED', 'GETTING'], status) AS b, list_position(['PENDING', 'PROCESSING', 'COMPLETED', 'GETTING'], before) AS a FROM s)
SELECT job_id, event_id, before, status FROM p WHERE NOT CASE WHEN status = 'FAILED' THEN before IS NOT NULL WHEN before IS NULL THEN status = 'PENDING' WHEN before = 'FAILED' THEN status = 'PENDING' ELSE b - a IN (0, 1) END""")
def _(spark, sf):
    return jobs.irregular_steps(fx.jobs(spark, sf), F.to_date("ts"))


_BOTH = """WITH $JOBS, a AS (SELECT job_id, event_id, ts FROM jobs WHERE status = 'PENDING'), b AS (SELECT job_id, ts, event_id AS payload FROM jobs WHERE status = 'COMPLETED')
SELECT a.event_id, a.job_id, b.payload, CASE WHEN b.payload IS NOT NULL THEN 'complete' ELSE 'partial' END AS state FROM a LEFT JOIN b ON a.job_id = b.job_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 90000 SECOND"""


@query("str2_wait_for_both", _BOTH)
def _(spark, sf):
    j = fx.jobs(spark, sf)
    a = j.filter("status = 'PENDING'").select("job_id", "event_id", "ts")
    b = j.filter("status = 'COMPLETED'").select("job_id", "ts", F.col("event_id").alias("payload"))
    return jobs.wait_for_both(a, b, 90000).select("event_id", "job_id", "payload", "state")


def _later(spark, **values):
    """One row far behind all others in time, which closes a stream."""
    return spark.range(1).select(*[F.lit(v).cast(t).alias(n) for n, (v, t) in values.items()])


_FAR = ("2100-01-01", "timestamp")


@query("str2_wait_for_both_stream", _BOTH)
def _(spark, sf):
    j = fx.jobs(spark, sf)
    a = j.filter("status = 'PENDING'").select("job_id", "event_id", "ts")
    b = j.filter("status = 'COMPLETED'").select("job_id", "ts", F.col("event_id").alias("payload"))
    none, far = ("", "string"), (-1, "long")
    first = run.staged(a, 3, "ts", _later(spark, job_id=none, event_id=far, ts=_FAR))
    second = run.staged(b, 3, "ts", _later(spark, job_id=none, ts=_FAR, payload=far))
    return run.run_append(spark, jobs.wait_for_both(first, second, 90000)).filter("event_id >= 0").select("event_id", "job_id", "payload", "state")


@query("str4_live_ema", """WITH RECURSIVE $FRAMES, r AS (SELECT swing_id, frame, v AS y FROM frames WHERE frame = 0 UNION ALL
 SELECT f.swing_id, f.frame, 0.2 * f.v + 0.8 * r.y FROM r JOIN frames f ON f.swing_id = r.swing_id AND f.frame = r.frame + 1)
SELECT f.event_id, r6(r.y) AS filtered FROM r JOIN frames f ON f.swing_id = r.swing_id AND f.frame = r.frame""")
def _(spark, sf):
    return _live(spark, sf, 40 * _DAY)[0].select("event_id", r6("filtered").alias("filtered"))


_DAY = 86400


def _live(spark, sf, idle, **options):
    """The events of each user as a live series, in four micro-batches: what the filter put out, and the folder of its run."""
    ev = fx.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    folder = run.scratch(spark)
    keyed.start(spark, keyed.keyed_filter(run.staged(ev, 4, "ts"), ["user_id"], ["ts", "event_id"], "value", idle=idle, **options), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows"), folder


_CUT = "(1.0e0 / (1.0e0 + (1.0e0 / (6.283185307179586e0 * ({}))) / 0.03333333333333333e0))"
_GAIN = _CUT.format("1.0e0 + 0.007e0 * abs(q.dh)")


@query("str4_live_one_euro", f"""WITH RECURSIVE $FRAMES, r AS (SELECT swing_id, frame, event_id, v AS y, 0e0 AS dh FROM frames WHERE frame = 0 UNION ALL
 SELECT q.swing_id, q.frame, q.event_id, {_GAIN} * q.v + (1 - {_GAIN}) * q.py, q.dh
 FROM (SELECT f.swing_id, f.frame, f.event_id, f.v, r.y AS py, {_CUT.format('1.0e0')} * (f.v - r.y) + (1 - {_CUT.format('1.0e0')}) * r.dh AS dh
       FROM r JOIN frames f ON f.swing_id = r.swing_id AND f.frame = r.frame + 1) q)
SELECT event_id, CAST(frame + 1 AS BIGINT) AS frames, r6(y) AS filtered FROM r""")
def _(spark, sf):
    return _live(spark, sf, 40 * _DAY, method="oneeuro")[0].select("event_id", "frames", r6("filtered").alias("filtered"))


@query("str4_idle_series_forgotten", """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id FROM l WHERE last + INTERVAL 21600 SECOND > (SELECT max(last) FROM l)""")
def _(spark, sf):
    """Series whose state is still held at the end: those with a frame in the last six hours."""
    return keyed.states(spark, _live(spark, sf, _DAY // 4)[1]).select("user_id")


@query("str3_exactly_once", """SELECT doc_id, sum(n_chars) AS n_chars, count(*) AS rows, CASE WHEN doc_id % 7 = 3 THEN 'second' ELSE 'first' END AS run,
 CASE WHEN doc_id % 7 = 3 THEN 2 ELSE 1 END AS attempts, CASE WHEN doc_id % 7 = 3 THEN 'no frames' END AS error FROM documents GROUP BY doc_id""")
def _(spark, sf):
    """A run in three micro-batches in which some files fail, a batch that comes again, one that is cut short, and a second run."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    folder, path = run.scratch(spark), "doc_id"

    def process(df, bad=F.lit(False)):
        return df.withColumns({"status": F.when(bad, "failed").otherwise("done"), "error": F.when(bad, "no frames")})

    def failing(df):
        return process(df, F.col("doc_id") % 7 == 3)

    ledger.ingest(run.staged(docs, 3, "doc_id"), failing, folder, "first", path).awaitTermination()
    ledger.land(docs, "first", 1, process, folder, path)
    ledger.land(docs, "lost", 0, process, folder, path, commit=False)
    ledger.ingest(run.staged(docs, 2, "doc_id"), process, folder, "second", path).awaitTermination()
    rows = ledger.landed(spark, folder, path).groupBy("doc_id").agg(F.sum("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    seen = ledger.entries(spark, folder, path).join(ledger.committed(spark, folder).select("batch", "run"), "batch")
    seen = seen.groupBy("doc_id").agg(F.max(F.when(F.col("status") == "done", F.col("run"))).alias("run"),
                                      F.count(F.lit(1)).cast("int").alias("attempts"), F.max("error").alias("error"))
    return rows.join(seen, "doc_id")


@query("str5_notify_once", """WITH $JOBS SELECT DISTINCT job_id, owner FROM jobs WHERE status = 'COMPLETED'""")
def _(spark, sf):
    j = fx.jobs(spark, sf)
    return jobs.notify_once(j, j.select("job_id", "owner").distinct())


_BACKFILL = """WITH f AS (SELECT event_id, user_id AS request_id, ts FROM events WHERE event_type = 'view'), r AS (SELECT user_id AS request_id, min(ts) AS ts, arg_min(value, ts) AS result FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT f.event_id, f.request_id, r6(r.result) AS result FROM f LEFT JOIN r ON f.request_id = r.request_id AND r.ts >= f.ts AND r.ts <= f.ts + INTERVAL 86400 SECOND"""


def _frames_and_results(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    frames = ev.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("request_id"), "ts")
    res = ev.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("request_id")).agg(
        F.min("ts").alias("ts"), F.min_by("value", "ts").alias("result"))
    return frames, res


@query("str6_backfill", _BACKFILL)
def _(spark, sf):
    frames, res = _frames_and_results(spark, sf)
    return jobs.backfill(frames, res, 86400).select("event_id", "request_id", r6("result").alias("result"))


@query("str5_notify_once_stream", """WITH $JOBS SELECT DISTINCT job_id, owner FROM jobs WHERE status = 'COMPLETED'""")
def _(spark, sf):
    j = fx.jobs(spark, sf)
    return run.run_append(spark, jobs.notify_once(run.staged(j.select("job_id", "owner", "status", "ts"), 3, "ts"), j.select("job_id", "owner").distinct()))


@query("str6_backfill_stream", _BACKFILL)
def _(spark, sf):
    frames, res = _frames_and_results(spark, sf)
    far, number = (-1, "long"), (0, "double")
    frames = run.staged(frames, 3, "ts", _later(spark, event_id=far, request_id=far, ts=_FAR))
    res = run.staged(res, 3, "ts", _later(spark, request_id=(-2, "long"), ts=_FAR, result=number))
    return run.run_append(spark, jobs.backfill(frames, res, 86400)).filter("event_id >= 0").select("event_id", "request_id", r6("result").alias("result"))


# ---- clusters and document forms ---------------------------------------------------------------

@query("ml8_box_clusters", """WITH RECURSIVE $BOXES, bc AS (SELECT video % 40 AS "group", x1, x2, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, row_number() OVER (ORDER BY video % 40, video, frame, x1, y1) - 1 AS id FROM boxes),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM bc a JOIN bc b ON a."group" = b."group" AND abs(a.x - b.x) <= 100 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 10000),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 3),
link AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN core c ON c.id = near.a SEMI JOIN core d ON d.id = near.b),
cc(id, root) USING KEY (id) AS (SELECT id, id FROM core UNION SELECT l.b, min(cc.root) FROM cc JOIN link l ON l.a = cc.id JOIN recurring.cc r ON r.id = l.b WHERE cc.root < r.root GROUP BY l.b),
own AS (SELECT n.a AS id, min(cc.root) AS root FROM near n JOIN cc ON cc.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY 1 UNION ALL SELECT id, root FROM cc),
num AS (SELECT root, row_number() OVER (PARTITION BY "group" ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM cc) JOIN bc ON bc.id = root)
SELECT "group", CAST(cluster AS INT) AS cluster, count(*) AS boxes, r6(min(x1)) AS x1, r6(max(x2)) AS x2 FROM own JOIN num USING (root) JOIN bc USING (id) GROUP BY 1, 2""")
def _(spark, sf):
    b = fx.boxes(spark, sf).select((F.col("video") % 40).alias("video"), "x1", "y1", "x2", "y2", "frame", "video", "person").toDF(
        "group", "x1", "y1", "x2", "y2", "frame", "video", "person")
    ided = number_rows(b, [], [F.col("group"), F.col("video"), F.col("frame"), F.col("x1"), F.col("y1")], F.col("group"), "id")
    out = cluster.box_clusters(ided, ["group"], "id", 100.0, 3)
    return out.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("boxes"), r6(F.min("x1")).alias("x1"), r6(F.max("x2")).alias("x2"))


@query("snk2_records", """WITH $FRAMES SELECT swing_id, '[' || string_agg('{"frame":' || frame || ',"event_id":' || event_id || '}', ',' ORDER BY frame) || ']' AS text FROM frames GROUP BY 1""")
def _(spark, sf):
    return writers.oriented(fx.frames(spark, sf), ["swing_id"], "frame", ["frame", "event_id"], "records")


@query("snk2_columns", """WITH $FRAMES SELECT swing_id, '{"n":{' || string_agg('"' || frame || '":' || n, ',' ORDER BY frame) || '},"event_id":{'
 || string_agg('"' || frame || '":' || event_id, ',' ORDER BY frame) || '}}' AS text FROM frames GROUP BY 1""")
def _(spark, sf):
    return writers.oriented(fx.frames(spark, sf), ["swing_id"], "frame", ["n", "event_id"], "columns")


@query("snk2_split", """WITH $FRAMES SELECT swing_id, '{"columns":["frame","event_type"],"data":[' || string_agg('[' || frame || ',"' || event_type || '"]', ',' ORDER BY frame) || ']}' AS text FROM frames GROUP BY 1""")
def _(spark, sf):
    return writers.oriented(fx.frames(spark, sf), ["swing_id"], "frame", ["frame", "event_type"], "split")


@query("snk2_index", """WITH $FRAMES SELECT swing_id, '{' || string_agg('"' || frame || '":{"n":' || n || ',"event_id":' || event_id || '}', ',' ORDER BY frame) || '}' AS text FROM frames GROUP BY 1""")
def _(spark, sf):
    return writers.oriented(fx.frames(spark, sf), ["swing_id"], "frame", ["n", "event_id"], "index")


@query("snk2_values", """WITH $FRAMES SELECT swing_id, '[' || string_agg('[' || n || ',"' || event_type || '"]', ',' ORDER BY frame) || ']' AS text FROM frames GROUP BY 1""")
def _(spark, sf):
    return writers.oriented(fx.frames(spark, sf), ["swing_id"], "frame", ["n", "event_type"], "values")


@query("snk2_table", """WITH $FRAMES SELECT swing_id, '{"schema":{"fields":[{"name":"n","type":"integer"},{"name":"event_type","type":"string"}]},"data":['
 || string_agg('{"n":' || n || ',"event_type":"' || event_type || '"}', ',' ORDER BY frame) || ']}' AS text FROM frames GROUP BY 1""")
def _(spark, sf):
    return writers.oriented(fx.frames(spark, sf), ["swing_id"], "frame", ["n", "event_type"], "table")
