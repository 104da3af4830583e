"""SQL text of the fixture views, for checking results with another engine."""

R6 = "(CASE WHEN abs({0}) < 0.0000005 THEN 0.0 ELSE round({0}, 6) END)"

FRAMES = """
frames AS (
  SELECT user_id AS swing_id, event_id, ts, event_type, props, value AS v,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
         CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS n
  FROM events)"""

POSE = FRAMES + """,
joints AS (SELECT CAST(unnest(range(0, 17)) AS INT) AS j),
p1 AS (SELECT swing_id, event_id, frame, n, least(greatest(frame - 12, 0), n - 24) AS ph FROM frames),
p2 AS (SELECT *, abs((ph + 10) % 40 - 20) - 10 AS q,
             CASE WHEN frame > 12 AND frame < n - 12 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END AS amp FROM p1),
p3 AS (SELECT p2.*, j, CASE WHEN j < 5 THEN 0 WHEN j % 2 = 1 THEN 1 ELSE -1 END AS side,
             CASE WHEN j < 5 THEN 0 WHEN j < 7 THEN 60 WHEN j < 9 THEN 70 WHEN j < 11 THEN 50
                  WHEN j < 13 THEN 40 WHEN j < 15 THEN 60 ELSE 80 END AS w
      FROM p2 CROSS JOIN joints),
p4 AS (SELECT *, 960 + side * w + (CASE WHEN j IN (9, 10) THEN 10 * q WHEN j < 7 THEN q ELSE 0 END)
                + ((event_id * 7 + j * 13) % 11 - 5) * amp
                + (CASE WHEN (event_id + j) % 97 = 0 THEN 300 ELSE 0 END) AS x0,
             200 + 40 * j + ((event_id * 5 + j * 3) % 11 - 5) * amp AS y0,
             CAST(2.5 AS DOUBLE) + side * q * (CASE WHEN j IN (5, 6) THEN CAST(0.012 AS DOUBLE)
                  WHEN j IN (11, 12) THEN CAST(0.004 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS z0,
             (event_id * 17 + j * 29) % 23 = 0 AS miss FROM p3),
pose AS (
SELECT swing_id, frame, 0 AS person_idx, j AS joint_idx, event_id, n,
       CASE WHEN miss THEN CAST(0 AS DOUBLE) ELSE CAST(x0 AS DOUBLE) END AS x,
       CASE WHEN miss THEN CAST(0 AS DOUBLE) ELSE CAST(y0 AS DOUBLE) END AS y,
       CASE WHEN miss THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) + CAST((event_id + 11 * j) % 70 AS DOUBLE) / 100 END AS conf,
       CASE WHEN miss THEN NULL ELSE (x0 - 960) / CAST(400 AS DOUBLE) END AS X3,
       CASE WHEN miss THEN NULL ELSE (y0 - 540) / CAST(400 AS DOUBLE) END AS Y3,
       CASE WHEN miss THEN NULL ELSE z0 END AS Z3
FROM p4)"""

# Missing markers masked: the table that metrics read.
CLEAN = POSE + """,
clean AS (
SELECT swing_id, frame, person_idx, joint_idx, event_id, n,
       CASE WHEN x = 0 AND y = 0 AND conf = 0 THEN NULL ELSE x END AS x,
       CASE WHEN x = 0 AND y = 0 AND conf = 0 THEN NULL ELSE y END AS y,
       CASE WHEN x = 0 AND y = 0 AND conf = 0 THEN NULL ELSE conf END AS conf, X3, Y3, Z3
FROM pose)"""

_WIDE = ", ".join(
    f"max(CASE WHEN joint_idx = {i} THEN X3 END) AS {k}_X, max(CASE WHEN joint_idx = {i} THEN Y3 END) AS {k}_Y, "
    f"max(CASE WHEN joint_idx = {i} THEN Z3 END) AS {k}_Z, max(CASE WHEN joint_idx = {i} THEN x END) AS {k}_px, "
    f"max(CASE WHEN joint_idx = {i} THEN y END) AS {k}_py"
    for i, k in enumerate((
        "Nose", "LEye", "REye", "LEar", "REar", "LShoulder", "RShoulder", "LElbow", "RElbow",
        "LWrist", "RWrist", "LHip", "RHip", "LKnee", "RKnee", "LAnkle", "RAnkle")))
WIDE = CLEAN + f""",
wide AS (SELECT swing_id, frame, n, {_WIDE} FROM clean GROUP BY swing_id, frame, n)"""

EMB_A = """
emb_a AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS INT) AS label, embedding[1:32] AS vec FROM embeddings)"""
EMB_B = """
emb_b AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding[33:64] AS vec FROM embeddings WHERE vec_id % 11 <> 0)"""
CLIPS = """
emb_clips AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS INT) AS label, clip, embedding[clip*16+1:clip*16+16] AS vec
              FROM embeddings, (SELECT CAST(unnest(range(0, 4)) AS INT) AS clip))"""
PREDS = """
pr0 AS (SELECT vec_id, clip, CAST(label % 5 AS INT) AS gt,
        list_transform(embedding[clip*5+1:clip*5+5], lambda x: CAST(x AS DOUBLE)) AS scores
        FROM embeddings, (SELECT CAST(unnest(range(0, 4)) AS INT) AS clip)),
preds AS (SELECT CAST(vec_id AS VARCHAR) AS id, clip, gt,
          CASE WHEN vec_id % 17 <> 0 THEN CAST(list_position(scores, list_max(scores)) - 1 AS INT) END AS pred, scores FROM pr0)"""
SAMPLES = """
samples AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS label, d.source, d.lang, d.n_chars, CAST(l.doc_id % 5 AS INT) AS label5
            FROM labels l JOIN documents d USING (doc_id))"""
FILES = FRAMES + """,
fi0 AS (SELECT swing_id, event_id, event_type, frame, '20240101_G_' || CAST(swing_id AS VARCHAR) AS prefix,
        CAST(frame + CASE WHEN swing_id % 3 = 0 THEN 10 * (frame // 15) WHEN swing_id % 3 = 1 THEN frame // 20 ELSE 0 END AS INT) AS frame_no
        FROM frames),
fi1 AS (SELECT *, prefix || '_' || lpad(CAST(frame_no AS VARCHAR), 4, '0') AS stem FROM fi0),
files AS (SELECT *, '/data/Amateur/[라벨]set/' || prefix || '/' || stem || '.json' AS path FROM fi1)"""
CUTS = FRAMES + """,
cuts AS (SELECT swing_id AS video, frame AS seq, frame + ((event_id * 37) % 90) / CAST(100 AS DOUBLE) AS cut,
         n + CAST(0.5 AS DOUBLE) AS duration FROM frames)"""
BOXES = """
bx0 AS (SELECT *, l_quantity * 4 + (l_partkey % 2) * 900 - 40 AS x1, l_suppkey % 50 + l_discount * 100 AS y1 FROM lineitem),
boxes AS (SELECT l_orderkey AS video, l_linenumber AS frame, CAST(l_partkey % 2 AS INT) AS person, x1, y1,
          x1 + 150 + l_suppkey % 13 AS x2, y1 + 400 + l_partkey % 17 AS y2 FROM bx0)"""
JOBS = """
jobs AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) AS job_id, CAST(user_id AS VARCHAR) AS owner,
         event_id, ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING'
         WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'GETTING' ELSE 'FAILED' END AS status,
         CASE WHEN event_type = 'purchase' THEN 'results/' || CAST(event_id AS VARCHAR) || '.json' END AS result_path FROM events)"""

VIEWS = {
    "$FRAMES": FRAMES, "$POSE": POSE, "$CLEAN": CLEAN, "$WIDE": WIDE, "$EMB_A": EMB_A, "$EMB_B": EMB_B,
    "$CLIPS": CLIPS, "$PREDS": PREDS, "$SAMPLES": SAMPLES, "$FILES": FILES, "$CUTS": CUTS,
    "$BOXES": BOXES, "$JOBS": JOBS,
}
