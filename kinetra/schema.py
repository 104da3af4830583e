"""Table shapes, joint vocabularies and tunable parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Joint vocabularies and index maps of the pose extractors.
KP17 = [
    "Nose", "LEye", "REye", "LEar", "REar", "LShoulder", "RShoulder", "LElbow", "RElbow",
    "LWrist", "RWrist", "LHip", "RHip", "LKnee", "RKnee", "LAnkle", "RAnkle",
]
OPENPOSE18 = [
    "Nose", "Neck", "RShoulder", "RElbow", "RWrist", "LShoulder", "LElbow", "LWrist", "RHip",
    "RKnee", "RAnkle", "LHip", "LKnee", "LAnkle", "REye", "LEye", "REar", "LEar",
]
BODY25 = [
    "Nose", "Neck", "RShoulder", "RElbow", "RWrist", "LShoulder", "LElbow", "LWrist", "MidHip",
    "RHip", "RKnee", "RAnkle", "LHip", "LKnee", "LAnkle", "REye", "LEye", "REar", "LEar",
    "LBigToe", "LSmallToe", "LHeel", "RBigToe", "RSmallToe", "RHeel",
]
MEDIAPIPE33 = [
    "nose", "left_eye_inner", "left_eye", "left_eye_outer", "right_eye_inner", "right_eye",
    "right_eye_outer", "left_ear", "right_ear", "mouth_left", "mouth_right", "left_shoulder",
    "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_pinky",
    "right_pinky", "left_index", "right_index", "left_thumb", "right_thumb", "left_hip",
    "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle", "left_heel",
    "right_heel", "left_foot_index", "right_foot_index",
]
VOCABULARIES = {
    "coco17": KP17, "openpose18": OPENPOSE18, "body25": BODY25, "mediapipe33": MEDIAPIPE33,
}

POSE = T.StructType([
    T.StructField("swing_id", T.StringType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("person_idx", T.IntegerType()),
    T.StructField("joint_idx", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "conf", "X3", "Y3", "Z3")],
])

POSE_JSON = T.StructType([
    T.StructField("people", T.ArrayType(T.StructType([
        T.StructField("pose_keypoints_2d", T.ArrayType(T.DoubleType())),
    ]))),
])

LABEL_JSON = T.StructType([
    T.StructField("categories", T.StructType([
        T.StructField("keypoints", T.ArrayType(T.StringType()))])),
    T.StructField("image", T.StructType([
        *[T.StructField(c, T.StringType()) for c in ("filename", "copyrighter", "date", "number")],
        T.StructField("resolution", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.StringType()) for c in ("action", "evaluation", "hitting")]])),
    T.StructField("environment", T.StructType([
        T.StructField(c, T.StringType()) for c in ("time", "location", "weather")])),
    T.StructField("actor", T.StructType([
        T.StructField(c, T.StringType()) for c in ("grade", "sex", "age", "size", "height")])),
    T.StructField("usage", T.StructType([
        T.StructField(c, T.StringType()) for c in ("scope", "stage")])),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("class", T.StringType()),
        T.StructField("polygon", T.ArrayType(T.DoubleType())),
        # Points arrive flat (x, y, visibility, ...) or as pairs: kept as text and read per form.
        T.StructField("points", T.StringType())]))),
])

INTRINSICS_BODY = T.StructType([
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("fx", "fy", "cx", "cy")],
    T.StructField("coeffs", T.ArrayType(T.DoubleType())),
])
# Key names under which camera intrinsics are accepted, in order.
INTRINSICS_KEYS = ("color_intrinsics", "intrinsics", "intrinsics_color", "camera_intrinsics")

PREDICTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("clip", T.IntegerType()),
    T.StructField("gt_label", T.IntegerType()),
    T.StructField("pred_label", T.IntegerType()),
    T.StructField("pred_score", T.ArrayType(T.DoubleType())),
    T.StructField("pred_scores", T.ArrayType(T.DoubleType())),
])

JOB = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "id", "user_id", "non_member_identifier", "upload_source", "s3_key",
        "original_filename", "file_type")],
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("processing_status", T.StringType()),
    T.StructField("s3_result_path", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

MANIFEST = T.StructType([
    T.StructField(c, T.StringType()) for c in ("video_path", "status", "output_csv", "ts", "error")
])


@dataclass(frozen=True)
class Params:
    """Settings shared by the metrics."""

    fps: float | None = 30.0
    coord_unit: str = "m"
    dimension: str = "3d"
    head_joint: str = "Nose"
    wrist: str = "RWrist"
    skip_ratio: float = 0.2
    m_per_px: float | None = None
    shoulder_width_m: float | None = None
    height_m: float | None = None
    sway_outward_ratio: float = 0.08
    # After a missing frame, line angles go on from the last valid one ("skip") or end ("stop").
    angle_gaps: str = "skip"
    image_width: int = 1920
    image_height: int = 1080
    # Frames per block: a swing longer than this is spread over several tasks.
    block: int = 4096
