"""Grades, categories, names and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Grade texts of the shift rules.
SHIFT_GRADES = {"none": "정보 없음", "low": "부족", "ok": "적정", "high": "과다", "mid": "보통"}
# X-factor range, label and advice by upper bound.
XFACTOR = [
    ("N/A", "정보 없음", ["X-Factor 값을 계산할 수 없습니다. 입력 데이터(어깨/골반 3D)와 임팩트 검출을 확인하세요."]),
    ("< 25°", "낮음", ["상체와 하체의 회전 차이가 작아 파워 손실이 있습니다. 어깨 회전을 더 크게 가져가 보세요.",
                      "백스윙 시 상체가 골반보다 더 많이 돌아가도록 연습해 보세요."]),
    ("25°–40°", "적정", ["이상적인 X-Factor 범위입니다. 상체·하체 분리 회전이 잘 이루어져 파워 전달이 효율적이에요."]),
    ("40°–50°", "높음", ["충분한 꼬임으로 비거리 향상에 유리합니다. 다만 허리·코어의 부담이 커질 수 있으니 유연성 훈련을 병행하세요."]),
    ("> 50°", "과도", ["상체 꼬임이 과도하여 임팩트 타이밍이 흔들릴 수 있습니다. 백스윙을 조금 줄여 보세요.",
                      "허리와 골반이 따로 노는 느낌이 강하면, 회전 범위를 조절해 안정감을 찾아보세요."]),
]
# Mean club head speed (mph) of each group.
HEAD_SPEEDS = [
    ("Female Amateur", 78), ("Male Amateur", 93), ("LPGA Tour Pro", 94),
    ("PGA Tour Pro (avg male pro)", 114), ("Long Driver", 135), ("World Record", 157),
]
# Class names by number of classes, and of the three lower classes alone.
CLASS_NAMES = {
    5: ["worst", "bad", "normal", "good", "best"], 3: ["bad", "normal", "good"], 2: ["false", "true"],
    "lower": ["worst", "bad", "normal"],
}


def back_shift_grade(pct: Column) -> Column:
    g = SHIFT_GRADES
    return (F.when(pct.isNull() | F.isnan(pct), g["none"]).when(pct > -10, g["low"])
            .when(pct.between(-25, -15), g["ok"]).when(pct < -30, g["high"]).otherwise(g["mid"]))


def down_shift_grade(pct: Column) -> Column:
    g = SHIFT_GRADES
    return (F.when(pct.isNull() | F.isnan(pct), g["none"]).when(pct < 10, g["low"])
            .when(pct.between(20, 30), g["ok"]).when(pct > 35, g["high"]).otherwise(g["mid"]))


def head_grade(pct: Column) -> Column:
    return F.when(pct.isNull() | F.isnan(pct), None).when(pct < 5, "Excellent").when(pct < 10, "Good") \
        .when(pct < 15, "Caution").otherwise("Excessive")


def xfactor_category(deg: Column) -> Column:
    """Struct of range, label and advice messages."""
    def row(i: int) -> Column:
        r, label, msgs = XFACTOR[i]
        return F.struct(F.lit(r).alias("range"), F.lit(label).alias("label"),
                        F.array(*[F.lit(m) for m in msgs]).alias("messages"))
    bad = deg.isNull() | F.isnan(deg) | (F.abs(deg) == float("inf"))
    return (F.when(bad, row(0)).when(deg < 25, row(1)).when(deg <= 40, row(2)).when(deg <= 50, row(3)).otherwise(row(4)))


def nearest_speed_group(mph: Column) -> Column:
    """Struct (name, ref, diff) of the closest group, the earlier one on ties."""
    best = F.array_min(F.array(*[
        F.struct(F.abs(mph - ref).alias("d"), F.lit(i).alias("o"), F.lit(name).alias("name"), F.lit(float(ref)).alias("ref"))
        for i, (name, ref) in enumerate(HEAD_SPEEDS)]))
    return F.when(mph.isNotNull(), F.struct(best["name"].alias("name"), best["ref"].alias("ref"), (mph - best["ref"]).alias("diff")))


def speed_group_text(mph: Column) -> Column:
    # The words of this sentence.
    g = nearest_speed_group(mph)
    word = F.when(g["diff"] >= 0, "빠름").otherwise("느림")
    return F.concat(F.lit("현재 추정 클럽 헤드 속도는 '"), g["name"], F.lit("' 평균 "), F.format_string("%.0f", g["ref"]),
                    F.lit(" mph와 가장 가깝습니다 (Δ"), F.format_string("%.1f", F.abs(g["diff"])), F.lit(" mph "), word, F.lit(")."))


def evaluation_class(evaluation: Column) -> Column:
    """(true | false | unknown | other) of an evaluation text."""
    e = F.lower(F.coalesce(evaluation, F.lit("")))
    return (F.when(e.isin("best", "good", "normal"), "true").when(e.isin("bad", "worst"), "false")
            .when(e == "", "unknown").otherwise("other"))


def label_from_path(path: Column, classes: int = 5) -> Column:
    """Class of the first of worst, bad, normal, good, best that is a part of the path; else normal."""
    parts = F.split(path, "/")
    names = CLASS_NAMES[5]
    to = list(range(5)) if classes == 5 else [0, 0, 1, 2, 2]
    out = None
    for n, v in zip(names, to):
        cond = F.array_contains(parts, n)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(to[2])


def to_three(label: Column) -> Column:
    return F.when(label <= 1, 0).when(label == 2, 1).when(label <= 4, 2)


def to_two(label: Column, alternative: bool = False) -> Column:
    return F.when(label.isNull(), None).when(label <= 2, 0).otherwise(1) if alternative \
        else F.when(label.isNull(), None).when(label >= 2, 1).otherwise(0)


def class_name(label: Column, classes: int | str = 5) -> Column:
    out = None
    for i, n in enumerate(CLASS_NAMES[classes]):
        out = F.when(label == i, n) if out is None else out.when(label == i, n)
    return out.otherwise(label.cast("string"))


def object_key(key: Column) -> Column:
    """owner, dimension and job id of <owner>/<dimension>/<job>[.ext]."""
    parts = F.split(key, "/")
    last = F.element_at(parts, -1)
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("owner"), F.lower(F.try_element_at(parts, F.lit(2))).alias("dimension"),
        F.regexp_replace(last, r"\.[^.]*$", "").alias("job_id"))


def source_path(label_path: Column) -> Column:
    """Image path of a label file."""
    return F.regexp_replace(F.regexp_replace(label_path, r"\[라벨\]", "[원천]"), r"\.json$", ".jpg")


def title_and_frame(stem: Column) -> tuple[Column, Column]:
    """Prefix and number of <prefix>_<number>; NULL number where the last part is not one."""
    number = F.regexp_extract(stem, r"(?:^|_)(\d+)$", 1)
    return F.regexp_replace(stem, r"_[^_]*$", ""), F.when(number != "", number.try_cast("int"))


def slice_part(stem: Column) -> tuple[Column, Column]:
    """Prefix and part number of <prefix>_NN (two digits)."""
    n = F.regexp_extract(stem, r"_(\d{2})$", 1)
    return F.when(n != "", F.regexp_replace(stem, r"_\d{2}$", "")), n.try_cast("int")


def crop_name(stem: Column) -> Column:
    """part and person of part##_person## and person of _personNN_crop names."""
    both = r"part(\d+)_person(\d+)"
    part = F.regexp_extract(stem, both, 1)
    person = F.coalesce(F.nullif(F.regexp_extract(stem, r"_person(\d+)_crop$", 1), F.lit("")),
                        F.nullif(F.regexp_extract(stem, both, 2), F.lit("")))
    return F.struct(F.nullif(part, F.lit("")).cast("int").alias("part"), person.cast("int").alias("person"))


def parse_scalar(text: Column) -> Column:
    """Number text without a useless fraction ('12.0' reads 12); empty reads NULL."""
    t = F.nullif(F.trim(text), F.lit(""))
    n = t.try_cast("double")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(n.isNull() | F.isnan(n), F.when(~F.lower(t).isin("nan", "none"), t)).when(whole, n.cast("long").cast("string")).otherwise(t)
