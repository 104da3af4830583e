"""Delimited files that each have a header of their own."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from kinetra.sources import readers


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "Nose_x,Nose_y,Nose_c\n1,2,0.5\n\n3,4,\n")
    write(tmp_path / "b.csv", "Nose_y,Nose_x\n2,1\n4\n")
    write(tmp_path / "c.csv", "Nose_c\tNose_y\tNose_x\r\n0.5\t2\t1\r\n", "utf-8-sig")
    write(tmp_path / "d.csv", '﻿"Nose_x" , Nose_y ,note,note,frame\n"1",2,"a,""b""",second,7\n3,4,"",x,bad\n5,6,,,\n')
    write(tmp_path / "e.csv", "Nose_x,Nose_y\n")
    write(tmp_path / "f.csv", "")
    rows = readers.skeleton_csv(spark, str(tmp_path))
    assert rows.columns == ["swing_id", "frame", "Nose_c", "Nose_x", "Nose_y", "note"]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("a", 0, "0.5", "1", "2", None), ("a", 1, None, "3", "4", None), ("b", 0, None, "1", "2", None), ("b", 1, None, None, "4", None),
        ("c", 0, "0.5", "1", "2", None), ("d", 7, None, "1", "2", 'a,"b"'), ("d", 1, None, "3", "4", None), ("d", 2, None, "5", "6", None)], key=str)
    some = readers.skeleton_csv(spark, str(tmp_path), names=["Nose_y", "absent"])
    assert some.columns == ["swing_id", "frame", "Nose_y", "absent"] and some.count() == 8
    assert some.filter("absent is not null").count() == 0


def test_a_large_file_spreads_over_its_parts(spark, tmp_path):
    write(tmp_path / "in" / "long.csv", "y,x\n" + "".join(f"{i},{i * 2}\n" for i in range(40_000)))
    write(tmp_path / "in" / "short.csv", "x,y\n" + "".join(f"{i * 2},{i}\n" for i in range(100)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = readers.skeleton_csv(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 8
        bad = rows.filter((F.col("frame") != F.col("y").cast("int")) | (F.col("x").cast("int") != 2 * F.col("frame")))
        assert rows.count() == 40_100 and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_quoting_matches_the_csv_module(spark, tmp_path, sep):
    rnd = random.Random(4)
    names = ["p", "q r", "s" + (sep if sep == "," else ""), "t"]
    want = [[rnd.choice(["", "1.5", 'say "x"', f"a{sep}b", '""', "x y", "é|"]) for _ in names] for _ in range(200)]
    want = [w for w in want if any(w)]
    with open(tmp_path / "q.csv", "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(names)
        out.writerows(want)
    got = readers.skeleton_csv(spark, str(tmp_path / "q.csv"), names=names).orderBy("frame").collect()
    assert [[r[n] or "" for n in names] for r in got] == want


def test_no_lines_give_no_rows(spark):
    lines = spark.createDataFrame([], "f string, part long, at long, value string")
    assert readers.headed_rows(lines, "f", "part", "at", names=["x"]).collect() == []
    assert readers.headed_rows(lines, "f", "part", "at").columns == ["f", "frame"]
