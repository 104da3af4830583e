"""Streams with state that Spark keeps, and the ledger of an ingest."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators.smooth import euro_step
from kinetra.streaming import keyed, ledger, run

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, n int, x double, note string"


def rows_of(frames):
    return [(k, T0 + timedelta(seconds=s), n, x, f"{k}{n}") for n, (k, s, x) in enumerate(frames)]


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def live(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = keyed.start(spark, keyed.keyed_filter(stream, ["k"], ["ts", "n"], "x", **options), str(folder))
    query.awaitTermination()
    return {r.n: (r.filtered, r.frames, r.note) for r in spark.read.parquet(f"{folder}/rows").collect()}


@pytest.mark.parametrize("method", ["ema", "oneeuro"])
def test_batches_go_on_where_the_last_one_left_off(spark, tmp_path, method):
    rng = np.random.default_rng(1)
    frames = [(k, i, float(v)) for i, v in enumerate(np.cumsum(rng.normal(0, 1, 90))) for k in "ab"]
    for at, gap in ((0, None), (1, float("nan")), (40, None), (41, None), (120, float("nan"))):
        frames[at] = (*frames[at][:2], gap)
    rows = rows_of(frames)
    for part in range(3):
        write(spark, tmp_path, f"p{part}", rows[part * 60:(part + 1) * 60][::-1])
        if part:  # the query is started again for each further file
            live(spark, tmp_path, method=method, idle=1000)
    got = live(spark, tmp_path, method=method, idle=1000)
    states = dict.fromkeys("ab")
    for k, _, n, x, note in rows:
        if x is not None and x == x:
            states[k] = euro_step(x, states[k], 1 / 30, 1.0, 0.007, 1.0) if method == "oneeuro" else \
                (x if states[k] is None else 0.2 * x + (1 - 0.2) * states[k][0], 0.0)
        assert got[n] == (states[k][0] if states[k] else None, n // 2 + 1, note)
    held = {r.k: (r.y, r.speed, r.frames) for r in keyed.states(spark, str(tmp_path)).collect()}
    assert held == {k: (*states[k], 90) for k in "ab"}


def test_an_idle_series_is_forgotten_and_starts_afresh(spark, tmp_path):
    write(spark, tmp_path, "1", rows_of([("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 2.0)]))
    write(spark, tmp_path, "2", [("b", T0 + timedelta(seconds=100), 3, 3.0, "b3")])
    write(spark, tmp_path, "3", [("a", T0 + timedelta(seconds=101), 4, 9.0, "a4"), ("b", T0 + timedelta(seconds=101), 5, 4.0, "b5")])
    got = live(spark, tmp_path, idle=60, alpha=0.5)
    assert got[4][:2] == (9.0, 1) and got[1][:2] == (1.0, 1) and got[2][:2] == (1.5, 2)
    write(spark, tmp_path, "4", [("c", T0 + timedelta(seconds=130), 6, 5.0, "c6")])
    live(spark, tmp_path, idle=60, alpha=0.5)
    assert {r.k for r in keyed.states(spark, str(tmp_path)).collect()} == {"a", "b", "c"}
    write(spark, tmp_path, "5", [("c", T0 + timedelta(seconds=180), 7, 6.0, "c7")])
    live(spark, tmp_path, idle=60, alpha=0.5)
    assert {r.k for r in keyed.states(spark, str(tmp_path)).collect()} == {"c"}


def test_series_that_share_a_bucket_end_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 1)
    test_an_idle_series_is_forgotten_and_starts_afresh(spark, tmp_path)


def test_columns_come_through_as_they_were(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 1)
    schema = "k long, ts timestamp, n int, x double, big long, f float, list array<int>, at timestamp_ntz, day date, cost decimal(9,2), flag boolean"
    nan, late = float("nan"), datetime(2300, 1, 1, 0, 0, 0, 1)
    rest = ((1 << 62) + 1, 0.1, [1, None], late, late.date(), Decimal("1.20"), True)
    rows = [(None, T0, 1, 1.0, *rest), (None, T0, None, 2.0, *[None] * 7), (1, T0, 3, nan, None, nan, [], None, None, None, False), (1, None, 4, None, *rest),
            (2, T0, 5, None, *rest), (0, T0, 6, 7.0, *rest)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    keyed.start(spark, keyed.keyed_filter(stream, ["k"], ["ts", "n"], "x", alpha=0.5), str(tmp_path)).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/rows")
    was = spark.read.parquet(f"{tmp_path}/in/1")
    assert got.dtypes[:len(was.columns)] == was.dtypes
    assert sorted(map(str, got.select(*was.columns).collect())) == sorted(map(str, was.collect()))
    # Nulls come first in the order of a series, and series by the keys 0 and null are two.
    assert {(r.k, r.n): (r.filtered, r.frames) for r in got.collect()} == {
        (None, None): (2.0, 1), (None, 1): (1.5, 2), (1, 4): (None, 1), (1, 3): (None, 2), (2, 5): (None, 1), (0, 6): (7.0, 1)}


def test_slices_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "FILE_ROWS", 10)
    monkeypatch.setattr(run, "scratch", lambda spark: str(tmp_path / "staged"))
    rows = spark.createDataFrame([(float(v),) for v in [*np.linspace(0, 1, 97), 5, 6, 8]], "v double")
    stream, seen = run.staged(rows, 4, "v", spark.createDataFrame([(99.0,)], "v double")), []
    stream.writeStream.foreachBatch(lambda df, epoch: seen.append(sorted(r.v for r in df.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert [len(list((tmp_path / "staged" / f"slice={k}").glob("*.parquet"))) for k in range(5)] == [3] * 5
    assert len(seen[0]) == 97 and seen[1:] == [[], [5.0], [6.0, 8.0], [99.0]]


def test_bad_options_are_refused(spark):
    stream = spark.readStream.schema(SCHEMA).parquet("/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="median"):
        keyed.keyed_filter(stream, ["k"], ["ts"], "x", method="median")
    with pytest.raises(ValueError, match="alpha"):
        keyed.keyed_filter(stream, ["k"], ["ts"], "x", alpha=0)


def outcome(df, bad):
    return df.withColumns({"status": F.when(bad, "failed").otherwise("done"), "error": F.when(bad, "broken")})


def test_files_land_once_over_runs_and_crashes(spark, tmp_path):
    folder = str(tmp_path / "l")
    files = spark.createDataFrame([(f"f{i // 2}", i) for i in range(40)], "video_path string, v long")
    assert ledger.landed(spark, folder) is None and ledger.entries(spark, folder) is None and ledger.committed(spark, folder).count() == 0
    seen = []

    def first(df):
        seen.append(sorted({r.video_path for r in df.collect()}))
        return outcome(df, F.col("v") == 7)  # one row of f3: the file fails as a whole

    ledger.ingest(run.staged(files, 2, "v"), first, folder, "one").awaitTermination()
    assert [len(s) for s in seen] == [10, 10] and ledger.committed(spark, folder).count() == 2
    assert {r.video_path: r.status for r in ledger.entries(spark, folder).collect()} == {f"f{i}": "failed" if i == 3 else "done" for i in range(20)}
    assert ledger.landed(spark, folder).count() == 38
    # A batch that Spark repeats after its commit changes nothing, one cut short before it leaves nothing to see.
    ledger.land(files, "one", 1, first, folder)
    ledger.land(files, "two", 0, lambda df: outcome(df, F.lit(False)), folder, commit=False)
    assert len(seen) == 2 and ledger.landed(spark, folder).count() == 38 and ledger.committed(spark, folder).count() == 2
    # Repeated, it overwrites what it had written and takes only what isn't done.
    ledger.land(files, "two", 0, lambda df: outcome(df, F.lit(False)), folder)
    rows = ledger.landed(spark, folder)
    assert rows.columns == ["video_path", "v"] and sorted(map(tuple, rows.collect())) == sorted((f"f{i // 2}", i) for i in range(40))
    last = ledger.committed(spark, folder).filter("run = 'two'").first()
    assert (last.files, last.failed) == (1, 0)
    ledger.ingest(run.staged(files, 2, "v"), first, folder, "three").awaitTermination()
    assert seen[2:] == [[], []] and ledger.landed(spark, folder).count() == 40


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    folder, rows = str(tmp_path / "l"), "video_path string, v long"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(rows).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for k in range(2):
        spark.createDataFrame([(f"f{k}", k)], rows).write.parquet(str(tmp_path / "in" / str(k)))
        ledger.ingest(source, lambda df: outcome(df, F.lit(False)), folder, "only").awaitTermination()
    assert sorted(r.epoch for r in ledger.committed(spark, folder).collect()) == [0, 1]
    assert sorted(r.v for r in ledger.landed(spark, folder).collect()) == [0, 1]
    spark.createDataFrame([], rows).write.parquet(str(tmp_path / "none"))
    ledger.land(spark.read.schema(rows).parquet(str(tmp_path / "none")), "empty", 0, lambda df: outcome(df, F.lit(False)), folder)
    assert ledger.committed(spark, folder).filter("run = 'empty'").first().files == 0
