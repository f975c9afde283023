"""Tracks to files and back."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.sources import series_io as S

SCHEMA = "track string, part int, i int, t double, label string, ok boolean"
ROWS = [
    ("a/../b", 1, 1, 0.1, "x,\"y\"\nz", True), ("a/../b", 1, 0, 1e-17 + 0.1, None, None), ("é~=%", 2, 3, None, "", False), (None, 3, 4, float("inf"), "ſ", True), ("", 3, None, 2.0, "w", None),
]


@pytest.fixture(params=[S.TrackCsv, S.TrackCache], ids=["csv", "npz"])
def kind(request, spark):
    spark.dataSource.register(request.param)
    return request.param


def write(df, kind, path, mode="append", keys="track,part"):
    df.write.format(kind.name()).option("path", str(path)).option("keys", keys).mode(mode).save()


def read(spark, kind, path, schema=SCHEMA, keys="track,part"):
    return spark.read.format(kind.name()).option("path", str(path)).option("keys", keys).schema(schema).load()


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_round_trip_of_odd_keys_and_values(spark, kind, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "track", "part")
    write(df, kind, tmp_path / "out")
    # an empty text and a null are one in CSV
    want = [tuple(None if kind is S.TrackCsv and v == "" and k == 4 else v for k, v in enumerate(r)) for r in ROWS]
    assert key(read(spark, kind, tmp_path / "out").collect()) == key(want)
    names = os.listdir(tmp_path / "out")
    assert len(names) == 4 and all(n.endswith(kind.SUFFIX) for n in names)  # no staging folder is left, and no key has left the folder
    some = read(spark, kind, tmp_path / "out", "track string, part int, t double")
    assert some.filter("part = 2").collect()[0].t is None


def test_files_are_ordered_and_marked(spark, tmp_path):
    spark.dataSource.register(S.TrackCsv)
    write(spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1), S.TrackCsv, tmp_path / "out")
    (name,) = os.listdir(tmp_path / "out")
    data = (tmp_path / "out" / name).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfi,t,label,ok\n0,0.1") and S.keys_of(name, ".csv") == ["a/../b", "1"]


def test_overwrite_takes_old_tracks_away_and_append_keeps_them(spark, kind, tmp_path):
    df = spark.range(6).select(F.col("id").cast("string").alias("track"), F.lit(0).alias("part"), F.lit(1).alias("i"), F.rand(1).alias("t"), F.lit("l").alias("label"), F.lit(True).alias("ok"))
    write(df, kind, tmp_path / "out")
    write(df.filter("track > 3").withColumn("i", F.lit(2)), kind, tmp_path / "out")
    assert sorted((r.track, r.i) for r in read(spark, kind, tmp_path / "out").collect()) == [("0", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 2), ("5", 2)]
    write(df.filter("track > 4"), kind, tmp_path / "out", "overwrite")
    assert [r.track for r in read(spark, kind, tmp_path / "out").collect()] == ["5"]


def test_empty_tables(spark, kind, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    write(empty, kind, tmp_path / "out")
    assert os.listdir(tmp_path / "out") == [] and read(spark, kind, tmp_path / "out").collect() == []


def test_a_lost_task_leaves_what_was_there(spark, kind, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2, "track", "part")
    write(df, kind, tmp_path / "out")
    broken = df.withColumn("i", F.when(F.col("part") == 2, F.raise_error(F.lit("lost"))).otherwise(9).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write(broken, kind, tmp_path / "out")
    assert len(read(spark, kind, tmp_path / "out").filter("i = 9").collect()) == 0
    assert all(n.endswith(kind.SUFFIX) for n in os.listdir(tmp_path / "out"))


def test_a_second_attempt_does_not_show_twice(tmp_path):
    import pyarrow as pa

    writer = S.TrackWriter(str(tmp_path), ["track"], ".csv", S.as_csv, False)
    batch = pa.RecordBatch.from_pydict({"track": ["a", "b", "a"], "i": [2, 1, 1]})
    writer.write(iter([batch]))  # its executor is lost before the commit
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(os.listdir(tmp_path)) == [S.file_name(["a"], ".csv"), S.file_name(["b"], ".csv")]


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = S.TrackWriter(str(tmp_path), ["track"], ".csv", S.as_csv, False)
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([pa.RecordBatch.from_pydict({"track": ["a"], "i": [1]})]))
    assert os.listdir(tmp_path) == []


def test_a_track_in_several_tasks_stops_the_job(spark, kind, tmp_path):
    df = spark.createDataFrame([("a", 0, i, 0.0, "", True) for i in range(8)], SCHEMA).repartition(4)
    with pytest.raises(Exception, match="several tasks"):
        write(df, kind, tmp_path / "out")
    assert not os.path.isdir(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="not among"):
        write(df, kind, tmp_path / "out", keys="nokey")


def test_names_give_their_keys_back():
    for keys in (["a~b", None], ["", "="], ["%7E", "~"], ["..", "/"]):
        name = S.file_name(keys, ".npz")
        assert S.keys_of(name, ".npz") == keys and "/" not in name and not name.startswith(".")
    assert np.isfinite(len(name))
