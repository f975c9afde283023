"""Manifests, media folders, prompts, sinks and the incremental run."""

import json

import pytest

from tarnwick.functions import text as X
from tarnwick.operators import decisions as D
from tarnwick.operators import kernels as K
from tarnwick.operators import series as S
from tarnwick.sources import files
from tarnwick.streaming import incremental


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"items": r}, lambda r: {"samples": r}])
def test_manifest_forms(spark, tmp_path, wrap):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(wrap([{"task": "P1", "video": "a/P1_seed42.mp4", "seed": 42}, {"task": "P2", "video": "b.mp4", "model": "m2", "backend_args": ["x"]}])))
    rows = {r.task: r for r in files.read_manifest(spark, str(path), "m1").collect()}
    assert rows["P1"].model == "m1" and rows["P1"].sample_id == "P1_seed42" and rows["P1"].seed == 42 and rows["P2"].model == "m2"


def test_manifest_without_a_video_is_an_error(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('[{"task": "P1"}]')
    with pytest.raises(Exception, match="manifest row"):
        files.read_manifest(spark, str(path), "m").collect()


def test_media_folder(spark, tmp_path):
    for name in ("alpha/P7_seed43.mp4", "alpha/deep/P12/clip.webm", "beta/none.mov", "beta/P1_P2.mkv", "beta/P3.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = {r.file: r for r in files.scan_media(spark, str(tmp_path)).collect()}
    assert set(rows) == {"P7_seed43.mp4", "clip.webm", "none.mov", "P1_P2.mkv"}
    assert (rows["P7_seed43.mp4"].task, rows["P7_seed43.mp4"].seed, rows["P7_seed43.mp4"].model) == ("P7", 43, "alpha")
    assert rows["clip.webm"].task == "P12" and rows["none.mov"].task is None and rows["P1_P2.mkv"].task_candidates == 2


def test_prompts_and_names(spark):
    docs = ['{"prompt": "a"}', '{"arguments": {"prompt": "b"}}', '{"sample": {"prompt": "c"}}', ' plain ', '"quoted"']
    got = [r.p for r in spark.createDataFrame([(d,) for d in docs], "d string").select(X.prompt_of(X.F.col("d")).alias("p")).collect()]
    assert got == ["a", "b", "c", "plain", "quoted"]
    row = spark.createDataFrame([("x/P10b_seed7.tar.gz",)], "n string").select(X.stem(X.F.col("n")).alias("s"), X.suffix(X.F.col("n")).alias("x"), X.task_ids(X.F.col("n")).alias("t")).first()
    assert (row.s, row.x, row.t) == ("P10b_seed7.tar", ".gz", [])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("P1", 1.5), ("P2", float("nan")), ("P2", float("inf"))], "task string, v double")
    files.write_json(df, str(tmp_path / "j"))
    assert [r.v for r in spark.read.schema("task string, v double").json(str(tmp_path / "j")).orderBy("v").collect()] == [None, None, 1.5]
    assert files.write_csv(df, str(tmp_path / "c")) and not files.write_csv(df.limit(0), str(tmp_path / "d")) and not (tmp_path / "d").exists()
    files.write_series(df, str(tmp_path / "s"), ["task"])
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"task=P1", "task=P2"}


def test_artifacts_by_kind_and_age(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.PNG", "a/y.csv", "z.mp4", "notes.txt"):
        (tmp_path / name).write_text("1")
    rows = files.list_artifacts(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.kind, r.length) for r in rows) == [("x.PNG", "image", 1), ("y.csv", "measurement_data", 1), ("z.mp4", "video", 1)]
    assert files.list_artifacts(spark, str(tmp_path), since=4e9).count() == 0


def test_incremental_runs_score_each_record_once(spark, tmp_path):
    schema = "model string, task string, sample long, c double, physics double, status string, threshold double, forced boolean, signature string"
    row = {"model": "m", "task": "P1", "c": 0.9, "physics": 0.5, "status": "complete", "threshold": 0.8, "forced": False}
    (tmp_path / "in").mkdir()
    run = lambda: incremental.run(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state"), schema, ["model", "task", "sample"]).awaitTermination()
    lines = [json.dumps(row | {"sample": k, "signature": "a"}) for k in (1, 2)]
    (tmp_path / "in/1.json").write_text("\n".join(lines))
    run()
    (tmp_path / "in/2.json").write_text("\n".join([lines[0], json.dumps(row | {"sample": 1, "signature": "b"}), json.dumps(row | {"sample": 3, "signature": "a"})]))
    run()
    got = spark.read.parquet(str(tmp_path / "store")).collect()
    assert sorted((r.sample, r.signature) for r in got) == [(1, "a"), (1, "b"), (2, "a"), (3, "a")] and got[0].total == pytest.approx(0.56)


def test_release_return_and_short_tracks(spark):
    import math

    rows = [("s", k, k / 24, math.cos(2 * math.pi * (k / 24) / 1.5), True) for k in range(37)]
    df = spark.createDataFrame(rows, "track string, i int, t double, y double, valid boolean")
    assert D.release_return(df).first().period == pytest.approx(1.5)
    one = spark.createDataFrame([("s", 0, 0.0, 1.0, True), ("n", 0, 0.0, None, False)], df.schema)
    for op in (S.velocity, S.moving_average_same, S.moving_average_padded, S.rolling_median_rows, S.forward_fill, S.unwrapped, S.frame_durations):
        assert op(one).count() == 2
    assert S.fill_gaps(one, 2).filter("filled is not null").count() == 1 and S.crossings(one).count() == 0 and S.longest_run(one, S.observed(one)).count() == 1


def test_json_and_events():
    import numpy as np

    assert K.repeated_keys('{"a": 1, "b": {"c": 1, "c": 2}, "a": 3}') == ["c", "a"]
    assert K.scalar_tokens('{"a": [1, 2.5e3, true, "x\\"y"]}') == K.scalar_tokens('"a" 1 2.5e3 true "x\\"y",')
    area = np.r_[np.full(5, 1000.0), np.linspace(1000, 400, 30), np.full(10, 400.0)]
    frame, depth = K.shrink_event(area, np.ones(45, bool), 1000)
    assert 20 < frame < 32 and depth == pytest.approx(0.6, abs=0.01) and K.shrink_event(np.full(45, 1000.0), np.ones(45, bool), 1000) == (None, 0.0)
    t = np.arange(50) / 10
    assert K.rise_half_time(t, np.clip(t, 1, 3), 0.1) == pytest.approx(2) and K.rise_half_time(t, 0 * t, 0.1) is None
    assert K.discharge_onset(t, np.where(t < 2, 10, 10 - t), 0.5) == 20
    x = np.where(t < 2, -3 * (t - 2) ** 2 / 2, -1.5 * (t - 2) ** 2 / 2)
    turn, before, after = K.shared_vertex(t, x)
    assert turn == pytest.approx(2, abs=0.05) and before / after == pytest.approx(2, abs=0.1)
