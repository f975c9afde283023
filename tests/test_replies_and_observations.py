import json

from pyspark.sql import functions as F

from tarnwick.operators import replies as P
from tarnwick.sources import observations as O


def reply(**changes):
    proof = [{"start_seconds": 0.0, "end_seconds": 1.0, "description": "d"}]
    made = {
        "reason": "r", "assessment": {n: {"severity": 1, "evidence": proof} for n in P.VISUAL}, "task_assessment": {n: {"severity": 0, "evidence": []} for n in P.TASK},
        "quality_checks": {"multiple_balls": False, "strong_background_flicker": False, "poor_visual_quality": True},
    }
    made["assessment"] |= changes.pop("assessment", {})
    return json.dumps(made | changes)


def test_rules_are_broken_one_by_one(spark):
    cases = [
        (reply(), []), ("```json\n" + reply() + "\n```", []), ("nonsense", ["not_a_reply"]), (None, ["not_a_reply"]), ("{}", ["not_a_reply"]),
        (reply(assessment={"extra": {"severity": 0, "evidence": []}}), ["visual_keys"]), (reply(task_assessment={}), ["task_keys"]),
        (reply(assessment={"scene": {"severity": 5, "evidence": [{"start_seconds": 0, "end_seconds": 1, "description": ""}]}}), ["severity_range"]),
        (reply(assessment={"scene": {"severity": 2, "evidence": []}}), ["evidence_missing"]),
        (reply(assessment={"scene": {"severity": 2, "evidence": [{"start_seconds": 2.0, "end_seconds": 1.0, "description": ""}]}}), ["evidence_order"]),
        (reply(assessment={"scene": {"severity": 2, "evidence": [{"start_seconds": 2.0, "end_seconds": 5.1, "description": ""}]}}), ["evidence_outside"]),
    ]
    rows = P.checked(spark.createDataFrame([(k, r, 5.0) for k, (r, _) in enumerate(cases)], "k int, r string, s double"), "r", "s").orderBy("k").collect()
    assert [r.broken for r in rows] == [b for _, b in cases] and rows[0].judgment.quality_checks.poor_visual_quality


def test_media_are_read_by_an_extractor(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"clip{n}.mp4").write_bytes(bytes([n] * (n + 1)))

    def extract(path, content):
        for k, v in enumerate(content):
            yield path.rsplit("/", 1)[1], "ball", k, k / 24, float(v), float("nan") if v == 2 else 1.0, 1.0, True

    rows = O.from_media(spark, str(tmp_path), extract, 2)
    rows.write.parquet(str(tmp_path / "obs"))
    got = O.read(spark, str(tmp_path / "obs"))
    assert got.count() == 6 and {(r.sample, r.valid) for r in got.select("sample", "valid").distinct().collect()} == {("clip0.mp4", True), ("clip1.mp4", True), ("clip2.mp4", False)}
    assert got.filter("y is null").count() == 3


def test_boxes(spark):
    boxes = [[0.1, 0.1, 0.5, 0.5], [0.9, 0.1, 0.5, 0.5], [0.1, 0.1, 0.0, 0.5], [0.1, 0.1, 0.5], None]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(boxes)], "k int, b array<double>").orderBy("k")
    assert [r.ok for r in df.select(O.inside_frame(F.col("b")).alias("ok")).collect()] == [True, False, False, False, False]
    held = df.select(O.boxes_or_default(F.create_map(F.lit("a"), F.col("b")), ["a"], {"a": [0.0, 0.0, 1.0, 1.0]}).alias("m")).collect()
    assert [r.m["a"] == b for r, b in zip(held, boxes)] == [True, False, False, False, False] and held[4].m["a"] == [0, 0, 1, 1]
