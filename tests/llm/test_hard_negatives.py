import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, positives, negatives, low, high, scale):
    part = [(i, label, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, q in part:
        if not anchor(a):
            continue
        others = [(-sum(x * y for x, y in zip(q, v)), i, k) for i, k, v in part if i != a]
        for s, p, _ in sorted(o for o in others if o[2] == label)[:positives]:
            fits = sorted((t, n) for t, n, k in others if k != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, every=10, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.hard_negatives(frame, F.col("vec_id") % every == 0, **options).collect()))


def table(n, dim, seed=0, clustered=False):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((8, dim))
    return [(i, ((middles[draw.integers(8)] if clustered else 0) + draw.standard_normal(dim) * 0.3).astype(np.float32).tolist(), int(draw.integers(4))) for i in range(n)]


@pytest.mark.parametrize("clustered, block, chunk", [(False, 32, 8192), (True, 16, 3), (True, 4096, 8192)])
def test_equal_to_comparing_all(spark, clustered, block, chunk):
    rows = table(300, 5, seed=block, clustered=clustered)
    found = run(spark, rows, positives=3, negatives=4, low=30, high=90, scale=256, pivots=6, block=block, chunk=chunk)
    assert found == brute(rows, lambda i: i % 10 == 0, 3, 4, 30, 90, 256) and found


def test_clustered_rows_certify_before_all_blocks_are_read(spark):
    rows = [(i, [float(i // 100), float(i % 100) / 50, 1.0], 0) for i in range(400)]
    index = H.KeyIndex(H.integer_rows(spark.createDataFrame(rows, SCHEMA), 256), pivots=4, block=20)
    asked = index.rows.filter("vec_id = 310").selectExpr("cast(0 as bigint) as request", "vec_id", "label", "v", "array(named_struct('w', 0, 'low', double('-Infinity'), 'high', double('Infinity'))) as windows")
    seen = []
    plain = H._in_block

    def counted(k, same):
        seen.append(1)
        return plain(k, same)

    H._in_block = counted
    try:
        best = index.search(asked, 3, True).orderBy("rank").collect()
    finally:
        H._in_block = plain
    assert [r["vec_id"] for r in best] == [399, 398, 397]
    assert len(seen) < len(H.RADII)


def test_copies_of_one_vector_ties_and_repeated_ids(spark):
    copies = [(i, [0.5, 0.5, 0.1], i % 2) for i in range(60)]
    rows = copies + [(20, [0.5, 0.5, 0.1], 0), (20, [0.1, 0.2, 0.3], 1), (71, [0.2, 0.2, 0.3], 1), (71, [0.2, 0.2, 0.3], 1)]
    found = run(spark, rows, positives=5, negatives=3, low=30, high=90, scale=256, pivots=3, block=8)
    assert found == brute(rows, lambda i: i % 10 == 0, 5, 3, 30, 90, 256) and found


def test_rows_that_take_no_part_and_odd_lengths(spark):
    rows = table(60, 4) + [(None, [1.0] * 4, 1), (100, None, 1), (110, [1.0, None, 1.0, 1.0], 1), (120, [float("nan")] * 4, 1), (130, [float("inf")] * 4, 1), (140, [1.0] * 4, None), (150, [], 1), (160, [0.4, 0.9], 2)]
    found = run(spark, rows, positives=2, negatives=2, low=30, high=90, scale=256, pivots=4, block=16)
    assert found == brute(rows, lambda i: i % 10 == 0, 2, 2, 30, 90, 256)
    assert not {100, 110, 120, 130, 140} & {x for r in found for x in (r[0], r[1], r[3])}


def test_negative_and_zero_positives_have_no_or_only_zero_negatives(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 1), (4, [-0.5, 0.0], 1), (5, [3.0, 3.0], 1)]
    found = run(spark, rows, positives=5, negatives=5, low=30, high=90, scale=256, pivots=2)
    assert found == [(0, 2, 1, 3, 0, 0)] == brute(rows, lambda i: i % 10 == 0, 5, 5, 30, 90, 256)


def test_empty_tables_and_clashing_columns(spark):
    options = {"positives": 2, "negatives": 2, "low": 30, "high": 90, "scale": 256}
    assert run(spark, [], **options) == []
    rows = table(40, 3)
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as block", "3 as key", "4 as request", "5 as pivot")
    assert sorted(map(tuple, H.hard_negatives(more, F.col("vec_id") % 10 == 0, **options).collect())) == run(spark, rows, **options)
