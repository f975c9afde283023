from hashlib import sha256

import numpy as np
import pytest

from tarnwick.llm.centroids import LIMIT, centroid_clusters, reassigned, squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, k, rounds, dim, scale):
    """Plain rounds over Python integers."""
    kept = [(i, [max(-LIMIT, min(LIMIT, int(np.floor(float(np.float32(x)) * scale)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for n in range(rounds + 1):
        owners = [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in kept] if centroids else []
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, o) in zip(kept, owners) if o == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = [sum(d for d, o in owners if o == j) for j in range(len(centroids))]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i if i is not None else -1, o, d, inertia[o], sum(inertia), digest[o]) for (i, _), (d, o) in zip(kept, owners))


def run(spark, rows, **options):
    found = centroid_clusters(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), **options).collect()
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, *r[1:]) for r in found)


def vectors(n, dim, seed=0, spread=0.2):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((5, dim))
    return [(i, (middles[i % 5] + spread * draw.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("k, rounds, spread", [(4, 3, 0.2), (7, 6, 1.5), (3, 0, 0.2)])
def test_rounds_equal_plain_lloyd(spark, k, rounds, spread):
    rows = vectors(160, 6, seed=k, spread=spread)
    assert run(spark, rows, k=k, rounds=rounds, dim=6, scale=64) == lloyd(rows, k, rounds, 6, 64)


def test_rows_that_take_no_part_ties_repeats_and_null_ids(spark):
    good = vectors(12, 3)
    odd = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, 2.0, 3.0, 4.0]), (54, [1.0, None, 2.0]), (55, [float("nan"), 0.0, 0.0]), (56, [float("inf"), 0.0, 0.0])]
    tied = [(60, [0.0, 0.0, 0.0]), (60, [0.0, 0.0, 0.0]), (61, [0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    rows = good + odd + tied
    found = run(spark, rows, k=5, rounds=3, dim=3, scale=64)
    assert found == lloyd(rows, 5, 3, 3, 64)
    assert len(found) == 16 and found[0][0] == -1


def test_all_copies_leave_centroids_empty(spark):
    rows = [(i, [0.25, -0.25]) for i in range(40)]
    found = run(spark, rows, k=4, rounds=3, dim=2, scale=64)
    assert found == lloyd(rows, 4, 3, 2, 64) and {r[1] for r in found} == {0}


def test_fewer_vectors_than_centroids_and_an_empty_table(spark):
    rows = vectors(3, 2)
    assert run(spark, rows, k=16, rounds=2, dim=2, scale=64) == lloyd(rows, 16, 2, 2, 64)
    assert run(spark, [], k=16, rounds=2, dim=2, scale=64) == []
    assert run(spark, [(None, [1.0, 1.0])], k=2, rounds=1, dim=2, scale=64) == []


def test_further_columns_with_clashing_names(spark):
    rows = vectors(30, 4)
    plain = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    more = plain.selectExpr("*", "1 as v", "2 as owner", "3 as was", "4 as distance", "5 as cluster")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(centroid_clusters(more, k=3, dim=4)) == key(centroid_clusters(plain, k=3, dim=4))


def test_large_components_are_exact_and_held_within_the_limit(spark):
    x = np.array([[2**26, -(2**26)], [2**26 - 3, 5]])
    assert squared_distances(x, x).tolist() == [[0, 9 + (2**26 + 5) ** 2], [9 + (2**26 + 5) ** 2, 0]]
    rows = [(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [1e6, 1e6])]
    assert run(spark, rows, k=2, rounds=2, dim=2, scale=64) == lloyd(rows, 2, 2, 2, 64)


def test_unmoved_owners_are_compared_with_moved_centroids_only():
    x = np.array([[0, 0], [10, 0], [20, 0]])
    owner, distance = np.array([0, 1, 1]), np.array([0, 77, 88])  # stored distances that a full comparison would correct
    moved = np.array([True, False])
    o, d = reassigned(x, owner, distance, np.array([[1, 0], [19, 0]]), moved)
    assert o.tolist() == [0, 1, 1] and d.tolist() == [1, 77, 88]
    o, d = reassigned(x, owner, distance, np.array([[12, 0], [19, 0]]), moved)
    assert o.tolist() == [0, 0, 0] and d.tolist() == [144, 4, 64]
