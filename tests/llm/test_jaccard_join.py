import random

import pytest

import tarnwick.llm.jaccard_join as J
from tarnwick.llm.components import components
from tests.llm.common import documents, edge_texts, words


def grams(text, n):
    row = (text or "").encode().lower().split()
    return {tuple(row[k : k + n]) for k in range(len(row) - n + 1)} if len(row) >= n else {tuple(row)} if row else set()


def brute(rows, n=5, percent=80):
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((doc, len(sets[k]), None if doc is None else least[find(k)]) for k, (doc, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    out = J.jaccard_components(documents(spark, rows), **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def corpus(seed):
    """Texts, copies with some words changed, chains of near copies and texts that share passages."""
    rng = random.Random(seed)
    rows, passage = edge_texts(seed), words(rng, 60)
    for _ in range(8):
        base = words(rng, rng.choice([8, 40, 90, 200])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40) + 1)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
        rows.append(words(rng, 20) + " " + passage + " " + words(rng, 15))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_blocks_of_a_large_cluster_and_small_batches(spark, monkeypatch):
    rng = random.Random(9)
    base, rows = words(rng, 150).split(), []
    for k in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    want = brute(rows)
    monkeypatch.setattr(J, "CLUSTER_SETS", 20)
    monkeypatch.setattr(J, "BLOCK_SETS", 12)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "HUB_ROWS", 0)
    assert found(spark, rows) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_large_clusters_dealt_by_prefix_grams(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows, passages = [], [words(rng, 40) for _ in range(3)]
    for k in range(10):
        base = (words(rng, 30) + " " + rng.choice(passages)).split()
        for _ in range(rng.randrange(3, 10)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    rng.shuffle(rows)
    rows = list(enumerate(rows, 10))
    want = brute(rows)
    for name, value in {"CLUSTER_SETS": 4 + seed, "BLOCK_SETS": 3, "HUB_ROUNDS": 1, "HUB_BYTES": 0}.items():
        monkeypatch.setattr(J, name, value)
    assert found(spark, rows) == want


def test_nulls_repeats_and_empty_tables(spark):
    text = words(random.Random(1), 30)
    rows = [(None, text), (5, text), (5, text), (3, text), (7, None), (8, "")]
    assert found(spark, rows) == brute(rows)
    assert J.jaccard_components(documents(spark, rows).limit(0)).count() == 0
    assert found(spark, [(1, "a b"), (2, "A  b"), (3, "b a")], percent=100) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]


def test_connected_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(400, 400), (None, 3)]
    up = {}
    find = lambda k: k if up.setdefault(k, k) == k else find(up[k])
    for a, b in links:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in up}
