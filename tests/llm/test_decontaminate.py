import random

from tarnwick.llm.decontaminate import contaminated, decontaminated, tile
from tests.llm.common import documents, edge_texts, words


def brute_tiles(item, text, least):
    """Greedy string tiling by looking at all pairs of positions."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_i and j + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_i |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_cover_as_much_as_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randrange(4) + 1 for _ in range(rng.randrange(4, 14))]
        text = [rng.randrange(4) + 1 for _ in range(rng.randrange(0, 20))]
        got, want = tile(item, text, 2), brute_tiles(item, text, 2)
        assert sorted((n for _, _, n in got), reverse=True)[:1] == sorted((n for _, _, n in want), reverse=True)[:1]
        assert all(item[i : i + n] == text[j : j + n] for i, j, n in got)
        covered = [p for i, _, n in got for p in range(i, i + n)]
        assert len(covered) == len(set(covered))
        assert not [x for x in brute_tiles([v if k not in covered else -1 for k, v in enumerate(item)], [v if k not in {p for _, j, n in got for p in range(j, j + n)} else -2 for k, v in enumerate(text)], 2)]


def test_reordered_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    items = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(6)]
    parts = items[0].split()
    moved = " ".join(parts[20:] + ["and"] + parts[:20])
    half_lost = words(rng, 30) + " " + " ".join(parts[:12]) + " " + words(rng, 30)
    texts = [*edge_texts(), words(rng, 50) + "\n" + items[1].upper() + "!", words(rng, 40) + " " + moved, half_lost, items[2] + " " + items[3], words(rng, 20) + " The of, Zebra. " + words(rng, 9), "of zebra the", "a quagga"]
    docs, n = documents(spark, texts), len(edge_texts())
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (9, "the of zebra"), (5, items[5]), (10, "quagga"), (11, " ?!")], "item_id long, text string")
    want = sorted([(n, 1), (n + 1, 0), (n + 3, 2), (n + 3, 3), (n + 4, 9), (n + 6, 10)])
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, bench, block_tokens=50).collect()) == want
    kept = decontaminated(docs, bench, block_tokens=50)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
    assert decontaminated(docs, bench.limit(0)).count() == len(texts)


def test_seeds_joined_by_hash_give_the_same_tiles_as_a_held_benchmark(spark):
    rng = random.Random(11)
    items = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    mixed = lambda: " ".join(rng.choice([words(rng, 5), *rng.sample(items, 3), " ".join(rng.choice(items).split()[: rng.randrange(2, 20)])]) for _ in range(rng.randrange(1, 8)))
    texts = [mixed() for _ in range(40)] + edge_texts()
    docs = documents(spark, texts).repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (100, items[3]), (None, items[4])], "item_id long, text string")
    rows = lambda **k: sorted((r.doc_id, str(r.item_id), r.coverage, r.n_tiles, r.longest_tile, str(r.tiles)) for r in contaminated(docs, bench, threshold=0.3, **k).collect())
    held, joined = rows(), rows(block_tokens=0)
    assert held == joined and len(held) > 40
    kept = lambda **k: sorted(r.doc_id for r in decontaminated(docs, bench, threshold=0.3, **k).collect())
    assert kept() == kept(block_tokens=0) == sorted(set(range(len(texts))) - {d for d, *_ in held})
