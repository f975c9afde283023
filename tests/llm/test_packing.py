import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnwick.llm.packing import Packer, WordIds, cut, pack
from tests.llm.common import documents, edge_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity):
    """Pieces are exactly the texts' ids; sequences have no gap and no more than capacity tokens. Gives the number of sequences."""
    library, by, total = Tokenizer.from_file(PATH), {}, 0
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at, own = 0, sorted(by.pop(k), key=lambda r: r.piece)
        for p, r in enumerate(own):
            assert (r.piece, r.start) == (p, at) and 0 < r.length <= capacity and (p == 0 or r.length == capacity)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    assert not by
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places), -(-total // capacity)


def first_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(capacity - n)
        else:
            room[k] -= n
    return len(room)


def test_cut():
    assert cut(1024, 1024) == [(0, 1024)] and cut(1025, 1024) == [(0, 1), (1, 1024)] and cut(1, 1024) == [(0, 1)]


def test_genetic_operators_keep_groupings_valid():
    rng = np.random.default_rng(3)
    packer = Packer(rng.integers(1, 64, 500), 64)
    a, b = packer.fresh(rng, 0), packer.fresh(rng, 0.3)
    for child in (packer.crossover(a, b, rng), packer.mutate(a, rng)):
        assert len(child) == 500 and packer.fills(child).max() <= 64 and packer.fills(child).min() > 0
    best = packer.evolve([], np.random.default_rng(1), 4, 20, [0, 0.1, 0.2, 0.3])[0]
    assert packer.least <= best.max() + 1 <= a.max() + 1


def islands(packer, rounds=3, n=3):
    """As pack() does: islands that start apart, whose best moves on after each round."""
    groups, rng = [[] for _ in range(n)], np.random.default_rng(5)
    for _ in range(rounds):
        groups = [packer.evolve(g, rng, 4, 30, [0.02 * (4 * k + j) for j in range(4)]) for k, g in enumerate(groups)]
        groups = [g + [groups[k - 1][0]] for k, g in enumerate(groups)]
    return min(int(g[0].max()) + 1 for g in groups)


def test_search_wins_bins_that_best_fit_loses():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a = rng.integers(380, 490, 20)
        b = np.array([rng.integers(250, (1000 - x) // 2 + 1) for x in a])
        packer = Packer(np.r_[a, b, 1000 - a - b], 1000)  # twenty bins of three would be full
        assert islands(packer) <= packer.fresh(rng, 0).max() + 1 - 2


def fewest(items, capacity):
    """The least number of bins, by trying every grouping."""
    least = len(items)

    def go(k, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if k == len(items):
            least = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity:
                go(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return least


def test_small_problems_are_solved_best():
    found = []
    for seed in range(40):
        items = np.sort(np.random.default_rng(seed).integers(10, 60, 9))[::-1]
        found.append((islands(Packer(items, 100)), fewest(items.tolist(), 100)))
    assert all(f >= best for f, best in found) and sum(f == best for f, best in found) >= 39


def test_table(spark):
    texts = edge_texts() * 6
    rows = pack(documents(spark, texts), PATH, capacity=256, shard_pieces=30, islands=2, rounds=2).collect()
    sequences, bound = check(rows, texts, 256)
    assert sequences <= bound + 8
    one = pack(documents(spark, texts), PATH, capacity=256).collect()
    assert check(one, texts, 256)[0] <= first_fit_decreasing([r.length for r in one], 256)
    again = pack(documents(spark, texts), PATH, capacity=256).collect()
    assert {(r.doc_id, r.piece, r.offset) for r in one} == {(r.doc_id, r.piece, r.offset) for r in again}
    assert pack(documents(spark, texts).limit(0), PATH).count() == 0


def test_long_pieces_are_not_kept():
    library, words = Tokenizer.from_file(PATH), WordIds(PATH)
    for text in ("ab" * 400 + " and " + "#" * 300, "x" * 257 + " " + "x" * 256, "ab" * 400):
        assert words.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, words.known)) <= 256


def test_repeated_and_null_ids(spark):
    rows = pack(documents(spark, [(None, "a b"), (None, "a b"), (4, "c"), (4, None)]), PATH, capacity=16).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
