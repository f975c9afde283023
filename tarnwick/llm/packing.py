"""Packing of tokenised texts into sequences of one length, by a grouping genetic algorithm.

Texts are cut into pieces of at most `capacity` tokens. Pieces of exactly that length are
sequences of their own. The rest is dealt by hash into shards of a bounded number of pieces, as
many as the table needs, and every shard is one packing problem, solved by several islands.
An individual is a grouping of the shard's pieces into bins. A child takes well-filled bins of
one parent whole, loses the other parent's bins that hold any of their pieces, and puts the
displaced pieces where they fit best: first in exchange for one or two shorter pieces of a bin that
is not full, then, large ones first, into the fullest bin with room. Falkenauer's fitness, the mean
square of the fill, prefers few and full bins. Islands start apart, from best fits of different noise;
the first individual of the first is best fit in decreasing order, so no result is worse than that. After
each round every island's best individual moves to the next island of its shard: the shuffle between
rounds is the migration. Islands whose grouping has reached the lower bound, all tokens over
capacity, rest.

Each shard may leave one sequence ill filled, so sequences exceed what one shard would need by at most
one in `shard_pieces / 2` or so. Random choices are seeded by shard, island and round, and pieces
stand in a fixed order: tasks that run again give the same rows.

Defined results: null and empty texts are one piece of the end id alone; texts are cut whole,
whatever their length; repeated rows and null ids are packed like others; an empty table gives an
empty result; further columns are not carried.
"""

from __future__ import annotations

import math
import os
import zlib
from itertools import chain
from struct import pack as pack_ids

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import arrow_rows, holds, stash
from tarnwick.llm.token_counts import KEPT_CHARS, Splitter

#: Pieces of a shard on average.
SHARD_PIECES = 32_768
#: Words of one generation of a worker's ids, some 200 bytes each; two generations are kept.
KEPT_WORDS = 500_000
#: Tasks of one round at most; each then takes several islands.
MOST_TASKS = 10_000
#: Items of a bin up to which pairs of them are tried in an exchange.
PAIRED = 12
#: The share of bins that a mutation dissolves beside the emptiest.
LOOSE_SHARE = 0.02


class WordIds(Splitter):
    """Ids of a text by the library's tokenizer, as bytes of little-endian unsigned ints.

    The library's pieces never merge with each other, so the ids of a piece are kept and the
    library is asked only for pieces it has not been asked for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = KEPT_WORDS

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(ids)}I", *ids)
        words, known = self.pieces(text), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        new = list(set(words).difference(known))
        if len(known) + len(new) > self.most:
            known, self.older = {}, known
            self.known, new = known, list(set(words))
        old = self.older
        for word in new:
            if word in old:
                known[word] = old[word]
        new = [w for w in new if w not in known]
        long: dict[str, bytes] = {}
        for word, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            ids = e.ids
            (known if len(word) <= KEPT_CHARS else long)[word] = pack_ids(f"<{len(ids)}I", *ids)
        if long:
            return b"".join(known[w] if len(w) <= KEPT_CHARS else long[w] for w in words)
        return b"".join(map(known.__getitem__, words))


_words: dict[str, WordIds] = {}
holds("ids", _words.clear)


def word_ids(path: str, most: int) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    _words[path].most = most
    return _words[path]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text: all of capacity but the first."""
    n = -(-total // capacity)
    first = total - capacity * (n - 1)
    return [(0, first)] + [(first + capacity * k, capacity) for k in range(n - 1)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer, kept_words)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.encode(text.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for name, v in zip(out, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))):
                        out[name].append(v)
            yield out

    return arrow_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, piece int, start long, length long, ids_crc32 long", keep="ids")


def best_fit(order: list[int], lengths: list[int], bins: list[int], free: list[int], capacity: int, place: np.ndarray) -> None:
    """Puts each item in the fullest bin that has room, or a new one. bins, free: numbers and room of open bins."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, r in zip(bins, free):
        by_room[r].append(b)
        open_ |= 1 << r
    new = max(bins, default=-1) + 1
    for k in order:
        n = lengths[k]
        above = open_ >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            at = by_room[room]
            b = at.pop()
            if not at:
                open_ ^= 1 << room
        else:
            room, b = capacity, new
            new += 1
        place[k] = b
        by_room[room - n].append(b)
        open_ |= 1 << (room - n)


class Loose:
    """Items without a bin, by length, with the sums of pairs of them."""

    def __init__(self, items: list[int], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.by_length: dict[int, list[int]] = {}
        self.bits = self.sums = 0  # bit n: an item, or a pair, of length n; pairs that are gone may still be in sums
        for k in items:
            self.add(k)

    def add(self, k: int) -> None:
        n = self.lengths[k]
        same = self.by_length.setdefault(n, [])
        same.append(k)
        if len(same) == 1:
            self.bits |= 1 << n
        if len(same) <= 2:
            self.sums |= (self.bits if len(same) == 2 else self.bits ^ (1 << n)) << n

    def take(self, n: int) -> int:
        same = self.by_length[n]
        k = same.pop()
        if not same:
            del self.by_length[n]
            self.bits ^= 1 << n
        return k

    def longest(self, most: int) -> int:
        """The longest item of at most a length, 0 without."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if self.bits else 0

    def pair(self, n: int) -> tuple[int, int] | None:
        """Two items that are n together."""
        for x, same in self.by_length.items():
            if n - x in self.by_length and (n != 2 * x or len(same) > 1):
                return x, n - x
        self.sums &= ~(1 << n)
        return None


def exchange(bins: list[list[int]], room: list[int], out: list[int], lengths: list[int], capacity: int) -> list[int]:
    """Fills bins by exchanging one or two of their items for one or two longer ones of `out`; gives back what is out then, large ones first.

    Every exchange makes a bin fuller and what is out shorter. Bins and rooms are changed in place; the roomiest bins come first.
    """
    loose = Loose(out, lengths, capacity)
    for b in sorted((b for b, r in enumerate(room) if r), key=lambda b: (-room[b], b)):
        held = bins[b]
        while (r := room[b]) and loose.bits:
            best = (0, (), ())
            parts = [(lengths[k], (i,)) for i, k in enumerate(held)]
            if len(held) <= PAIRED:
                parts += [(lengths[held[i]] + lengths[held[j]], (i, j)) for i in range(len(held)) for j in range(i)]
            for n, places in [(0, ()), *parts]:
                if (x := loose.longest(n + r)) - n > best[0]:
                    best = (x - n, places, (x,))
                while best[0] < r and (s := (loose.sums & ((2 << (n + r)) - 1)).bit_length() - 1) - n > best[0]:
                    if two := loose.pair(s):
                        best = (s - n, places, two)
                if best[0] == r:
                    break
            gain, places, new = best
            if not gain:
                break
            taken = [loose.take(n) for n in new]
            for i in places:  # later places first
                loose.add(held.pop(i))
            held += taken
            room[b] = r - gain
    return [k for n in sorted(loose.by_length, reverse=True) for k in loose.by_length[n]]


class Packer:
    """The genetic operators for the pieces of one shard."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.list = self.lengths.tolist()
        self.least = -(-int(self.lengths.sum()) // capacity)

    def fills(self, place: np.ndarray) -> np.ndarray:
        return np.bincount(place, self.lengths).astype(np.int64)

    def fitness(self, place: np.ndarray) -> float:
        return float(np.mean((self.fills(place) / self.capacity) ** 2))

    def fresh(self, rng: np.random.Generator, noise: float) -> np.ndarray:
        """Best fit in decreasing order, disturbed by noise."""
        keys = self.lengths * (1 + noise * rng.standard_normal(len(self.lengths))) if noise else self.lengths
        place = np.empty(len(self.lengths), np.int64)
        best_fit(np.argsort(-keys, kind="stable").tolist(), self.list, [], [], self.capacity, place)
        return place

    def refit(self, place: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The grouping with the items of `out` taken from their bins, exchanged for ones that fill bins better, and best-fitted, large ones first."""
        stay = np.flatnonzero(~out)
        kept, number = np.unique(place[stay], return_inverse=True)
        room = (self.capacity - np.bincount(number, self.lengths[stay], len(kept)).astype(np.int64)).tolist()
        order = np.argsort(number, kind="stable")
        ends = np.cumsum(np.bincount(number, minlength=len(kept))).tolist()
        items = stay[order].tolist()
        bins = [items[a:b] for a, b in zip([0, *ends], ends)]
        left = exchange(bins, room, np.flatnonzero(out).tolist(), self.list, self.capacity)
        child = np.empty_like(place)
        child[list(chain.from_iterable(bins))] = np.repeat(np.arange(len(bins)), list(map(len, bins)))
        best_fit(left, self.list, range(len(bins)), room, self.capacity, child)
        return child

    def crossover(self, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Well-filled bins of b whole, the bins of a that they don't touch, and the displaced items best-fitted."""
        fills = self.fills(b)
        good = fills >= np.quantile(fills, 0.5)
        injected = (good & (rng.random(len(fills)) < 0.3))[b]
        touched = np.zeros(int(a.max()) + 1, bool)
        touched[a[injected]] = True
        mixed = np.where(injected, b + len(touched), a)
        return self.refit(mixed, touched[a] & ~injected)

    def mutate(self, place: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The emptiest bin, of equals any, and a few others are dissolved."""
        fills = self.fills(place)
        gone = rng.random(len(fills)) < LOOSE_SHARE
        gone[np.argmin(fills + rng.random(len(fills)))] = True
        return self.refit(place, gone[place])

    def evolve(self, group: list[np.ndarray], rng: np.random.Generator, size: int, generations: int, noises: list[float]) -> list[np.ndarray]:
        """The best `size` individuals after some generations, best first; a group without members begins with best fits of the given noises."""
        group = group or [self.fresh(rng, noise) for noise in noises]
        scored = sorted(((int(p.max()) + 1, -self.fitness(p), k, p) for k, p in enumerate(group)), key=lambda x: x[:3])
        for g in range(generations):
            if scored[0][0] <= self.least:
                break
            i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
            child = self.mutate(self.crossover(scored[min(i, j)][3], scored[max(i, j)][3], rng), rng)
            scored = sorted([*scored, (int(child.max()) + 1, -self.fitness(child), len(group) + g, child)], key=lambda x: x[:3])[:size]
        return [x[3] for x in scored[:size]]


STATE = "shard int, island int, lengths binary, place binary, bins int, fitness double"


def round_of(capacity: int, islands: int, turn: int, size: int, generations: int):
    """One round of an island: (shard, island), its state and immigrants -> its state, and its best for the next island."""

    def run(key, frame):
        import pandas as pd

        shard, island = int(key[0]), int(key[1])
        lengths = np.frombuffer(frame["lengths"].dropna().iloc[0], "<u4")
        packer, rng = Packer(lengths, capacity), np.random.default_rng([shard, island, turn])
        old = sorted(x for x in frame["place"] if x is not None)
        noises = [0.02 * (size * island + k) for k in range(size)]  # islands start apart; the first individual of the first is best fit in decreasing order
        group = packer.evolve([np.frombuffer(x, "<i4").astype(np.int64) for x in dict.fromkeys(old)], rng, size, generations, noises)
        rows = [(shard, island, lengths.tobytes(), None, None, None)]
        saved = [(p.astype("<i4").tobytes(), int(p.max()) + 1, packer.fitness(p)) for p in group]
        rows += [(shard, island, None, *x) for x in saved]
        rows.append((shard, (island + 1) % islands, None, *saved[0]))
        return pd.DataFrame(rows, columns=["shard", "island", "lengths", "place", "bins", "fitness"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_pieces: int = SHARD_PIECES,
    islands: int = 3,
    rounds: int = 3,
    population: int = 3,
    generations: int = 3,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    kept_words bounds the ids that a worker keeps; fewer cost time and no exactness.
    """
    cut_up = stash(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, kept_words).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = cut_up.filter(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = cut_up.filter(F.col("length") < capacity)
    shards = max(1, math.ceil(small.count() / shard_pieces))
    # some shard_pieces rows each, by hash of a row number that no two rows share
    dealt = small.groupBy(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("items"))
    dealt = stash(dealt.select("shard", F.transform("items", lambda x: x["row"]).alias("rows"), F.transform("items", lambda x: x["length"]).alias("sizes")), "pack-shards")

    def seats(batches):
        for b in batches:
            out = {k: [] for k in ("shard", "island", "lengths", "place", "bins", "fitness")}
            for shard, sizes in zip(b.column(0).to_pylist(), b.column(1)):
                for island in range(islands):
                    for name, v in zip(out, (shard, island, np.array(sizes.as_py(), "<u4").tobytes(), None, None, None)):
                        out[name].append(v)
            yield out

    state = arrow_rows(dealt.select("shard", "sizes"), seats, STATE)
    tasks = min(shards * islands, MOST_TASKS)  # said outright, as the rows are few and small but long in work
    for turn in range(rounds):
        state = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(round_of(capacity, islands, turn, population, generations), STATE)
    best = state.filter(F.col("place").isNotNull()).groupBy("shard").agg(F.max(F.struct(-F.col("bins"), "fitness", "place")).alias("best"))

    def seated(batches):
        for b in batches:
            out = {k: [] for k in ("row", "sequence_id", "offset")}
            for shard, rows, sizes, place in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()):
                at, n = np.frombuffer(place, "<i4").astype(np.int64), np.array(sizes.as_py(), np.int64)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(n[order])
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                base = np.repeat(np.append(0, ends)[first], np.diff(np.append(first, len(order))))
                offset = np.empty(len(n), np.int64)
                offset[order] = ends - n[order] - base
                out["row"] += rows.as_py()
                out["sequence_id"] += (at + (int(shard) << 32)).tolist()
                out["offset"] += offset.tolist()
            yield out

    solved = arrow_rows(dealt.join(best, "shard").select("shard", "rows", "sizes", "best.place"), seated, "row long, sequence_id long, offset long")
    return whole.select(names).unionByName(small.join(solved, "row").select(names))
