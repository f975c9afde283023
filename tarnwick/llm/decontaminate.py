"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are rows of lower-cased word tokens. A seed is a window of `least`
tokens that a text shares with an item (an item of fewer tokens is one seed of its own length); texts
and items are joined on seeds, and each joined pair is tiled: Karp-Rabin hashes find the longest common runs of unmarked tokens, those are
marked, and shorter ones are searched until runs are shorter than `least`. Tiles don't overlap
and may stand in any order, so reordered passages count in full. A text is contaminated by an
item if tiles cover at least `threshold` of the item's tokens.

The benchmark's tokens are counted first. Up to `held_tokens` of them, items and seeds are a table that every task holds, and the texts are
scanned once, without a shuffle. Beyond that, seeds are a stored table: a scan of the texts sends on the windows whose hash a bitmap of fixed
size does not rule out, these are joined with the seeds by hash, and what a text shares with an item is tiled with the item fetched
by its number. The bitmap is all that reaches the driver. Both ways give the same rows; in both only windows that hold a seed are tiled.

Defined results: null and empty texts match nothing; items that are null or have no token are never
matched, items of fewer than `least` tokens where a text holds them whole; texts are searched whole; repeated rows of either table are
each reported; empty tables give an empty result; further columns are not carried.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import arrow_rows, joined_if_small, keep_rows, stash, unused

WORD = re.compile(r"\w+")
#: Tokens of a benchmark that a task holds: some 100 MB at most.
HELD_TOKENS = 500_000
#: Bits of the map of seeds' hashes: 8 MB at most on the driver and in a task.
MAP_BITS = 1 << 26
PRIME = (1 << 61) - 1
BASE = 1_000_003


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(row: list, size: int, open_: bytearray):
    """(start, Karp-Rabin hash) of each window of `size` tokens without a marked one."""
    if size > len(row):
        return
    top = pow(BASE, size - 1, PRIME)
    value, run = 0, 0
    for k, x in enumerate(row):
        if open_[k]:
            value, run = 0, 0
            continue
        if run == size:
            value = (value - row[k - size] * top) % PRIME
            run -= 1
        value = (value * BASE + x) % PRIME
        run += 1
        if run == size:
            yield k - size + 1, value


def longest_runs(item: list[int], text: list[int], size: int, item_marks: bytearray, text_marks: bytearray) -> list[tuple[int, int, int]]:
    """(length, item start, text start) of maximal unmarked common runs of at least `size` tokens."""
    at = defaultdict(list)
    for i, h in windows(item, size, item_marks):
        at[h].append(i)
    found = []
    for j, h in windows(text, size, text_marks):
        for i in at.get(h, ()):
            if i and j and item[i - 1] == text[j - 1] and not item_marks[i - 1] and not text_marks[j - 1]:
                continue  # part of a run that began before
            n = 0
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not item_marks[i + n] and not text_marks[j + n]:
                n += 1
            if n >= size:
                found.append((n, i, j))
    return found


def tile(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping (item start, text start, length), longest first."""
    item_marks, text_marks = bytearray(len(item)), bytearray(len(text))
    out, size = [], max(least, min(len(item), 32))
    while True:
        found = sorted(longest_runs(item, text, size, item_marks, text_marks), key=lambda x: (-x[0], x[1], x[2]))
        if found and found[0][0] > 2 * size:
            size = found[0][0]
            continue
        cut = False
        for n, i, j in found:
            if any(item_marks[i : i + n]) or any(text_marks[j : j + n]):
                cut = True  # what a longer tile leaves of it is found again
                continue
            item_marks[i : i + n] = text_marks[j : j + n] = b"\1" * n
            out.append((i, j, n))
        if cut:
            continue
        if size == least:
            return out
        size = max(least, size // 2)


def tiled(item: list[int], held, at: list[int], size: int) -> list[tuple[int, int, int]]:
    """Tiles of an item in a text, of which held[k] is token k, from the starts `at` of its seeds in order.

    Only tokens in windows with a seed can be in a tile; 0 stands between parts.
    """
    parts, origin, end = [], [], -1
    for j in at:
        if j > end:
            parts.append(0)
            origin.append(-1)
        for k in range(max(j, end), j + size):
            parts.append(held[k])
            origin.append(k)
        end = j + size
    return [(i, origin[j], length) for i, j, length in tile(item, parts, size)]


class Block:
    """Benchmark items with an index of their seeds, by the seeds' length."""

    def __init__(self, items: list[tuple[int | None, list[str]]], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        self.items = [(key, [self.number.setdefault(w, len(self.number) + 1) for w in words]) for key, words in items]
        by_size = defaultdict(lambda: defaultdict(set))
        for n, (_, row) in enumerate(self.items):
            size = min(least, len(row))
            for h in self.hashes(np.array(row, np.uint64), size).tolist():
                by_size[size][h].add(n)
        self.seeds = {size: (np.array(sorted(found), np.uint64), dict(found)) for size, found in by_size.items() if size}

    @staticmethod
    def hashes(row: np.ndarray, size: int) -> np.ndarray:
        """The hash of each window of `size` tokens."""
        out = np.zeros(max(0, len(row) - size + 1), np.uint64)
        for k in range(size):
            out += row[k : k + len(out)] * np.uint64(pow(BASE, size - 1 - k, 1 << 64))
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def search(self, text: str | None) -> list[tuple[int | None, int, int, list[tuple[int, int, int]], int]]:
        """(item key, covered, item tokens, tiles, text tokens) of each item that shares a seed."""
        words = tokens(text)
        if not words or not self.seeds:
            return []
        row = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))
        starts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for size, (seeds, items_of) in self.seeds.items():
            hashes = self.hashes(row, size)
            place = np.searchsorted(seeds, hashes)
            place[place == len(seeds)] = 0
            for j in np.flatnonzero(seeds[place] == hashes).tolist():
                for n in items_of[int(hashes[j])]:
                    starts[n, size].append(j)
        held, out = row.tolist() if starts else [], []
        for (n, size), at in starts.items():
            key, item = self.items[n]
            tiles = tiled(item, held, at, size)
            if tiles:
                out.append((key, sum(x[2] for x in tiles), len(item), tiles, len(words)))
        return out


def held_items(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> list[tuple[int | None, list[str]]] | None:
    """The benchmark's items if they have at most so many tokens in all, else None."""
    sizes = arrow_rows(benchmark.select(text_col), lambda batches: ({"n": [len(tokens(x.as_py())) for x in b.column(0)]} for b in batches), "n long")
    if (sizes.agg(F.sum("n")).first()[0] or 0) > most:
        return None
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()).collect()
    return [(key, words) for key, text in rows if (words := tokens(text))]


MATCHES = "doc_id long, item_id long, coverage double, matched_tokens long, item_tokens long, n_tiles long, longest_tile long, tiles array<struct<item_start:int,text_start:int,length:int>>"


def match(key, size: int, tiles: list[tuple[int, int, int]]) -> tuple:
    """The columns of MATCHES after the text's id."""
    covered = sum(x[2] for x in tiles)
    return key, covered / size, covered, size, len(tiles), max(x[2] for x in tiles), [{"item_start": i, "text_start": j, "length": n} for i, j, n in tiles]


@lru_cache(100_000)
def word_number(word: str) -> int:
    """A number of 63 bits and not 0, the same in every task."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 | 1


def numbered(text: str | None) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(word_number, words), np.uint64, len(words))


class SeedTable:
    """Items and seeds of a benchmark of any size, as stored tables, and the bitmap of the seeds' hashes."""

    def __init__(self, benchmark: DataFrame, least: int, id_col: str, text_col: str):
        self.least = least

        def items(batches):
            for b in batches:
                rows = [numbered(x.as_py()) for x in b.column(2)]
                yield {"item": b.column(0), "item_id": b.column(1), "words": [r.astype(np.int64) for r in rows], "size": [min(least, len(r)) for r in rows]}

        read = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
        self.items = stash(arrow_rows(read, items, "item long, item_id long, words array<long>, size int").filter("size > 0"), "benchmark-items")

        def seeds(batches):
            for b in batches:
                out = {"hash": [], "size": [], "item": []}
                for item, words, size in zip(*(b.column(k).to_pylist() for k in range(3))):
                    found = np.unique(Block.hashes(np.array(words, np.uint64), size)).astype(np.int64)
                    out["hash"] += found.tolist()
                    out["size"] += [size] * len(found)
                    out["item"] += [item] * len(found)
                yield out

        self.seeds = stash(arrow_rows(self.items.select("item", "words", "size"), seeds, "hash long, size int, item long"), "benchmark-seeds")
        self.sizes = [r[0] for r in self.seeds.select("size").distinct().collect()]  # at most `least`
        place = F.pmod("hash", F.lit(MAP_BITS)) + 1  # Spark's bitmaps count from 1
        marked = self.seeds.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        self.map = np.zeros(MAP_BITS // 8, np.uint8)
        for n, part in marked.toLocalIterator():  # MAP_BITS in all, however many seeds there are
            self.map[(n - 1) * len(part) : n * len(part)] = np.frombuffer(part, np.uint8)

    def matches(self, read: DataFrame, threshold: float) -> DataFrame:
        """MATCHES and the columns xx and crc, if read has them; read: doc_id, text."""
        kept = [c for c in ("xx", "crc") if c in read.columns]
        spark, least = read.sparkSession, self.least
        bits, sizes = spark.sparkContext.broadcast(self.map), self.sizes

        def windows_of(batches):
            for b in batches:
                out = {n: [] for n in ("row", "doc_id", *kept, "start", "size", "hash", "words")}
                columns = {n: b.column(n).to_pylist() for n in ("row", "doc_id", *kept)}
                for k, text in enumerate(b.column("text")):
                    row = numbered(text.as_py())
                    for size in sizes:
                        hashes = Block.hashes(row, size)
                        spot = (hashes.astype(np.int64) % MAP_BITS).astype(np.int64)
                        for j in np.flatnonzero(bits.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).tolist():
                            for n in columns:
                                out[n].append(columns[n][k])
                            out["start"].append(j)
                            out["size"].append(size)
                            out["hash"].append(int(hashes[j].astype(np.int64)))
                            out["words"].append(row[j : j + size].astype(np.int64))
                yield out

        extra = "".join(f", {c} long" for c in kept)
        found = arrow_rows(read.withColumn("row", F.monotonically_increasing_id()), windows_of, f"row long, doc_id long{extra}, start int, size int, hash long, words array<long>")
        found = stash(found, "benchmark-windows")
        shared = found.join(self.seeds, ["hash", "size"])
        # all that a text shares with one item: at most as many windows as the text has
        own = shared.groupBy("row", "doc_id", *kept, "item").agg(F.array_sort(F.collect_list(F.struct("start", F.col("words").alias("held")))).alias("shared"))

        def tiles_of(batches):
            names = ["doc_id", *kept, *(x.split()[0] for x in MATCHES.split(", ")[1:])]
            for b in batches:
                rows = []
                for doc, parts, key, words, *more in zip(*(b.column(n).to_pylist() for n in ("doc_id", "shared", "item_id", "words", *kept))):
                    size = min(least, len(words))
                    held = {p["start"] + i: w for p in parts for i, w in enumerate(p["held"])}
                    tiles = tiled(words, held, [p["start"] for p in parts], size)
                    if tiles and sum(x[2] for x in tiles) >= threshold * len(words):
                        rows.append((doc, *more, *match(key, len(words), tiles)))
                yield {name: [r[k] for r in rows] for k, name in enumerate(names)}

        return arrow_rows(own.join(self.items.drop("size"), "item"), tiles_of, MATCHES.replace("doc_id long", f"doc_id long{extra}", 1))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.5,
    least: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_tokens: int = HELD_TOKENS,
) -> DataFrame:
    """A row for each text and item of which tiles in the text cover at least `threshold`; block_tokens: tokens of a benchmark that a task holds."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = held_items(benchmark, item_col, item_text_col, block_tokens)
    if items is None:
        return SeedTable(benchmark, least, item_col, item_text_col).matches(read, threshold)

    def run(batches):
        block = Block(items, least)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for key, covered, size, tiles, _ in block.search(text.as_py()):
                    if covered >= threshold * size:
                        rows.append((doc, *match(key, size, tiles)))
            names = [x.split()[0] for x in MATCHES.split(", ")]
            yield {name: [r[k] for r in rows] for k, name in enumerate(names)}

    return arrow_rows(read, run, MATCHES)


#: Contaminated texts up to which their keys are broadcast.
BROADCAST_KEYS = 500_000


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 4, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_tokens: int = HELD_TOKENS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns.

    With a benchmark that a task holds no row is moved. Else contaminated texts are known by two hashes, and their rows go by an anti-join.
    """
    items = held_items(benchmark, item_col, item_text_col, block_tokens)
    if items is not None:

        def predicate():
            block = Block(items, least)
            return lambda batch: [not any(covered >= threshold * size for _, covered, size, _, _ in block.search(x.as_py())) for x in batch.column(text_col)]

        return keep_rows(docs, predicate)
    keys = {"xx": F.xxhash64(text_col), "crc": F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))}
    read = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in keys.items()])
    names = unused(docs.columns, 2)
    gone = SeedTable(benchmark, least, item_col, item_text_col).matches(read, threshold).select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).distinct()
    gone = stash(gone, "contaminated")
    keyed = docs.withColumns(dict(zip(names, keys.values())))
    return keyed.join(joined_if_small(gone.count(), BROADCAST_KEYS, gone), names, "left_anti").select(docs.columns)
