"""Groups of texts whose word n-gram sets overlap: an exact Jaccard join with a prefix tree.

1. One scan hashes every text's n-grams. Equal sets are one class (by a 128-bit digest). N-grams
   are dealt by hash range, each once per scanned batch; an n-gram that occurs in one class only
   can't be in an overlap. A class with too few n-grams that occur elsewhere has no partner and
   needs no further look: this settles nearly all texts. Truncated hashes only ever make an
   n-gram look shared, so no link is lost.
2. The sets of the classes left are fetched, and their n-grams ordered globally, rare ones first.
   By the prefix principle two linked sets share one of their first n - ceil(t n) + 1 n-grams;
   classes that share one are joined to clusters (links to the least member: no pairs).
3. Each cluster's sets are stored in a compressed prefix tree, frequent n-grams first. A set is
   looked up by walking the tree: shared beginnings are overlapped once, and a subtree is left when
   what remains of the set or of the subtree's longest member can't reach the overlap that the
   subtree's smallest member needs. Subtrees whose members all are in the set's own
   component are left too: their links are known. In clusters beyond a size, members are first compared with a few hubs:
   many copies of one original cost one comparison each. Then the members are dealt by the n-grams of their prefixes, as
   linked sets share one; members that share one but are all linked with the same hub need no work. Only where too many
   members share one n-gram, they are cut into blocks and compared by pairs of blocks. Memory stays bounded, and no
   link between components is lost.
4. Links found are closed to components, and every text gets its class's component.

Defined results: null and empty texts have 0 n-grams and are linked with nothing; a text with
fewer words than n has its whole word sequence as its one n-gram; rows with a null doc_id are
returned with a null component and link nothing; rows of one doc_id with different texts are
separate sets; texts are read whole; an empty table gives an empty result; further columns are
not carried.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tarnwick.llm.common import arrow_rows, joined_if_small, stash, text_bytes
from tarnwick.llm.components import components

#: N-grams and classes of one batch of postings.
BATCH_GRAMS, BATCH_CLASSES = 700_000, 60_000
#: Classes up to which their ids are broadcast: 8 bytes each.
BROADCAST_ROWS = 1_000_000
#: Sets of a cluster that one task takes, and of a block of larger clusters.
CLUSTER_SETS, BLOCK_SETS = 1_000, 500
#: Rounds in which the members of a large cluster are compared with a hub; rows of small tables, and bytes of hubs, up to which they are broadcast.
HUB_ROUNDS, HUB_ROWS, HUB_BYTES = 3, 100_000, 32 << 20
HERE = 0xFFFF  # stands for a batch's classes that share an n-gram among themselves


def gram_hashes(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams (A-Z in lower case)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    row = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(row) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ row[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def postings(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """bucket, batch, grams, classes, ...: n-grams by hash range, and one row for each batch with its texts."""

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0

        def flush():
            nonlocal count
            batch, count = (part << 32) + count, count + 1
            out = {k: [] for k in ("bucket", "batch", "grams", "at", "ids", "of", "sizes", "digests", "here")}

            def emit(**row):
                for k in out:
                    out[k].append(row.get(k))

            here = np.zeros(len(grams), np.int32)
            if grams:
                h = np.concatenate(grams)
                c = np.repeat(np.arange(len(grams), dtype=np.uint16), list(map(len, grams)))
                order = np.argsort(h)
                h, c = h[order], c[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
                runs = np.diff(np.append(first, len(h)))
                shared = np.repeat(runs > 1, runs)
                here += np.bincount(c[shared], minlength=len(grams)).astype(np.int32)
                c = np.where(runs > 1, np.uint16(HERE), c[first])
                h = h[first]
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                low = h.view(np.uint8).reshape(-1, 8)[:, :6]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.empty(0, np.int64)
                for a, b in zip(edges, np.append(edges[1:], len(h))):
                    emit(bucket=int(bucket[a]), batch=batch, grams=low[a:b].tobytes(), at=c[a:b].tobytes())
            emit(
                bucket=(1 << bits) + batch % (1 << bits), batch=batch, ids=np.array(ids, np.int64).tobytes(), of=np.array(of, np.int32).tobytes(),
                sizes=np.array(sizes, np.int32).tobytes(), digests=b"".join(classes), here=here.tobytes(),
            )
            return out

        ids, of, grams, sizes, classes, total = [], [], [], [], {}, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                g = gram_hashes(text.as_py(), n)
                ids.append(doc or 0)
                key = digest(g)
                if key not in classes:
                    classes[key] = len(classes)
                    grams.append(g if doc is not None else g[:0])  # a text without id links nothing
                    sizes.append(len(g))
                    total += len(g)
                elif doc is not None and not len(grams[classes[key]]):
                    grams[classes[key]] = g
                of.append(classes[key] if doc is not None else ~classes[key])  # negative: no id
                if total >= BATCH_GRAMS or len(classes) >= BATCH_CLASSES or len(ids) >= 4 * BATCH_CLASSES:
                    yield flush()
                    ids, of, grams, sizes, classes, total = [], [], [], [], {}, 0
        if ids:
            yield flush()

    schema = "bucket long, batch long, grams binary, at binary, ids binary, of binary, sizes binary, digests binary, here binary"
    return arrow_rows(docs, run, schema)


def shared_in_bucket(frame):
    """For one hash range: which classes of which batch have an n-gram that occurs elsewhere."""
    import pandas as pd

    names = ["batch", "at", "ids", "of", "sizes", "digests", "here"]
    if frame["grams"].iloc[0] is None:
        return frame[names]
    sizes = [len(x) // 2 for x in frame["at"]]
    low = np.frombuffer(b"".join(frame["grams"]), np.uint8).reshape(-1, 6)
    h = np.zeros((len(low), 8), np.uint8)
    h[:, :6] = low
    h = h.view(np.uint64).ravel()
    at = np.frombuffer(b"".join(frame["at"]), np.uint16)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= same[1:].copy()
    hit = np.sort(order[same])
    hit = hit[at[hit] != HERE]
    rows, cuts = np.unique(row[hit], return_index=True)
    blobs = [x.tobytes() for x in np.split(at[hit], cuts[1:])] if len(rows) else []
    return pd.DataFrame({"batch": frame["batch"].to_numpy()[rows], "at": blobs} | {k: [None] * len(rows) for k in names[2:]}, columns=names)


def texts_of_batch(percent: int):
    """doc_id, n, digest and alive (it may have a partner) of a batch's texts."""

    def run(frame):
        import pandas as pd

        own = frame[frame["of"].notna()].iloc[0]
        of, sizes, here = (np.frombuffer(own[k], np.int32) for k in ("of", "sizes", "here"))
        hits = b"".join(x for x in frame["at"] if x is not None)
        found = here + np.bincount(np.frombuffer(hits, np.uint16), minlength=len(sizes))
        alive = (100 * found.astype(np.int64) >= percent * sizes.astype(np.int64)) & (sizes > 0)
        keys = [own["digests"][16 * k : 16 * k + 16] for k in range(len(sizes))]
        ids = pd.Series(np.frombuffer(own["ids"], np.int64)).astype("Int64").mask(of < 0)
        of = np.where(of < 0, ~of, of)
        return pd.DataFrame({"doc_id": ids, "n": sizes[of].astype(np.int64), "digest": [keys[k] for k in of], "alive": alive[of]})

    return run


class Node:
    """A node of a compressed prefix tree: a run of n-grams, what follows, and bounds on what is below."""

    __slots__ = ("run", "last", "next", "ends", "least", "rest", "one", "single")

    def __init__(self, run: np.ndarray, least: int, rest: int, one: int):
        self.run, self.last = run, int(run[-1]) if len(run) else -1
        self.next: dict[int, Node] = {}
        self.ends: list[int] = []
        self.least, self.rest, self.one, self.single = least, rest, one, True


class PrefixTree:
    """Sets of ordered n-grams, for finding those that overlap a set enough and aren't yet in its component."""

    def __init__(self, rows: list[np.ndarray], sizes: list[int], percent: int):
        self.rows, self.sizes, self.percent = rows, sizes, percent
        self.up = list(range(len(rows)))
        self.root = Node(np.empty(0, np.int64), 1 << 60, 0, -1)
        self.mark = np.zeros(1 + max((int(r[-1]) for r in rows if len(r)), default=0), np.bool_)

    def find(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def add(self, k: int) -> None:
        row, size, here, at = self.rows[k], self.sizes[k], self.root, 0
        while True:
            if here.one < 0:
                here.one = k
            here.least, here.rest = min(here.least, size), max(here.rest, len(row) - at)
            if here.single and self.find(here.one) != self.find(k):
                here.single = False
            if at == len(row):
                here.ends.append(k)
                return
            child = here.next.get(int(row[at]))
            if child is None:
                leaf = here.next[int(row[at])] = Node(row[at:], size, 0, k)
                leaf.ends.append(k)
                return
            both = min(len(child.run), len(row) - at)
            differ = np.flatnonzero(child.run[:both] != row[at : at + both])
            same = int(differ[0]) if len(differ) else both
            if same < len(child.run):
                upper = Node(child.run[:same], child.least, child.rest + len(child.run) - same, child.one)
                upper.single = child.single
                child.run = child.run[same:]
                upper.next[int(child.run[0])] = child
                here.next[int(row[at])] = child = upper
            here, at = child, at + same

    def refresh(self) -> None:
        """Finds anew which subtrees have members of one component only."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.next.values()
        for node in reversed(order):
            roots = {self.find(k) for k in node.ends} | {self.find(c.one) for c in node.next.values()}
            node.single = len(roots) <= 1 and all(c.single for c in node.next.values())

    def links(self, k: int) -> list[int]:
        """Members linked with set k that were not in its component; they are joined with it."""
        row, size, mark, percent = self.rows[k], self.sizes[k], self.mark, self.percent
        mark[row] = True
        mine, out, stack = self.find(k), [], [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.one < 0 or node.single and self.find(node.one) == mine:
                continue
            if len(node.run):
                overlap += int(np.count_nonzero(mark[node.run]))
                left = len(row) - int(row.searchsorted(node.last, "right"))
                most = overlap + min(left, node.rest)
            else:
                most = min(len(row), node.rest)
            if (100 + percent) * most < percent * (size + node.least):
                continue
            for other in node.ends:
                if (100 + percent) * overlap >= percent * (size + self.sizes[other]) and self.find(other) != mine:
                    self.up[max(mine, self.find(other))] = min(mine, self.find(other))
                    mine = self.find(k)
                    out.append(other)
            stack += [(c, overlap) for c in node.next.values()]
        mark[row] = False
        return out


def tree_links(percent: int):
    """Links that connect a cluster's sets, or the sets of two of its blocks: a, b (a forest of them)."""

    def run(key, frame):
        import pandas as pd

        first = int(key[2])
        across = first != int(key[3])
        frame = frame.sort_values(["n", "sid"])
        grams = [np.asarray(g, np.int64) for g in frame["grams"]]
        values, ranks, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        place = np.empty(len(values), np.int64)
        place[np.lexsort((values, -counts))] = np.arange(len(values))  # frequent n-grams first
        rows = [np.sort(x) for x in np.split(place[ranks], np.cumsum([len(g) for g in grams])[:-1])]
        rows = [r[counts_in(place, counts, r)] for r in rows]
        tree = PrefixTree(rows, frame["n"].tolist(), percent)
        sids, blocks = frame["sid"].tolist(), frame["block"].tolist()
        found = []
        order = range(len(rows))
        if across:
            for k in order:
                if blocks[k] == first:
                    tree.add(k)
            order = [k for k in order if blocks[k] != first]
        for step, k in enumerate(order):
            found += [(sids[k], sids[o]) for o in tree.links(k)]
            if not across:
                tree.add(k)
            if step % 256 == 255:
                tree.refresh()
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def counts_in(place: np.ndarray, counts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which n-grams of a row occur in another set of the task: only those can overlap."""
    by_rank = np.empty(len(counts), np.int64)
    by_rank[place] = counts
    return by_rank[row] > 1


def live_sets(docs: DataFrame, texts: DataFrame, n: int, name: str) -> DataFrame:
    """sid, digest, n, grams of the classes that may have a partner: one text each is read again."""
    classes = stash(texts.filter("alive").groupBy("digest").agg(F.min("doc_id").alias("doc_id")), f"{name}-classes")
    ids = classes.select("doc_id").distinct()
    if classes.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def run(batches):
        for b in batches:
            sets = [gram_hashes(x.as_py(), n) for x in b.column(1)]
            yield {"digest": [digest(g) for g in sets], "n": [len(g) for g in sets], "grams": [g.view(np.int64) for g in sets]}

    read = arrow_rows(docs.join(ids, "doc_id", "left_semi").select("doc_id", "data"), run, "digest binary, n int, grams array<long>")
    once = read.join(classes.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    return stash(once.withColumn("sid", F.monotonically_increasing_id()), f"{name}-sets")


def linked_to_hubs(members: DataFrame, percent: int, name: str) -> DataFrame:
    """sid, hub, label: members of large clusters that are linked with one of the cluster's hubs.

    A hub is the member whose n-grams occur most often, as the original of many copies has; in each round
    the members not yet linked get a hub, of which each is compared with its cluster's only: a linear step.
    """
    found = None
    for label in range(HUB_ROUNDS):
        best = members.groupBy("root").agg(F.max(F.struct("centre", "sid")).alias("b")).select(F.col("b.sid").alias("sid"))
        hubs = stash(members.join(best, "sid").select("root", F.col("sid").alias("hub"), F.col("n").alias("hub_n"), F.col("grams").alias("hub_grams")), f"{name}-hubs")
        size = hubs.agg(F.coalesce(F.sum(64 + 8 * F.size("hub_grams")), F.lit(0))).first()[0]
        near = joined_if_small(size, HUB_BYTES, hubs)
        overlap = F.size(F.array_intersect("grams", "hub_grams"))
        hits = members.join(near, "root").filter((F.col("sid") == F.col("hub")) | ((100 + percent) * overlap >= percent * (F.col("n") + F.col("hub_n"))))
        hits = stash(hits.select("sid", "hub", F.lit(label).alias("label")), f"{name}-linked")
        found = hits if found is None else found.unionByName(hits)
        members = members.join(hits.select("sid"), "sid", "left_anti")
    return found


def clustered(sets: DataFrame, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Work: root, gram, i, j, block, sid, n, grams, the sets of each cluster, or those of a large one that share an n-gram; and the links found on the way.

    Members of a large cluster that share an n-gram of their prefixes are one piece of work (gram; 0 for other clusters), unless all are
    linked with the same hub. If they are too many they stand in blocks, each of members linked with the same hub, or with none, and
    every pair of blocks is one piece of work, but for pairs of one hub: those are in one component already.
    """
    grams = sets.select("sid", F.explode("grams").alias("h"))
    often = grams.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = grams.join(often, "h").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"), F.avg("df").alias("centre"))
    kept = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1  # the prefix's length, of which rarer n-grams take a part
    live = sets.select("sid", "n").join(shared, "sid").withColumn("p", (kept - (F.col("n") - F.size("s"))).cast("int")).filter("p > 0")
    live = stash(live.select("sid", "n", "centre", F.transform("s", lambda x: x["h"]).alias("grams"), F.transform(F.slice("s", 1, F.col("p")), lambda x: x["h"]).alias("prefix")), f"{name}-live")
    heads = live.select("sid", F.explode("prefix").alias("h"))
    least = heads.groupBy("h").agg(F.min("sid").alias("b"))
    near = components(heads.join(least, "h").select(F.col("sid").alias("a"), "b").filter("a != b"), name=f"{name}-clusters").withColumnRenamed("node", "sid")
    near = stash(near, f"{name}-near")
    # only large clusters, at most one for CLUSTER_SETS sets, need more than their root
    sizes = stash(near.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > CLUSTER_SETS).select("root"), f"{name}-large")
    n_large = sizes.count()
    links = None
    alone = {"gram": F.lit(0).cast("long"), "label": F.lit(-1), "m": F.lit(1).cast("long")}
    dealt = near.withColumns(alone)
    if n_large:
        sizes = joined_if_small(n_large, HUB_ROWS, sizes)
        members = stash(near.join(sizes, "root", "left_semi"), f"{name}-members")
        found = linked_to_hubs(live.join(members, "sid").select("sid", "root", "n", "grams", "centre"), percent, name)
        links = found.filter("sid != hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))
        labelled = members.join(found.select("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", F.lit(HUB_ROUNDS)))
        posts = stash(heads.join(labelled, "sid").select("sid", "root", F.col("h").alias("gram"), "label"), f"{name}-posts")
        counts = posts.groupBy("root", "gram", "label").agg(F.count("*").alias("m"))
        groups = counts.groupBy("root", "gram").agg(F.sum("m").alias("all"), F.min("label").alias("low"), F.max("label").alias("high"))
        groups = groups.filter((F.col("all") > 1) & ((F.col("low") != F.col("high")) | (F.col("low") == HUB_ROUNDS)))
        groups = stash(counts.join(groups.select("root", "gram", "all"), ["root", "gram"]), f"{name}-counts")
        few = F.col("all") <= CLUSTER_SETS
        held = posts.join(joined_if_small(groups.count(), HUB_ROWS, groups), ["root", "gram", "label"])
        held = held.select("sid", "root", "gram", F.when(few, F.lit(-1)).otherwise(F.col("label")).alias("label"), F.when(few, F.lit(1)).otherwise(F.col("m")).alias("m"))
        dealt = near.join(sizes, "root", "left_anti").withColumns(alone).unionByName(held)
    part = F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_SETS)))
    block = F.when(F.col("label") < 0, F.lit(0)).otherwise(F.col("label").cast("long") * (1 << 32) + part)
    dealt = stash(dealt.select("sid", "root", "gram", "label", block.cast("long").alias("block")), f"{name}-blocks")
    key = ["root", "gram"]
    blocks = dealt.select(*key, "label", "block").distinct()
    second = blocks.select(*key, F.col("label").alias("label2"), F.col("block").alias("j"))
    pairs = blocks.withColumnRenamed("block", "i").join(second, key).filter("i <= j and (label != label2 or label in (-1, " + str(HUB_ROUNDS) + "))")
    sides = pairs.select(*key, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    work = live.select("sid", "n", "grams").join(dealt.select("sid", *key, "block"), "sid").join(sides, [*key, "block"])
    return work, links


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links of Jaccard >= percent / 100 reach."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
    bits = min(20, max(3, math.ceil(math.log2(max(1, docs.count()) / 500 + 1))))
    by_range = postings(read, n, bits).groupBy("bucket").applyInPandas(
        shared_in_bucket, "batch long, at binary, ids binary, of binary, sizes binary, digests binary, here binary"
    )
    texts = stash(by_range.groupBy("batch").applyInPandas(texts_of_batch(percent), "doc_id long, n long, digest binary, alive boolean"), "jaccard-texts")
    sets = live_sets(read, texts.filter("doc_id is not null"), n, "jaccard")
    work, hub_links = clustered(sets, percent, "jaccard")
    links = work.groupBy("root", "gram", "i", "j").applyInPandas(tree_links(percent), "a long, b long")
    links = stash(links if hub_links is None else links.unionByName(hub_links), "jaccard-links")
    found = components(links, name="jaccard-components").join(sets.select(F.col("sid").alias("node"), "digest"), "node").select("root", "digest")
    classes = texts.filter("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    reached = found.join(classes, "digest")
    least = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    named = reached.select("root", "digest").join(least, "root").select("digest", "component_id")
    named = classes.join(named, "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    named = stash(named, "jaccard-named")  # both sides of the last join are then plain shuffles, of which AQE splits a hot class
    out = texts.join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
