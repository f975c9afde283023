"""Hard negatives by one-dimensional distance keys.

Greatest inner product becomes nearest neighbour: every row gets one more component that brings all rows to the
length of the longest, so that the squared distance from an anchor (whose further component is 0) is a
constant less twice the product. Each row is filed under its nearest pivot with its distance to it as key; the index is a table stored in
order of (pivot, key) and cut into blocks of at most `block` rows of one pivot.

A search asks, for each anchor, for the k best rows within windows of scores. By the triangle inequality a row
whose key differs from the anchor's own distance to the pivot by more than r is farther than r. So the
key interval around that distance is scanned first for a small r, then its widening rings: a round joins the anchors with the
blocks that their rings touch, and computes the products block by block. An anchor stays open while a ring is left that
could hold a row as good as its k-th so far; the last radius covers everything, so results are exact on any data. On vectors without
structure the bound certifies late, and the search then reads all blocks, each once.

Groups are bounded: a group is one block and at most `chunk` anchors. Copies of one vector share a key; range partitioning
takes a hash of the id as further key, so that they spread over tasks.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as
filled up with zeros. Rows of an id that occurs several times are rows of their own, and a row is never
partner of an anchor with its own id. Products are exact while below 2^53. Ties of score go to the smaller id. Anchors
without positives, positives of negative score and windows without rows give no rows; an empty table
gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnwick.llm.common import stash

INDEXED = "vec_id long, label int, v array<double>, pivot int, key double"
FOUND = "request long, w int, score long, vec_id long"
#: Radii of the rounds, as parts of the length of the longest row; two rows are never farther apart than twice that length.
RADII = (0.125, 0.5, 2.0)


def matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with a further component, by which each has the squared length `top`."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(0.0, squares))


def best_in_block(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest finite scores, ties by smaller id, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero((scores >= least) & (scores > -np.inf))
    else:
        places = np.flatnonzero(scores > -np.inf)
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


class KeyIndex:
    """Rows stored by (pivot, distance) and a directory of their blocks."""

    def __init__(self, rows: DataFrame, pivots: int = 16, block: int = 4096, chunk: int = 8192):
        """rows: vec_id, label, v (doubles). Pivots are the rows of least hash of the id; every row is indexed."""
        self.chunk = chunk
        length = rows.agg(F.max(F.size("v"))).first()[0] or 0
        padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("v")))
        rows = stash(rows.withColumn("v", padded), "key-rows")
        self.top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).select("v").collect()
        top = self.top
        self.pivots = places = lifted(np.array([r["v"] for r in picked], float).reshape(len(picked), length), top)

        def keyed(batches):
            for b in batches:
                d = distances(lifted(matrix(b.column("v")), top), places)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], names=["vec_id", "label", "v", "pivot", "key"])

        def counted(batches):
            piece, places, last = TaskContext.get().partitionId(), 0, None
            for b in batches:
                numbers = np.empty(len(b), np.int64)
                for i, p in enumerate(b.column("pivot").to_pylist()):
                    places, last = (0 if p != last else places + 1), p
                    numbers[i] = places
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), piece, np.int64)), pa.array(numbers)], names=["vec_id", "label", "v", "pivot", "key", "piece", "place"])

        spread = rows.mapInArrow(keyed, INDEXED).repartitionByRange("pivot", "key", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "key", "vec_id")
        ordered = stash(spread.mapInArrow(counted, INDEXED + ", piece long, place long"), "key-index")
        # blocks are cut by the place in the whole order of a pivot, so that their number depends on the rows alone
        before = Window.partitionBy("pivot").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = ordered.groupBy("piece", "pivot").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        number = F.shiftleft(F.col("pivot").cast("long"), 40) + F.floor((F.col("start") + F.col("place")) / block)
        self.rows = ordered.join(stash(pieces, "key-pieces"), ["piece", "pivot"]).select("vec_id", "label", "v", "pivot", "key", number.alias("block"))
        self.blocks = stash(self.rows.groupBy("block", "pivot").agg(F.min("key").alias("lo"), F.max("key").alias("hi")), "key-blocks")

    def search(self, requests: DataFrame, k: int, same: bool) -> DataFrame:
        """request, w, score, vec_id, rank: the k best rows in every window of each request.

        requests: request (an id of its own), vec_id, label, v, windows: array of (w, low, high), scores from low to high. Rows looked at are those of
        the request's label if `same`, else those of other labels.
        """
        top, pivots = self.top, self.pivots
        schema = "request long, vec_id long, label int, v array<double>, windows array<struct<w:int,low:double,high:double>>, away array<double>, square double"

        def measured(batches):
            for b in batches:
                x = matrix(b.column("v"))
                away = distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(pivots), away.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array((x * x).sum(1))], names=["request", "vec_id", "label", "v", "windows", "away", "square"])

        asked = stash(requests.select("request", "vec_id", "label", "v", "windows").mapInArrow(measured, schema), "key-requests")
        many = asked.count()
        parts = max(1, -(-many // self.chunk))
        reach = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + top - 2 * score))
        least = F.array_min(F.transform("windows", lambda w: w["low"]))
        near = reach(F.array_max(F.transform("windows", lambda w: w["high"])))
        slack = 1e-6 * (1 + top**0.5)  # distances are rounded
        found = asked.sparkSession.createDataFrame([], FOUND)
        done = float("-inf")
        for part in RADII if many else ():
            # what is still wanted: the k-th score of each window, or its lower end while it has fewer
            kth = found.groupBy("request", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
            wants = asked.select("request", F.explode("windows").alias("x")).select("request", "x.*").join(kth, ["request", "w"], "left")
            wants = wants.groupBy("request").agg(F.min(F.coalesce(F.col("kth").cast("double"), "low")).alias("want"))
            open_ = asked.join(wants, "request").select("request", (F.col("request") % parts).alias("part"), near.alias("near"), F.when(F.col("want") > float("-inf"), reach(F.col("want"))).otherwise(float("inf")).alias("reach"), F.posexplode("away").alias("pivot", "far"))
            ring = F.greatest(F.lit(0.0), F.col("far") - F.col("hi"), F.col("lo") - F.col("far"))
            fits = (F.col("ring") > F.col("near") + done) & (F.col("ring") <= F.least(F.col("near") + part * top**0.5 + slack, F.col("reach") + slack)) & (F.col("far") + F.col("hi") + slack >= F.col("near"))
            touched = stash(open_.join(self.blocks, "pivot").withColumn("ring", ring).filter(fits).select("request", "part", "block"), "key-touched")
            done = part * top**0.5 + slack
            if touched.isEmpty():
                continue
            wanted = touched.join(asked.drop("away", "square"), "request")
            pieces = touched.select(F.col("block").alias("at"), F.col("part").alias("of")).distinct()
            rows = self.rows.select(F.col("block").alias("at"), "vec_id", "label", "v").join(pieces, "at")
            fresh = wanted.groupBy("block", "part").cogroup(rows.groupBy("at", "of")).applyInArrow(_in_block(k, same), FOUND)
            order = Window.partitionBy("request", "w").orderBy(F.col("score").desc(), "vec_id")
            found = stash(found.unionByName(fresh).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "key-found")
        order = Window.partitionBy("request", "w").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order))


def _in_block(k: int, same: bool):
    """Of one block of rows, the k best of every window of the anchors that touch it."""

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"request": [], "w": [], "score": [], "vec_id": []}
        if len(asked) and len(rows):
            x, q = (matrix(t.column("v").combine_chunks()) for t in (rows, asked))
            ids, labels = (rows.column(n).to_numpy() for n in ("vec_id", "label"))
            own, label, numbers = (asked.column(n).to_numpy() for n in ("vec_id", "label", "request"))
            windows = asked.column("windows").to_pylist()
            for at in range(0, len(q), 256):
                scores = x @ q[at : at + 256].T
                for j in range(scores.shape[1]):
                    i = at + j
                    fits = (ids != own[i]) & ((labels == label[i]) == same)
                    for w in windows[i]:
                        s = np.where(fits & (scores[:, j] >= w["low"]) & (scores[:, j] <= w["high"]), scores[:, j], -np.inf)
                        places = best_in_block(s, ids, k)
                        out["request"] += [numbers[i]] * len(places)
                        out["w"] += [w["w"]] * len(places)
                        out["score"] += s[places].astype(np.int64).tolist()
                        out["vec_id"] += ids[places].tolist()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(out[n], t) for n, t in zip(out, kinds)], names=list(out))

    return best


def integer_rows(vectors: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id, label, v of the rows that take part, each component floor(scale * x)."""
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(column).isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: predicate on vec_id and label. A positive is one of an anchor's best rows of its label; its negatives are the best rows of other labels
    with a score between low and high percent of the positive's.
    """
    store = KeyIndex(integer_rows(vectors, scale), **index)
    every = F.array(F.struct(F.lit(0).alias("w"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    asked = stash(store.rows.filter(anchors).select(F.monotonically_increasing_id().alias("request"), "vec_id", "label", "v").withColumn("windows", every), "key-anchors")
    good = stash(store.search(asked, positives, True).select("request", F.col("rank").cast("int").alias("w"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "key-positives")
    p = F.col("positive_score")
    window = F.struct("w", F.ceil(low * p / 100).cast("double").alias("low"), F.floor(high * p / 100).cast("double").alias("high"))
    spans = good.filter(p >= 0).groupBy("request").agg(F.array_sort(F.collect_list(window)).alias("windows"))  # at most `positives` a request
    bad = store.search(asked.drop("windows").join(spans, "request"), negatives, False)
    rows = bad.select("request", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(good, ["request", "w"])
    return rows.join(asked.select("request", F.col("vec_id").alias("anchor_id")), "request").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
