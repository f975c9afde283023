"""Gated recurrent language model with a class-factored softmax, in numpy.

Counts of all training words come first, by partial counts in the tasks. The most frequent words are the model's
vocabulary; an end token and one token for all rarer words are part of it. The words stand in classes of equal size by rank, and
a word's probability is that of its class times that within the class, both by softmax over the state of a gated recurrent
unit. A rarer word's probability is that of its token times (c + 1) / (sum of c + 1 over the rarer words, and 1 for all unseen
ones), hence all words, seen or not, share a total of 1.

Texts are encoded once to word numbers and stored. All training documents are dealt by hash to shards of a size that does not grow,
each shard is learned by one task with back-propagation truncated to windows, and the parameters of the shards are averaged by
their tokens, in groups of a bounded number. The first eighth of the shards starts from the initial parameters, the others from
the average of that eighth. A task keeps documents whole in parallel streams: the state is carried from window to
window and starts at zero with each document, in training and in scoring.

Bounds: the model's `words`, `width`, `classes`; the `held` most frequent words whose counts tasks hold (the others' are joined by word).
The corpus itself is neither sampled nor cut. Encoded training documents stand in shards of about `shard` tokens, a very long document more than that.

Defined results: null and empty texts are one end token; texts are read whole; repeated rows are each scored and learned; a null id is
not held out; without training documents the model knows its two tokens alone, as it starts, and the base score of any text is 0; an
empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from heapq import heapify, heapreplace
from itertools import repeat
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import release, small_batches, stash, text_bytes

RARE, END = 0, 1
LN10 = log(10)


def exponentials(w: np.ndarray, b: np.ndarray, across: np.ndarray) -> np.ndarray:
    """exp(w h + b) for the states in the columns of `across`, up to a factor for each column.

    States lie within 1 on both sides, so the weights' sizes bound every sum: only where those bounds allow an overflow, or all terms to vanish, the greatest is taken off first.
    """
    e = w @ across
    e += b[:, None]
    size = np.abs(w).sum(1)
    if (b + size).max() > 60 or (b - size).max() < -60:
        e -= e.max(0)
    return np.exp(e, out=e)


class Recurrent:
    """Parameters of the network and its passes over windows of streams.

    The unit has one gate z: h' = z h + (1 - z) c, where (2 z - 1, c) = tanh(emb[word before] + h uh).
    """

    NAMES = ("emb", "uh", "cw", "cb", "ww", "wb")

    def __init__(self, counts, width: int, size: int, seed: int = 1):
        """counts: of the vocabulary, by rank; size: words of a class."""
        draw = np.random.default_rng(seed)
        n = -(-len(counts) // size)
        share = np.zeros(n * size)
        share[: len(counts)] = np.asarray(counts, float) + 1
        share = share.reshape(n, size)
        self.width, self.size = width, size
        make = lambda part, *shape: (draw.standard_normal(shape) * part * width**-0.5).astype(np.float32)
        self.emb, self.uh = make(1, n * size, 2 * width), make(1, width, 2 * width)
        self.cw, self.ww = make(0.1, n, width), make(0.1, n, size, width)
        # at first the biases alone speak: the model starts as the words' shares
        self.cb = np.log(share.sum(1) / share.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.wb = np.maximum(np.log(share / share.sum(1, keepdims=True)), -1e4).astype(np.float32)

    def packed(self) -> bytes:
        return b"".join(getattr(self, n).tobytes() for n in self.NAMES)

    def unpack(self, data: bytes) -> Recurrent:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, np.frombuffer(data, np.float32, old.size, at).reshape(old.shape).copy())
            at += old.nbytes
        return self

    def states(self, given: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """States of a window, and what back() needs: given[t, s] is the word before, fresh[t, s] 0 where a document starts, h the states before the window."""
        (steps, lanes), w = given.shape, self.width
        gates = self.emb[given.ravel()].reshape(steps, lanes, 2 * w)
        before, out = np.empty((2, steps, lanes, w), np.float32)
        for t in range(steps):
            h = np.multiply(h, fresh[t][:, None], out=before[t])
            g = gates[t]
            g += h @ self.uh
            np.tanh(g, out=g)
            c = g[:, w:]
            h = np.subtract(h, c, out=out[t])
            h *= g[:, :w] * np.float32(0.5) + np.float32(0.5)
            h += c
        return out, before, gates

    def back(self, dout, given, fresh, before, gates) -> dict[str, np.ndarray]:
        """Gradients of the recurrent part within the window."""
        (steps, lanes), w = given.shape, self.width
        z = gates[..., :w] * np.float32(0.5) + np.float32(0.5)
        c = gates[..., w:]
        slope = np.square(gates)
        np.subtract(1, slope, out=slope)
        slope[..., :w] *= (before - c) * np.float32(0.5)
        slope[..., w:] *= 1 - z
        dh, back = np.zeros((lanes, w), np.float32), np.ascontiguousarray(self.uh.T)
        for t in range(steps - 1, -1, -1):
            dh += dout[t]
            d = slope[t]
            d[:, :w] *= dh
            d[:, w:] *= dh
            dh *= z[t]
            dh += d @ back
            dh *= fresh[t][:, None]
        flat, words = slope.reshape(-1, 2 * w), given.ravel()
        order = np.argsort(words, kind="stable")
        starts = np.flatnonzero(np.diff(words[order], prepend=-1))
        emb = np.zeros_like(self.emb)
        emb[words[order][starts]] = np.add.reduceat(flat[order], starts)
        return {"uh": before.reshape(-1, w).T @ flat, "emb": emb}

    def speak(self, h: np.ndarray, target: np.ndarray, learn: bool):
        """Natural log-probabilities of the target words after states h; with learn also gradients of minus their sum."""
        group, place = np.divmod(target, self.size)
        order = np.argsort(group.astype(np.int16), kind="stable")
        # words in the order of their classes; the softmaxes run along columns
        s, group, place = h[order], group[order], place[order]
        across = np.ascontiguousarray(s.T)
        rows = np.arange(len(target))
        a = exponentials(self.cw, self.cb, across)
        total = a.sum(0)
        said = np.log(a[group, rows] / total)
        if learn:
            a /= total
            a[group, rows] -= 1
            grads = {"cw": a @ s, "cb": a.sum(1), "ww": np.zeros_like(self.ww), "wb": np.zeros_like(self.wb)}
            dh = a.T @ self.cw
        at = 0
        for g, end in enumerate(np.cumsum(np.bincount(group, minlength=len(self.cb))).tolist()):
            if end == at:
                continue
            e = exponentials(self.ww[g], self.wb[g], across[:, at:end])
            total, p, k = e.sum(0), place[at:end], rows[: end - at]
            said[at:end] += np.log(e[p, k] / total)
            if learn:
                e /= total
                e[p, k] -= 1
                grads["ww"][g], grads["wb"][g] = e @ s[at:end], e.sum(1)
                dh[at:end] += e.T @ self.ww[g]
            at = end
        logp = np.empty_like(said)
        logp[order] = said
        if not learn:
            return logp
        back = np.empty_like(dh)
        back[order] = dh
        return logp, grads, back


def streams(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents to at most `most` parallel streams of about the same length, longest first."""
    order = np.argsort(-lengths, kind="stable").tolist()
    most = max(1, min(most, len(order)))
    heap, out = [(0, i) for i in range(most)], [[] for _ in range(most)]
    heapify(heap)
    for d in order:
        n, i = heap[0]
        out[i].append(d)
        heapreplace(heap, (n + int(lengths[d]), i))
    return out


class Lanes:
    """Documents laid out in parallel streams, the longest streams first: word before, target and start flags by step."""

    def __init__(self, docs: list[np.ndarray], most: int):
        lengths = np.array([len(d) for d in docs])
        lanes = sorted(streams(lengths, most), key=lambda lane: -sum(int(lengths[d]) for d in lane))
        self.live = np.array([int(lengths[lane].sum()) for lane in lanes])
        shape = (int(self.live[0]), len(lanes))
        self.target, self.given, self.fresh = np.zeros(shape, np.int32), np.full(shape, END, np.int32), np.ones(shape, np.float32)
        self.place = np.empty((len(docs), 3), np.int64)  # stream, first step, steps
        for i, lane in enumerate(lanes):
            at = 0
            for d in lane:
                n = len(docs[d])
                self.target[at : at + n, i] = docs[d]
                self.given[at + 1 : at + n, i] = docs[d][:-1]
                self.fresh[at, i] = 0
                self.place[d] = i, at, n
                at += n

    def windows(self, steps: int):
        """given, fresh, target and the flags of real words of each window, for the streams that have not ended."""
        for at in range(0, len(self.target), steps):
            n = int(np.count_nonzero(self.live > at))
            cut = slice(at, at + steps), slice(0, n)
            told = np.arange(at, min(at + steps, len(self.target)))[:, None] < self.live[:n]
            yield self.given[cut], self.fresh[cut], self.target[cut], told


def learned(net: Recurrent, docs: list[np.ndarray], most: int = 256, window: int = 32, rate: float = 0.02) -> Recurrent:
    """One pass over documents (word numbers, each with its end), by Adam on windows of parallel streams."""
    lanes = Lanes(docs, most)
    held = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in net.NAMES}
    h = np.zeros((len(lanes.live), net.width), np.float32)
    windows = -(-len(lanes.target) // window)
    for k, (given, fresh, target, told) in enumerate(lanes.windows(window)):
        out, before, gates = net.states(given, fresh, h[: given.shape[1]])
        h = out[-1]
        y = target[told]
        _, grads, dh = net.speak(out[told], y, True)
        dout = np.zeros_like(out)
        dout[told] = dh
        grads |= net.back(dout, given, fresh, before, gates)
        share = min(1.0, len(y) / (most * window))  # the last windows hold few streams
        step = rate * share * (1 - 0.9 * k / windows) * (1 - 0.99 ** (k + 1)) ** 0.5 / (1 - 0.9 ** (k + 1))
        for n, (m, v) in held.items():
            d = grads[n]
            d *= np.float32(1 / len(y))
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            d *= d
            d *= np.float32(0.01)
            v += d
            np.sqrt(v, out=d)
            d += np.float32(1e-6)
            np.divide(m, d, out=d)
            d *= np.float32(step)
            getattr(net, n)[...] -= d
    return net


def log10_of(net: Recurrent, docs: list[np.ndarray], most: int = 512, window: int = 32) -> np.ndarray:
    """log10 probabilities of whole documents, the state carried over windows."""
    lanes = Lanes(docs, most)
    h = np.zeros((len(lanes.live), net.width), np.float32)
    said = np.zeros(lanes.target.shape, np.float32)
    at = 0
    for given, fresh, target, told in lanes.windows(window):
        out, _, _ = net.states(given, fresh, h[: given.shape[1]])
        h = out[-1]
        said[at : at + len(told), : told.shape[1]][told] = net.speak(out[told], target[told], False)
        at += len(told)
    return np.array([said[a : a + n, i].sum(dtype=float) for i, a, n in lanes.place]) / LN10


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() parts at space, \\t, \\n, \\v, \\f and \\r, and lower() touches A-Z alone."""
    return text.lower().split()


def _counted(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """word, n of all texts; a task sends its partial counts as soon as it holds `most` words."""

    def run(batches):
        release()
        held: Counter = Counter()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for text in b.column(0):
                held.update(words_of(text.as_py()))
                if len(held) >= most:
                    yield batch()
                    held.clear()
        if held:
            yield batch()
        held.clear()
        release()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Counts:
    """Words of the training documents with their counts, stored; the most frequent ones held by the driver."""

    def __init__(self, texts: DataFrame, words: int, held: int):
        """texts: one binary column. held: at most so many words reach the driver, all of a count or none."""
        self.table = stash(_counted(texts), "lm-words")
        self.documents = texts.count()
        rows = self.table.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens = (rows["n"] or 0) + self.documents
        self.distinct = rows["v"] + (self.documents > 0)
        # counts to within a sixteenth of a power of two: a bounded number of rows
        step = F.floor(F.log2("n") * 16)
        sizes = self.table.groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
        self.least, taken = None, 0
        for r in sizes:
            taken += r["m"]
            if taken > held:
                break
            self.least = r["least"]
        frequent = self.table.filter(F.col("n") >= self.least).collect() if self.least else []
        self.held = sorted(((bytes(r["word"]), r["n"]) for r in frequent), key=lambda x: (-x[1], x[0]))
        self.model = self.held[: words - 2]
        rest = self.tokens - self.documents - sum(n for _, n in self.model)
        self.rare_words = rows["v"] - len(self.model)
        self.rare_total = rest + self.rare_words + 1  # sum of c + 1, and 1 for all unseen words
        self.vocabulary = [rest + 1, self.documents, *(n for _, n in self.model)]

    def base(self, count: int) -> float:
        return log10((count + 1) / (self.tokens + self.distinct + 1))


def _encoded(docs: DataFrame, counts: Counts, document, held_out) -> DataFrame:
    """One row per document: word numbers with the end, sums of log10(c + 1), and its rarest words with how often they occur."""
    known = {w: i for i, (w, _) in enumerate(counts.held)}
    logs = np.array([log10(n + 1) for _, n in counts.held] + [0.0])
    model = len(counts.model)
    end_log = log10(counts.documents + 1)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, logs))
    small_batches(spark)
    schema = "document string, row long, held_out boolean, n_tokens long, ids binary, log_all double, log_rare double, n_rare long, n_held long, words array<binary>, times array<int>"

    def run(batches):
        release()
        known, logs = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            words, times = [], []
            for text in b.column("text"):
                tokens = words_of(text.as_py())
                places = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
                lost = np.flatnonzero(places < 0)
                found = Counter(tokens[i] for i in lost.tolist())
                few = places >= model
                ids = np.where((places >= 0) & ~few, places + 2, RARE).astype(np.uint16)
                values = logs[places]
                for column, x in zip(out, (len(tokens) + 1, np.append(ids, np.uint16(END)).tobytes(), values.sum() + end_log, values[few].sum(), len(lost) + int(few.sum()), len(tokens) - len(lost) + (end_log > 0))):
                    column.append(x)
                words.append(list(found))
                times.append(list(found.values()))
            columns = [b.column("document"), b.column("row"), b.column("held_out"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["document", "row", "held_out", "n_tokens", "ids", "log_all", "log_rare", "n_rare", "n_held", "words", "times"])
        release()

    rows = docs.select(document.alias("document"), F.monotonically_increasing_id().alias("row"), held_out.alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(run, schema)


def _averaged(parts: DataFrame, group: int = 16) -> bytes | None:
    """The mean of parameters by tokens; a task holds `group` of them."""

    def mean(table: pa.Table) -> pa.Table:
        total = sum(table.column("tokens").to_pylist())
        out = None
        order = sorted(range(len(table)), key=lambda i: table.column("part")[i].as_py())
        for i in order:
            x = np.frombuffer(table.column("net")[i].as_py(), np.float32) * np.float64(table.column("tokens")[i].as_py() / total)
            out = x if out is None else out + x
        part = min(table.column("part").to_pylist()) // group
        return pa.table([pa.array([part], pa.int64()), pa.array([total], pa.int64()), pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "net"])

    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while most > 0:
        parts = stash(parts.groupBy(F.floor(F.col("part") / group).alias("group")).applyInArrow(mean, "part long, tokens long, net binary"), "lm-average")
        most //= group
    return bytes(parts.first()["net"])


class Trained:
    """Counts, encoded texts and the network of a corpus."""

    def __init__(self, docs: DataFrame, held_out, id_column: str = "doc_id", words: int = 1024, width: int = 16, size: int = 32, held: int = 200_000, shard: int = 4_000_000, net: dict | None = None):
        self.counts = counts = Counts(docs.filter(~held_out).select(text_bytes()), words, held)
        self.encoded = stash(_encoded(docs, counts, F.col(id_column).cast("string"), held_out), "lm-encoded")
        self.start = Recurrent(counts.vocabulary, width, size)
        shards = max(1, round(counts.tokens / shard))
        training = self.encoded.filter("not held_out").select(F.pmod(F.xxhash64("ids", "document"), F.lit(shards)).alias("part"), "ids", "document")
        options = net or {}
        start, early = self.start, max(1, shards // 8)

        def learn(table: pa.Table) -> pa.Table:
            release()
            rows = sorted(zip(table.column("document").to_pylist(), table.column("ids").to_pylist()), key=lambda x: (x[0] or "", x[1]))
            np.random.default_rng(2).shuffle(rows)
            docs = [np.frombuffer(x, np.uint16) for _, x in rows]
            fresh = Recurrent(counts_vocabulary, width, size).unpack(given)
            data = learned(fresh, docs, **options).packed()
            out = pa.table([pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([sum(map(len, docs))], pa.int64()), pa.array([data], pa.binary())], names=["part", "tokens", "net"])
            release()
            return out

        counts_vocabulary, given = counts.vocabulary, start.packed()
        for stage in (F.col("part") < early, F.col("part") >= early):
            parts = stash(training.filter(stage).groupBy("part").applyInArrow(learn, "part long, tokens long, net binary"), "lm-shards")
            given = _averaged(parts) or given
        self.net = Recurrent(counts.vocabulary, width, size).unpack(given)

    def scores(self, chunk: int = 4_000_000) -> DataFrame:
        """document, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; a task lays out `chunk` tokens at a time."""
        counts, net = self.counts, self.net
        least = log10(counts.tokens + counts.distinct + 1)
        rare = log10(counts.rare_total)
        parameters, vocabulary, width, size = net.packed(), counts.vocabulary, net.width, net.size

        def run(batches):
            release()
            own = Recurrent(vocabulary, width, size).unpack(parameters)
            rows, docs, tokens = [], [], 0

            def told():
                batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(log10_of(own, docs))], names=["row", "said"])
                rows.clear(), docs.clear()
                return batch

            for b in batches:
                for row, ids in zip(b.column("row").to_pylist(), b.column("ids")):
                    rows.append(row)
                    docs.append(np.frombuffer(ids.as_py(), np.uint16))
                    tokens += len(docs[-1])
                    if tokens >= chunk:
                        yield told()
                        tokens = 0
            if rows:
                yield told()
            release()

        said = self.encoded.select("row", "ids").mapInArrow(run, "row long, said double")
        # words that tasks do not hold are looked up by a join; within a document they stand once
        lost = self.encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        rest = counts.table if counts.least is None else counts.table.filter(F.col("n") < counts.least)
        found = lost.join(rest, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_lost"), F.sum("times").alias("n_lost"))
        rows = self.encoded.select("row", "document", "held_out", "n_tokens", "log_all", "log_rare", "n_rare", "n_held").join(said, "row").join(found, "row", "left")
        more = F.coalesce("log_lost", F.lit(0.0))
        return rows.select(
            "document", "held_out", "n_tokens", (F.col("n_held") + F.coalesce("n_lost", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
            (F.col("log_all") + more - F.col("n_tokens") * least).alias("base_score"), (F.col("said") + F.col("log_rare") + more - F.col("n_rare") * rare).alias("score"),
        )


def language_model_scores(docs: DataFrame, held_out=None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    held_out: predicate of the rows that are not learned from; by default crc32 of the id as text, mod 7, is 2.
    """
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    kind = docs.schema["doc_id"].dataType
    return Trained(docs, held_out, **options).scores().select(F.col("document").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
