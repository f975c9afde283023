from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from tarnwick.llm import recurrent_lm as R

SCHEMA = "doc_id long, text string"
SMALL = {"words": 24, "width": 6, "size": 4}


def held(i):
    return i is not None and crc32(str(i).encode()) % 7 == 2


def corpus(n=120, seed=0):
    """Sentences of two kinds that a state can tell apart: each kind has words of its own."""
    draw = np.random.default_rng(seed)
    kinds = (["ein", "Haus", "und", "der", "Baum"], ["a", "house", "and", "the", "tree"])
    return [(i, " ".join(draw.choice(kinds[i % 2], 30)) + (f" rare{i}" if i % 5 == 0 else "")) for i in range(n)]


def base(rows):
    words = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((-1 if i is None else i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 9)) for i, t in rows)


def scored(spark, rows, **options):
    return R.language_model_scores(spark.createDataFrame(rows, SCHEMA), **(SMALL | options))


@pytest.mark.parametrize("most_held", [200_000, 12, 0])
def test_base_columns_equal_plain_counts(spark, most_held):
    odd = [(500, None), (501, ""), (502, " \t\n "), (503, "É é Ab\x1cC AB\x1cc"), (504, "never seen " * 40), (505, "the"), (505, "the"), (None, "house"), (506, "zz" * 5000)]
    rows = corpus() + odd
    found = [((-1 if r["doc_id"] is None else r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in scored(spark, rows, held=most_held).collect()]
    assert sorted(found) == base(rows)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = corpus(400)
    found = [r for r in scored(spark, rows, net={"most": 4, "window": 8}).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found) * 0.9
    assert all(r["score"] < 0 for r in found)


def test_shards_are_averaged_and_results_do_not_depend_on_partitions(spark):
    rows = corpus(200)
    options = {"shard": 500, "net": {"most": 4, "window": 8}}
    one = R.language_model_scores(spark.createDataFrame(rows, SCHEMA).coalesce(1), **SMALL, **options)
    many = R.language_model_scores(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), **SMALL, **options)
    key = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    a, b = key(one), key(many)
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-4) for i in a)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert scored(spark, []).collect() == []
    only = next(i for i in range(100) if held(i))
    (row,) = scored(spark, [(only, "some words")]).collect()
    assert row["train_tokens"] == 0 and row["base_score"] == 0 and row["n_known"] == 0 and row["score"] <= 0


def test_further_columns_with_clashing_names(spark):
    rows = corpus(40)
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as document", "3 as held_out", "4 as ids", "5 as n_tokens")
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in df.collect())
    assert key(R.language_model_scores(more, **SMALL)) == key(scored(spark, rows))


def network(seed=3, n=10, width=4, size=3):
    net = R.Recurrent(list(range(n, 0, -1)), width, size, seed)
    draw = np.random.default_rng(seed)
    for name in net.NAMES[:4]:
        value = getattr(net, name)
        value[...] = draw.standard_normal(value.shape) * 0.5
    net.ww[...] = draw.standard_normal(net.ww.shape) * 0.5
    return net


def plain_score(net, doc):
    """One document, one word at a time, in doubles."""
    sigmoid = lambda x: 1 / (1 + np.exp(-2 * x))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    h, before, total, w = np.zeros(net.width), R.END, 0.0, net.width
    for word in doc:
        a = net.emb[before].astype(float) + h @ net.uh
        z, c = sigmoid(a[:w]), np.tanh(a[w:])
        h = z * h + (1 - z) * c
        g, k = divmod(int(word), net.size)
        total += np.log10(soft(net.cw @ h + net.cb)[g] * soft(net.ww[g] @ h + net.wb[g])[k])
        before = word
    return total


def test_whole_documents_in_streams_equal_one_word_at_a_time():
    net, draw = network(), np.random.default_rng(0)
    docs = [np.append(draw.integers(2, 10, n), R.END).astype(np.uint16) for n in (0, 1, 5, 70, 33, 2, 64, 31, 32, 9)]
    assert R.log10_of(net, docs, most=3, window=8) == pytest.approx([plain_score(net, d) for d in docs], rel=1e-4)


def test_words_share_a_total_of_one():
    net = network()
    h = np.random.default_rng(1).standard_normal((1, net.width)).astype(np.float32)
    p = np.exp(net.speak(np.repeat(h, 10, 0), np.arange(10), False))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_gradients_equal_differences():
    net, draw = network(), np.random.default_rng(5)
    given, target = draw.integers(0, 10, (6, 3)).astype(np.int32), draw.integers(0, 10, (6, 3)).astype(np.int32)
    fresh = np.ones((6, 3), np.float32)
    fresh[0], fresh[3, 1] = 0, 0
    h = draw.standard_normal((3, net.width)).astype(np.float32)

    def loss():
        out, *_ = net.states(given, fresh, h)
        return -net.speak(out.reshape(-1, net.width), target.ravel(), False).sum(dtype=float)

    out, before, gates = net.states(given, fresh, h)
    _, grads, dh = net.speak(out.reshape(-1, net.width), target.ravel(), True)
    grads |= net.back(dh.reshape(out.shape), given, fresh, before, gates)
    for name in net.NAMES:
        value = getattr(net, name)
        for place in zip(*(draw.integers(0, n, 6) for n in value.shape)):
            if name == "wb" and value[place] < -1e3:
                continue  # the class is not full
            kept, small = value[place], np.float32(1e-2)
            value[place] = kept + small
            up = loss()
            value[place] = kept - small
            down = loss()
            value[place] = kept
            assert grads[name][place] == pytest.approx((up - down) / 0.02, abs=2e-2), name
