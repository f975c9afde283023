import random
import zlib

import numpy as np

from tarnwick.llm.quality_model import STATISTICS, RuleModel, fit, grow, lasso, measured, quality_scores
from tests.llm.common import documents, edge_texts, words


def sample(n=300):
    rng = random.Random(8)
    texts, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.randrange(30, 120))
        texts.append(text if good else rng.choice([text.upper(), text.replace(" ", " | "), " ".join(w + "###" for w in text.split())]))
        labels.append((k, int(good), 0))
    return texts, labels


def test_held_out_accuracy_and_columns_equal_arrays(spark):
    texts, labels = sample()
    docs, known = documents(spark, texts), spark.createDataFrame([*labels, (0, None, 0), (10_000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, known).collect()}
    truth = {d: q for d, q, _ in labels}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    turned = known.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    assert {d: r.score for d, r in got.items()} == {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    x = np.array([[r[k] for k in STATISTICS] for r in measured(docs).orderBy("doc_id").collect()])
    y = np.array([q for _, q, _ in labels])
    model = fit(x, y)
    assert model.rules and len(model.rules) < 80
    column = [r.s for r in measured(docs).orderBy("doc_id").select(model.column().alias("s")).collect()]
    assert np.allclose(column, model.score(x))


def test_weights_are_those_of_the_penalised_regression():
    """At the least penalised loss a weight's gradient is the penalty against its sign, or smaller where the weight is 0."""
    rng = np.random.default_rng(2)
    z = rng.normal(size=(200, 6))
    y = (rng.random(200) < 1 / (1 + np.exp(-(1.5 * z[:, 0] - z[:, 3])))).astype(float)
    b, w = lasso(z, y, 0.05, 4000)
    error = 1 / (1 + np.exp(-(z @ w + b))) - y
    gradient = z.T @ error / len(y)
    assert abs(error.mean()) < 1e-6 and (w == 0).sum() >= 2 and w[0] > 0 > w[3]
    assert np.allclose(gradient[w != 0], -0.05 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(gradient[w == 0]) <= 0.05 + 1e-6).all()


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = rng.integers(0, 8, (40, 2)).astype(float)
        y = (x[:, rng.integers(2)] + rng.normal(0, 2, 40) > 4).astype(int)
        if y.min() == y.max():
            continue
        found = set()
        grow(x, y, 1, rng, (), found, 5)
        gini = lambda v: len(v) * v.mean() * (1 - v.mean())
        values = {f: np.unique(x[:, f]) for f in (0, 1)}
        tried = {(f, (a + b) / 2): gini(y[x[:, f] <= (a + b) / 2]) + gini(y[x[:, f] > (a + b) / 2]) for f in (0, 1) for a, b in zip(values[f], values[f][1:]) if 5 <= (x[:, f] <= (a + b) / 2).sum() <= 35}
        assert bool(found) == bool(tried)
        for rule in found:
            (name, _, bound), = rule.parts
            assert tried[STATISTICS.index(name), bound] <= min(tried.values()) + 1e-9


def test_bounded_sample_does_not_change_what_is_scored(spark):
    texts, labels = sample(400)
    docs, known = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, known, max_rows=120, tree_rows=50).collect()}
    held = [(got[d].predicted, q) for d, q, _ in labels if got[d].held_out]
    assert len(got) == 400 and np.mean([p == q for p, q in held]) > 0.9


def test_edges(spark):
    docs = documents(spark, [*enumerate(edge_texts()), (None, "x"), (1, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, none).collect()
    assert len(rows) == len(edge_texts()) + 2 and {round(r.score, 6) for r in rows} == {0.5}
    assert quality_scores(docs.limit(0), none).count() == 0
    assert isinstance(fit(np.zeros((4, len(STATISTICS))), np.ones(4)), RuleModel)
