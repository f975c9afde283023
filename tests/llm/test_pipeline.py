import random
import re

import corpus_pipeline
from tarnwick.llm.quality_rules import quality_verdicts
from tests.llm.common import documents, edge_texts, words
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_packing import check


def corpus():
    rng = random.Random(12)
    rows = [words(rng, rng.randrange(60, 200)) for _ in range(25)]
    rows += [rows[0], rows[1] + " more", " ".join(w + "$$$" for w in rows[2].split())]
    items = [" ".join(f"bench{rng.randrange(900)}" for _ in range(30)) for _ in range(3)]
    rows += [rows[3] + " and now for this " + words(rng, 40) + " " + items[0]]
    rows[5] += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    return [*rows, *edge_texts()], items


def test_stages_against_brute_force(spark, tmp_path):
    texts, items = corpus()
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in quality_verdicts(docs).collect() if r.kept}
    held = [(k, t) for k, t in enumerate(texts) if k in kept]
    held = [(k, t) for k, t in held if k in {d for d, _, c in components(held) if d == c}]
    held = [(k, t) for k, t in held if not any(i in t for i in items)]
    held = [(k, re.sub(r'token = "[0-9a-f]{40}', "[secret]", t)) for k, t in held]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {k for k, _ in held} and 5 in {k for k, _ in held} and 0 in {k for k, _ in held}
    places = {k: n for n, (k, _) in enumerate(held)}
    renamed = [type("R", (), r.asDict() | {"doc_id": places[r.doc_id]}) for r in rows]
    sequences, bound = check(renamed, [t for _, t in held], 1024)
    assert sequences <= bound + 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = documents(spark, edge_texts()).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema or stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_of_one_id_with_different_texts_are_told_apart(spark):
    rng = random.Random(7)
    a, b, c = (words(rng, 60) for _ in range(3))
    docs = documents(spark, [(3, a), (9, a), (9, b), (9, c), (9, c), (4, b + " more"), (None, a), (None, a), (12, None), (12, None), (11, "")])
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (4, b + " more"), (9, c), (None, a), (None, a), (12, None), (12, None), (11, "")], key=str)
