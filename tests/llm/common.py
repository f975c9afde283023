"""Small document tables with the cases that every operator must take."""

import random

WORDS = "the of and to in is that for it was river stone light cloud paper window garden music silver engine north winter".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, batch string, piece string"


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, len(text or ""), "clash", "clash", "clash", "clash")


def documents(spark, texts):
    """A documents table with columns whose names clash with those that operators make."""
    return spark.createDataFrame([row(*t) if isinstance(t, tuple) else row(k, t) for k, t in enumerate(texts)], DOCS)


def edge_texts(seed=3):
    rng = random.Random(seed)
    long = words(rng, 6000)
    base = words(rng, 120)
    return [
        None, "", " \n\t ", "one", "two words", base, base, base.replace("the", "thee", 1), long, long + " tail",
        "Ünïcode — naïve café 日本語 😀 ſ K", "x" * 3000, "a\n\na\nA\n", "'re 'll don't", "<|endoftext|> here <|endof",
    ]
