import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwick.llm.token_counts import counter, token_counts
from tests.llm.common import documents, edge_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["'", "s", "re", "ll", " ", "  ", "\n", "é", "日本", "😀", "<|endoftext|>", "<|endof", "abc", "The", "1", "!", "...", "\u3000", "ing", "|>", "\u0558", "\x1c", "\x85", "²"]


def size(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=12)))
def test_every_prefix_and_budget(text):
    found = counter(PATH).prefixes(text)
    counts = [size(text[:k]) for k in range(len(text) + 1)]
    assert found.all_counts() == counts and found.n_tokens == counts[-1]
    for budget in (0, 1, 3, 7):
        assert found.fit(budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_table(spark):
    texts = edge_texts()
    got = {r.doc_id: r for r in token_counts(documents(spark, texts), PATH, limit=50, with_prefixes=True).collect()}
    for k, t in enumerate(texts):
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), size(t or ""), size(t or "") > 50)
        assert got[k].prefix_tokens[-1] == got[k].n_tokens and size((t or "")[: got[k].fit_chars]) <= 50
    assert token_counts(documents(spark, texts).limit(0), PATH).count() == 0
