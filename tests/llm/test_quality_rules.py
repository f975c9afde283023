import math
import random
import re

from tarnwick.llm.quality_rules import COMMON_WORDS, base_counts, quality_filter, quality_verdicts
from tests.llm.common import documents, edge_texts, words


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for k in range(len(found) - 7):
        windows.setdefault(tuple(found[k : k + 8]), []).append(k)
    inside = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_against_brute_force():
    rng = random.Random(2)
    texts = [*edge_texts(), " ".join(rng.choice("abc") for _ in range(300)), "a b c d e f g h " * 3, "x " * 40, "p\n" + words(rng, 30) + "\np\n p"]
    for t in texts:
        found, *rest = base_counts((t or "").encode())
        assert (len(found), *rest) == brute(t)


def test_verdicts(spark):
    rng = random.Random(4)
    clean = [words(rng, 150) for _ in range(40)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in clean[k].split()) for k in range(3)]
    shout = [clean[4].upper().replace(" ", "!! ")]
    again = ["spam spam spam spam spam spam spam spam " * 10]
    texts = [*clean, *junk, *shout, *again, None, "", "short text here"]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (k < len(clean)), (k, r)
    kept = quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in got if got[k].kept] or {r.doc_id for r in kept.collect()} == {k for k in got if got[k].kept}
    assert quality_verdicts(docs.limit(0)).count() == 0 and quality_filter(docs.limit(0)).count() == 0


def classes_of(text):
    """Shares of the character classes, character by character."""
    kinds = {}
    for c in text:
        kind = (
            "beyond" if ord(c) > 127 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c in " \t\n\r\x0b\x0c"
            else "mark" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>@\\^_`{}~[]=+/" else "rest"
        )
        kinds[kind] = kinds.get(kind, 0) + 1
    return {k: v / len(text) for k, v in kinds.items()}


def common_of(text, lang):
    found = text.lower().split()
    shares = {w: found.count(w) / len(found) for w in COMMON_WORDS[lang]}
    return shares | {None: 1 - sum(shares.values())}


def mean_of(histograms):
    return {k: sum(h.get(k, 0) for h in histograms) / len(histograms) for k in {k for h in histograms for k in h}}


def distance(p, q):
    """Jensen-Shannon, by the entropies of both and of their middle."""
    entropy = lambda h: -sum(v * math.log2(v) for v in h.values() if v > 0)
    middle = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
    return math.sqrt(max(0.0, entropy(middle) - (entropy(p) + entropy(q)) / 2))


def test_distances_and_verdicts_against_brute_force(spark):
    rng = random.Random(21)
    rows, cells = [], set()
    while len(rows) < 60:
        lang = rng.choice(["en", "de", "xx", None])
        text = words(rng, rng.randrange(25, 220))
        shout, marked, signs = rng.random() * 0.6, rng.random(), rng.sample([",", "é", "7", "$", "~", "\x7f"], 3)
        text = " ".join((w.upper() if rng.random() < shout else w) + (rng.choice(signs) if rng.random() < marked else "") for w in text.split())
        text += " und der die" * rng.randrange(4) if lang == "de" else ""
        known = lang if lang in COMMON_WORDS else ""
        grid = known, *(frozenset((c, round(v * n)) for c, v in h.items() if round(v * n)) for h, n in ((classes_of(text), 50), (common_of(text, lang) if known else {}, 25)))
        if grid not in cells:  # each then counts for the reference
            cells.add(grid)
            rows.append((len(rows), text, lang))
    got = {r.doc_id: r for r in quality_verdicts(documents(spark, rows)).collect()}
    passed = [(t, lang if lang in COMMON_WORDS else "") for k, t, lang in rows if not got[k].base_failed]
    near = {lang: mean_of([classes_of(t) for t, x in passed if x == lang]) for lang in ("en", "de", "")}
    far = {lang: mean_of([common_of(t, lang) for t, x in passed if x == lang]) for lang in ("en", "de")}
    for k, t, lang in rows:
        r, lang, n = got[k], lang if lang in COMMON_WORDS else "", len(t.split())
        assert abs(r.class_distance - distance(classes_of(t), near[lang])) < 1e-6
        tested = bool(lang) and n >= 50
        assert (r.word_distance is not None) == tested
        limit = math.sqrt(0.28**2 + 5 * max(0, 1 / n - 1 / 100))
        wide = tested and abs(r.word_distance - distance(common_of(t, lang), far[lang])) < 1e-6 and r.word_distance > limit
        assert not tested or abs(r.word_distance - distance(common_of(t, lang), far[lang])) < 1e-6
        assert r.kept == (not r.base_failed and r.class_distance <= 0.3 and not wide)
    assert {r.doc_id for r in quality_filter(documents(spark, rows)).collect()} == {k for k in got if got[k].kept}


def test_edges(spark):
    texts = [(k, t, None if k % 2 else "xx") for k, t in enumerate(edge_texts())]
    assert quality_verdicts(documents(spark, texts)).count() == len(texts)
    assert quality_verdicts(documents(spark, [(None, "a"), (None, "a")])).count() == 2


def test_copies_of_junk_do_not_become_the_reference(spark):
    rng = random.Random(7)
    clean = [words(rng, 150) for _ in range(40)]
    junk = " | ".join(f"{rng.choice(['KX', 'QZ'])}{rng.randrange(10**6)}" for _ in range(150))
    near = [" | ".join([*junk.split(" | ")[:-1], f"KX{rng.randrange(10**6)}"]) for _ in range(20)]
    for copies in ([junk] * 20, near):  # a third of the rows
        docs = documents(spark, [*clean, *copies])
        assert {r.doc_id for r in quality_verdicts(docs).collect() if r.kept} == set(range(len(clean)))
        assert {r.doc_id for r in quality_filter(docs).collect()} == set(range(len(clean)))


def test_short_junk_is_tested_with_a_wider_limit(spark):
    rng = random.Random(8)
    clean = [words(rng, n) for n in [150] * 40 + [55, 65, 80, 95]]
    junk = [" | ".join(f"{rng.choice('abcdefgh')}{rng.choice('rstuvw')}ix{k}" for k in range(45)) for _ in range(2)]  # 89 words, none common
    docs = documents(spark, [*clean, *junk])
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert [k for k in got if not got[k].kept and k < len(clean)] == [] and all(got[len(clean) + k].word_distance > 0.28 for k in range(2))
    assert {k for k in got if got[k].kept} == set(range(len(clean))) == {r.doc_id for r in quality_filter(docs).collect()}
