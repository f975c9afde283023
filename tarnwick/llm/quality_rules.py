"""Quality rules: counts that fail outright, then distance to how a language usually looks.

One scan gives every text's base counts and two histograms: of character classes, and of the
common words of its language. The references are the mean histograms of texts that pass the base
rules, by language, and texts whose two histograms fall into one cell of a grid count once: exact
and near copies of a text, however many, weigh as one text. Languages without a word list share
one reference of character classes.
A text is kept if it passes the base rules and neither histogram is further from its reference
than a limit, by Jensen-Shannon distance (base 2, 0 to 1). A histogram of a short text is mostly
chance: the squared distance grows with one over the length, and so does the limit of the word
test below min_words words. Below a least length a test is passed over.

The scan's results, some 150 bytes a text, are stored; references and verdicts come from those.
One text of each cell, by least hash, is found with an aggregation that drops copies in each task
before they are shuffled; sums of those are again made in each task, and the driver's table has at
most len(COMMON_WORDS) + 1 references.

Defined results: a null or empty text has no words, fails the base rules and is not kept; texts
are read whole; repeated rows are each judged and count once for the reference; a null language
is one without word list; an empty table gives an empty result; without any passing text there is
no reference and the base rules alone decide; further columns are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import arrow_rows, keep_rows, stash

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Frequent function words of four languages.
COMMON_WORDS = {
    "de": "als auch auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu".split(),
    "en": "a and are as at be by for from he in is it not of on or that the this to was were with you".split(),
    "es": "al como con de del el en es la las lo los más no para pero por que se su sus un una y".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une".split(),
}
#: Character classes by byte: lower, upper, digit, space, sentence marks, symbols, other ASCII, beyond ASCII.
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "rest", "beyond")
MARKS = b".,;:!?'\"()-"


def class_table() -> np.ndarray:
    """The class of each byte; continuation bytes get a class of their own that is dropped."""
    kind = np.full(256, 6)
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), SPACE, MARKS, SYMBOLS + b"@\\^_`{}~[]=+/")):
        kind[list(members)] = k
    kind[128:] = 7
    kind[128:192] = 8
    return kind


KIND = class_table()


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in windows of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    odd = (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    sums = np.zeros(n, np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for k in range(width):
        sums += mixed[k : k + n] * odd[k]
    if np.unique(sums).size == n:  # equal windows have equal sums
        return 0
    codes = ids.astype(np.int64)  # exact: ranks of windows of 1, 2, 4 ... words from pairs of ranks
    w = 1
    while w < width:
        step = min(w, width - w)
        codes = np.unique(codes[:-step] * (len(words) + 1) + codes[step:], return_inverse=True)[1]
        w += step
    again = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: n][again] += 1
    np.subtract.at(edge, np.flatnonzero(again) + width, 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


PLACES = {lang: {w.encode(): k for k, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}


def histograms(text: bytes, n_words: int, lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the character classes, and of the language's common words and of all others."""
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(KIND, kinds, 9)[:8].astype(np.int32)
    place = PLACES.get(lang)
    if place is None:
        return classes, np.zeros(0, np.int32)
    hits = [k for k in map(place.get, text.lower().split()) if k is not None]
    seen = np.bincount(hits, minlength=len(place)) if hits else np.zeros(len(place), np.int64)
    return classes, np.append(seen, n_words - len(hits)).astype(np.int32)


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """The words and word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    letters = text.translate(None, SPACE)
    chars = len(letters) - int(((np.frombuffer(letters, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return words, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


SCANNED = (
    "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, classes array<int>, common array<int>"
)


def scan(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row per text with its base counts and histograms."""

    def run(batches):
        for b in batches:
            row, ids, langs, texts = b.column(0), b.column(1), b.column(2), b.column(3)
            out = {"row": row, "doc_id": ids, "lang": langs} | {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "common")}
            for lang, value in zip(langs.to_pylist(), texts):
                text = value.as_py()
                words, chars, symbols, lines, repeats = base_counts(text)
                n = len(words)
                for k, v in (("n_words", n), ("word_chars", chars), ("n_symbols", symbols), ("n_dup_lines", lines), ("n_repeat_words", repeats)):
                    out[k].append(v)
                out["base_failed"].append(base_fails(n, repeats))
                classes, common = histograms(text, n, lang)
                out["classes"].append(classes)
                out["common"].append(common)
            yield out

    read = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return arrow_rows(read, run, SCANNED)


#: Cells by share: of a character class, and of a common word. Near copies differ by less, other texts by more.
CLASS_CELLS, WORD_CELLS = 50, 25


def cell(classes: list[int], common: list[int]) -> bytes:
    """The grid cell of a text's two histograms."""
    shares = [np.rint(np.array(x) * (cells / max(1, sum(x)))) for x, cells in ((classes, CLASS_CELLS), (common, WORD_CELLS))]
    return np.concatenate(shares).astype(np.uint8).tobytes()


def one_of_each_cell(passed: DataFrame) -> DataFrame:
    """lang ("" for those without word list), classes, common of one text of each language and cell."""

    def run(batches):
        for b in batches:
            langs, classes, common = (c.to_pylist() for c in b.columns)
            yield {"lang": [x if x in COMMON_WORDS else "" for x in langs], "cell": list(map(cell, classes, common)), "classes": classes, "common": common}

    cells = arrow_rows(passed.select("lang", "classes", "common"), run, "lang string, cell binary, classes array<int>, common array<int>")
    least = F.min(F.struct(F.xxhash64("classes", "common").alias("hash"), "classes", "common")).alias("t")
    return cells.groupBy("lang", "cell").agg(least).select("lang", "t.classes", "t.common")


def references(scanned: DataFrame, min_words: int) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """By language (or "" for those without word list) the mean histograms of texts that pass the base rules, each cell once."""

    def run(batches):
        sums: dict[str, list] = {}
        for b in batches:
            for key, classes, common in zip(*(c.to_pylist() for c in b.columns)):
                at = sums.setdefault(key, [0, np.zeros(8), np.zeros(len(COMMON_WORDS.get(key, ())) + 1)])
                at[0] += 1
                at[1] += np.array(classes) / max(1, sum(classes))
                if key:
                    at[2] += np.array(common) / max(1, sum(common))
        yield {"lang": list(sums), "n": [x[0] for x in sums.values()], "classes": [x[1] for x in sums.values()], "common": [x[2] for x in sums.values()]}

    passed = one_of_each_cell(scanned.filter(~F.col("base_failed") & (F.col("n_words") >= min_words)))
    by_task = arrow_rows(passed, run, "lang string, n long, classes array<double>, common array<double>")
    whole = by_task.select("lang", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "classes", "common")).alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found: dict[str, dict[int, float]] = {}
    for r in whole.collect():  # at most len(COMMON_WORDS) + 1 languages of some 40 sums
        found.setdefault(r["lang"], {})[r["k"]] = r["v"]
    out = {}
    for lang, sums in found.items():
        v = np.array([sums[k] for k in range(len(sums))])
        out[lang] = (v[1:9] / v[0], v[9:] / v[0] if lang else None)
    return out


def js_distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row, a histogram of counts, to a reference."""
    p = rows / np.maximum(1, rows.sum(1, keepdims=True))
    q = np.broadcast_to(reference, p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
        return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


#: What one over the number of words adds to the squared distance that a text may have.
CHANCE = 5.0


def word_limits(n_words: np.ndarray, word_limit: float, min_words: int) -> np.ndarray:
    """The limit of the word distance by length: word_limit from min_words words on, more below."""
    n = np.maximum(1, n_words)
    return np.sqrt(word_limit**2 + CHANCE * np.maximum(0, 1 / n - 1 / max(1, min_words)))


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    class_limit: float = 0.3,
    word_limit: float = 0.28,
    min_chars: int = 100,
    min_words: int = 100,
    guard_words: int = 50,
) -> DataFrame:
    """row, doc_id, the base counts, base_failed, class_distance, word_distance (null: not tested) and kept.

    Below min_words words the word limit grows, and below guard_words the word test is passed over.
    """
    scanned = stash(scan(docs, id_col, text_col, lang_col), "quality-scan")
    known = references(scanned, 20)

    def run(batches):
        for b in batches:
            out = {n: b.column(n) for n in b.schema.names if n not in ("lang", "classes", "common")}
            langs = [x if x in COMMON_WORDS else "" for x in b.column("lang").to_pylist()]
            n_words = b.column("n_words").to_numpy()
            near, far = np.full(len(langs), np.nan), np.full(len(langs), np.nan)
            for lang in set(langs) & set(known):
                at = np.flatnonzero([x == lang for x in langs])
                classes = np.array([b.column("classes")[int(k)].as_py() for k in at])
                near[at] = np.where(classes.sum(1) >= min_chars, js_distance(classes, known[lang][0]), np.nan)
                if lang:
                    common = np.array([b.column("common")[int(k)].as_py() for k in at])
                    far[at] = np.where(n_words[at] >= guard_words, js_distance(common, known[lang][1]), np.nan)
            out["class_distance"] = [None if np.isnan(x) else float(x) for x in near]
            out["word_distance"] = [None if np.isnan(x) else float(x) for x in far]
            fine = ~(near > class_limit) & ~(far > word_limits(n_words, word_limit, min_words))  # not tested: passed over
            out["kept"] = fine & ~np.array(b.column("base_failed").to_pylist(), bool)
            yield out

    schema = "row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return arrow_rows(scanned, run, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", class_limit: float = 0.3, word_limit: float = 0.28, min_chars: int = 100, min_words: int = 100, guard_words: int = 50) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns: two scans and no shuffle of texts."""
    known = references(scan(docs.withColumn("_row", F.lit(0)), "_row", text_col, lang_col), 20)

    def predicate():
        def keep(batch):
            out = []
            for lang, value in zip(batch.column(lang_col).to_pylist(), batch.column(text_col)):
                text = (value.as_py() or "").encode()
                n = len(text.split())
                fine = not base_fails(n, repeated_words(text.split()))
                if fine and known:
                    classes, common = histograms(text, n, lang)
                    near, far = known.get(lang if lang in COMMON_WORDS else "", (None, None))
                    if near is not None and classes.sum() >= min_chars:
                        fine = js_distance(classes[None], near)[0] <= class_limit
                    if fine and far is not None and n >= guard_words:
                        fine = js_distance(common[None], far)[0] <= word_limits(n, word_limit, min_words)
                out.append(bool(fine))
            return out

        return keep

    return keep_rows(docs, predicate)
