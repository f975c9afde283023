"""Token counts by prefix dynamic programming.

For a byte-level BPE vocabulary every prefix of a piece of text has one last token, the only
one that ends the prefix and is compatible with the last token of what stands before it. So
one pass over a piece gives the last token and the exact count of every prefix. Those tables
are kept by piece; a text is a row of pieces with cumulated counts, and count_at(), fit() and
the counts of all prefixes are answered from them without encoding anything again.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts are counted
whole; repeated rows are each counted; rows keep their doc_id, also a null one; an empty table
gives an empty result. Other columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import arrow_rows, holds

#: Pieces of one generation of a worker's tables, some 100 bytes each; two generations are kept.
KEPT_PIECES = 400_000
KEPT_PAIRS = 1_000_000
#: Characters of a piece up to which its table, or its ids, are kept: what workers keep is then bounded in bytes too.
KEPT_CHARS = 256
#: The count of a whole piece, last in its table.
whole = itemgetter(-1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter: byte.

    Rule: printable Latin-1 bytes stand for themselves, the rest for the letters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Up to this letter the pattern below and the library agree; beyond it their Unicode versions differ on some letters.
KNOWN_LETTERS = 0x557


def letters_of(major: str) -> str:
    """The characters of a Unicode major category ("Z": white space) up to KNOWN_LETTERS, as the inside of a character class."""
    def fits(c):
        return (c.isspace() and not "\x1c" <= c <= "\x1f") if major == "Z" else unicodedata.category(c)[0] == major

    points = [k for k in range(KNOWN_LETTERS + 1) if fits(chr(k))]
    starts = [k for k in points if k - 1 not in set(points)]
    ends = [k for k in points if k + 1 not in set(points)]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


class Splitter:
    """Splits texts into the pieces that a byte-level tokenizer never merges across."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        letters, numbers, space = letters_of("L"), letters_of("N"), letters_of("Z")
        # the usual alternatives, that of words first: they begin with different characters
        pattern = rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
        self.plain = re.compile(pattern).findall
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.plain(text)
        except UnicodeEncodeError:
            if ord(max(text)) <= KNOWN_LETTERS:
                return self.plain(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]


class PrefixCounter(Splitter):
    """Exact token counts of every prefix of a text, for a byte-level BPE file of tokenizers."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_letters()
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in byte_of for c in s)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.tables: dict[str, bytes | list[int]] = {}
        self.older: dict[str, bytes | list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a piece by repeated merging of its lowest-ranked pair."""
        parts = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank[p] for p in zip(parts, parts[1:]) if p in self.rank), default=None)
            if best is None:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and self.rank.get((parts[k], parts[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when they stand side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def byte_table(self, data: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of one piece, by dynamic programming over prefixes."""
        n = len(data)
        last, counts, ids, pairs, longest = [-1] * (n + 1), [0] * (n + 1), self.ids, self.pairs, self.longest
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                part = data[j:i]
                if part in ids:
                    token = ids[part]
                    if j == 0 or (pairs[last[j], token] if (last[j], token) in pairs else self.compatible(last[j], token)):
                        last[i], counts[i] = token, counts[j] + 1
                        break
        return counts

    def table(self, piece: str) -> bytes | list[int]:
        """counts[k]: tokens of the first k characters of a piece, each prefix split as a text of its own."""
        known = self.tables.get(piece)
        if known is None:
            known = self.older.get(piece)
            if known is None:
                counts = self.byte_table(piece.encode())
                if not piece.isascii():
                    at, ends = 0, [0]
                    for c in piece:
                        at += len(c.encode())
                        ends.append(at)
                    counts = [counts[e] for e in ends]
                if piece in ("'ll", "'ve", "'re"):  # two letters of them are two pieces
                    counts = [0, 1, 2, counts[3]]
                known = bytes(counts) if max(counts) < 256 else counts
            if len(piece) > KEPT_CHARS:
                return known
            if len(self.tables) >= KEPT_PIECES:
                self.tables, self.older = {}, self.tables
            self.tables[piece] = known
        return known

    def prefixes(self, text: str | None) -> "TextPrefixes":
        return TextPrefixes(self, text or "")

    def count(self, text: str | None) -> int:
        return self.prefixes(text).n_tokens


class TextPrefixes:
    """A text as pieces with cumulated counts; answers for any prefix of it."""

    def __init__(self, of: PrefixCounter, text: str):
        self.of, self.text = of, text
        self.long: dict[str, bytes | list[int]] = {}  # tables of long pieces, which the worker does not keep
        words, special = [], []
        if of.special_re is None or not any(s in text for s in of.special):
            words = of.pieces(text)
        else:
            at = 0
            for m in of.special_re.finditer(text):
                words += of.pieces(text[at : m.start()])
                special.append(len(words))
                words.append(m[0])
                at = m.end()
            words += of.pieces(text[at:])
        self.words, self.special = words, set(special)
        try:
            counts = list(map(whole, map(of.tables.__getitem__, words)))
        except KeyError:
            counts = [whole(self._table(w)) for w in words]
        for k in special:
            counts[k] = 1
        self.counts = counts
        self.n_tokens = sum(counts)
        self._ends = self._sums = None

    def _table(self, piece: str) -> bytes | list[int]:
        if len(piece) <= KEPT_CHARS:
            return self.of.table(piece)
        if piece not in self.long:
            self.long[piece] = self.of.table(piece)
        return self.long[piece]

    def _index(self) -> None:
        if self._ends is None:
            self._ends = np.cumsum([0, *map(len, self.words)])
            self._sums = np.cumsum([0, *self.counts])

    def _segment(self, k: int) -> int:
        """The piece after the last special token before piece k."""
        return max((s + 1 for s in self.special if s < k), default=0)

    def count_at(self, p: int) -> int:
        """Tokens of the first p characters."""
        self._index()
        k = int(np.searchsorted(self._ends, p, side="left")) - 1  # piece k covers (ends[k], ends[k+1]]
        if p <= 0:
            return 0
        if k in self.special:
            if p == self._ends[k + 1]:
                return int(self._sums[k + 1])
            first = self._segment(k)  # part of a special string is plain text and joins what stands before it
            start = int(self._ends[first])
            return int(self._sums[first]) + sum(self._table(w)[-1] for w in self.of.pieces(self.text[start:p]))
        before = k - 1
        if before >= 0 and before not in self.special and self.words[before].isspace() and p == self._ends[k] + 1 and self.text[p - 1].isspace():
            # the end of a run of white space, whose last character the whole text gives to the next piece
            start = int(self._ends[before])
            return int(self._sums[before]) + sum(self._table(w)[-1] for w in self.of.pieces(self.text[start:p]))
        return int(self._sums[k]) + self._table(self.words[k])[p - int(self._ends[k])]

    def all_counts(self) -> list[int]:
        """Tokens of every prefix, from that of no character to the whole text."""
        return [self.count_at(p) for p in range(len(self.text) + 1)]

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens."""
        if self.n_tokens <= budget:
            return len(self.text)
        if budget <= 0:
            return 0
        self._index()
        k = bisect_left(self._sums, budget)  # whole pieces before k have fewer tokens than budget: no later piece can begin
        top = min(len(self.text), int(self._ends[min(k, len(self.words))]) + 1)
        if any(s >= k - 1 for s in self.special):  # a special string joins what stands before it until it is whole
            top = min(len(self.text), top + max(map(len, self.of.special)))
        p = top
        while p > 0 and self.count_at(p) > budget:
            p -= 1
        return p


_counters: dict[str, PrefixCounter] = {}
holds("prefixes", _counters.clear)


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a file; its tables stay from task to task."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_prefixes: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) and fit_chars, the characters that fit limit.

    with_prefixes adds prefix_tokens, the count of every prefix (an int for each character).
    One scan, no shuffle; special strings in texts count as the tokenizer's default has it.
    """

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            out = {"doc_id": ids, "n_bytes": [], "n_tokens": [], "over_limit": [], "fit_chars": []}
            rows = []
            for t in texts:
                x = count.prefixes(t)
                out["n_bytes"].append(len((t or "").encode()))
                out["n_tokens"].append(x.n_tokens)
                out["over_limit"].append(x.n_tokens > limit)
                out["fit_chars"].append(x.fit(limit))
                if with_prefixes:
                    rows.append(x.all_counts())
            yield out | ({"prefix_tokens": rows} if with_prefixes else {})

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * with_prefixes
    return arrow_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema, keep="prefixes")
