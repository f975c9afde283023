"""Secrets in texts, and who owns them.

Base findings come from three fixed patterns (assign, access, hex). A pattern alone says little:
examples from manuals match like live credentials. So the corpus decides. Candidates are the
values of base findings (what is assigned, the access key, the run of hex digits) and, outside
of those, prefixed keys, signed tokens, private keys, long mixed strings and assigned values too
short for the base, each only if it looks random. A candidate's hash is counted by distinct
repositories and owners over all texts: what several owners share is a widely copied example,
what one owner alone has is live-looking, in however many repositories. Each live candidate is
added as a span of kind "live"; base spans stay. A private key is hashed by its body and its span
reaches to its end; a header alone is hashed as it is.

The counts come from two aggregations whose keys are deduplicated on the map side, first by
(hash, owner, repository): a string copied into a third of all rows is a few rows per task.
Values travel as hashes only.

Defined results: null and empty texts have no spans and the SHA-256 of nothing; texts are
scanned whole; repeated rows are each reported, and copies within a repository count once;
null owners and repositories count as one owner and one repository, named by the empty string;
an empty table gives an empty result; further columns are not carried. redacted() carries them,
whatever their names, and passes over a missing column of lengths.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.common import arrow_rows, small_batches, stash, unused

KINDS = ("assign", "access", "hex", "live")
#: Characters of an assigned value from which it is a base finding, and from which it is a candidate.
BASE_CHARS, SHORT_CHARS = 12, 6
#: The base patterns. The last two are written with their least length, which for
#: greedy runs of one class finds the same spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What any assignment contains, in lower case; texts without these have none.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Forms of candidates that only the corpus can confirm.
CANDIDATE = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})*+(?:(?:\s|\\[nr])+[A-Za-z0-9+/]+={1,2})?)"
    r"|[A-Za-z0-9+/]{24,}={0,2}"
)
#: A signed web token begins so, with at least so many characters in each of three parts. Only the starts of runs are looked at, so that each run is read
#: three times at most however often the beginning stands in it.
WEB_TOKEN, PART_CHARS = "eyJ", 8
THREE_PARTS = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{11,}+)(\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+))")


#: What frames a private key and breaks its lines.
KEY_FRAME = re.compile(r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|\s+|\\[nr]|[\"']")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the base findings, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= BASE_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    """Digits with letters and at least three bits a character (2.5 below BASE_CHARS): not a word, a number or a filler."""
    if value.startswith("-----"):
        return True
    kinds = (any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value))
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))
    return sum(kinds) >= 2 and kinds[2] and bits >= (3 if n >= BASE_CHARS else 2.5)


def key_body(value: str) -> str:
    """What is counted of a candidate: a private key without header, end and line breaks, if anything is left."""
    return KEY_FRAME.sub("", value) or value if value.startswith("-----") else value


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Every place where a signed web token may begin, with its end, in order."""
    for m in THREE_PARTS.finditer(text):
        stop, at = m.end(1), text.find(WEB_TOKEN, m.start(1), m.end(1))
        while 0 <= at <= stop - len(WEB_TOKEN) - PART_CHARS:
            yield at, m.end(2)
            at = text.find(WEB_TOKEN, at + 1, stop)


def formed(text: str) -> Iterator[tuple[int, int]]:
    """Spans of candidates by form, leftmost first and without overlap; of a web token and another form at one place, the token."""
    if WEB_TOKEN not in text:
        yield from (m.span() for m in CANDIDATE.finditer(text))
        return
    at, tokens, m = 0, web_tokens(text), CANDIDATE.search(text)
    token = next(tokens, None)
    while m or token:
        if token and token[0] < at:
            token = next(tokens, None)
        elif m and m.start() < at:
            m = CANDIDATE.search(text, at)
        elif token and (m is None or token[0] <= m.start()):
            yield token
            at = token[1]
        else:
            yield m.span()
            at = m.end()


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of what only the corpus can judge: the base findings' values, and further forms outside of them.

    A private key may hold base findings; of several candidates with one place there is one.
    """
    starts, reach = [x[0] for x in taken], list(accumulate((x[2] for x in taken), max))  # reach: the farthest end so far
    found = {(end - len(value), end): value for _, _, end, value in taken}  # a base finding ends with its value
    for a, b in formed(text):
        k = bisect_left(starts, b)
        if k == 0 or reach[k - 1] <= a or text.startswith("-----", a):
            found[a, b] = key_body(text[a:b])
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found |= {m.span(2): m[2] for m in ASSIGN.finditer(text) if SHORT_CHARS <= len(m[2]) < BASE_CHARS}
    return [(a, b, v) for (a, b), v in sorted(found.items()) if looks_random(text[a:b])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Bytes of spans up to which they are broadcast, when they are put back to the texts.
BROADCAST_BYTES = 32 << 20
SCANNED = (
    "row long, doc_id long, key long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>,"
    " cand array<struct<start:int,end:int,hash:binary>>, owner string, repo string"
)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per text: base findings, and candidates by the hash of their value."""

    def run(batches):
        for b in batches:
            row, ids, key, texts, owners, repos = (b.column(k) for k in range(6))
            out = {"row": row, "doc_id": ids, "key": key, "owner": owners, "repo": repos} | {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "cand")}
            for t in texts.to_pylist():
                base = base_spans(t or "")
                spans = [x[:3] for x in base]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined(spans).encode()).hexdigest())
                out["base"].append([{"start": a, "kind": k, "end": e} for a, k, e in spans])
                out["cand"].append([{"start": a, "end": e, "hash": hashlib.sha256(v.encode()).digest()[:16]} for a, e, v in candidates(t or "", base)])
            yield out

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"), text(owner_col).alias("owner"), text(repo_col).alias("repo"))
    return arrow_rows(read, run, SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: distinct ones over all of `found` (hash, owner, repo)."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    max_owners: int = 1,
    max_repos: int | None = None,
) -> DataFrame:
    """row, doc_id, key (the text's xxhash64), n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, most_owners, all_spans of every text.

    A candidate is live if at most max_owners owners have it, and at most max_repos repositories if that is given; else it
    is shared. most_owners is the greatest number of owners of a candidate of the text, 0 without any.
    """
    scanned = stash(scan(docs, id_col, text_col, owner_col, repo_col), "secret-scan")
    found = scanned.select("row", "owner", "repo", F.explode("cand").alias("c")).select("row", "owner", "repo", "c.*")
    known = ownership(found.select("hash", "owner", "repo"))
    live = F.col("owners") <= max_owners
    known = known.withColumn("live", live if max_repos is None else live & (F.col("repos") <= max_repos))
    kind = F.lit(KINDS.index("live")).alias("kind")
    added = found.select("row", "hash", "start", "end").join(known, "hash").groupBy("row").agg(
        F.collect_list(F.when(F.col("live"), F.struct("start", kind, "end"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_shared"),
        F.max("owners").alias("most_owners"),
    )
    none = F.array().cast(T.ArrayType(scanned.schema["base"].dataType.elementType))
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_live", "n_shared", "most_owners")]
    base = ["row", "doc_id", "key", "n_assign", "n_access", "n_hex", "base_sha256"]
    return scanned.join(added, "row", "left").select(*base, text.alias("spans"), *numbers, spans.alias("all_spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]", **scan_options) -> DataFrame:
    """docs with every span of secret_spans replaced by the mark, and the column of text lengths, if there is one, set anew.

    Spans are put back by id and text hash. Their table is broadcast while its measured size is small, else
    both sides are shuffled by id and hash.
    """
    found = secret_spans(docs, id_col, text_col, **scan_options).filter(F.size("all_spans") > 0)
    id_, key, own = unused(docs.columns, 3)
    found = found.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key)).agg(F.first("all_spans").alias(own))
    found = stash(found, "secret-spans")
    rows, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size(own)), F.lit(0))).first()
    if 48 * rows + 24 * spans <= BROADCAST_BYTES:
        found = F.broadcast(found)
    at = docs[text_col]
    held = docs.join(found, docs[id_col].cast("long").eqNullSafe(found[id_]) & (F.xxhash64(at) == found[key]), "left").drop(id_, key)
    names, place = docs.columns, docs.columns.index(text_col)
    counted = names.index(chars_col) if chars_col in names else None
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            spans = b.column(len(names)).to_pylist()
            columns = [b.column(k) for k in range(len(names))]
            if any(spans):
                texts = [redact(t, [(x["start"], x["end"]) for x in s], mark) if s else t for t, s in zip(columns[place].to_pylist(), spans)]
                columns[place] = pa.array(texts, columns[place].type)
                if counted is not None:
                    counts = [len(t) if s else n for t, s, n in zip(texts, spans, columns[counted].to_pylist())]
                    columns[counted] = pa.array(counts, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.mapInArrow(run, docs.schema)
