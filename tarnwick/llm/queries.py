"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import table

#: The rules of op9.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer(), limit=512)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=1024, end_id=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents")).drop("row")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad of pages: the number in a page's path names its document; bad is its label, of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"://[^/?#]*/[^?#]*?([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)", 1).alias("number"))
    pages = pages.select("url", F.when(F.col("number") != "", F.col("number").cast("long")).alias("doc_id"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(bad.alias("bad"))
    return pages.join(labels, "doc_id").select("url", "bad")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.url_filter import url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.secret_scan import secret_spans

    return secret_spans(table(spark, sf_dir, "documents")).drop("row", "key", "all_spans")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.recurrent_lm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwick.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_model": op8_quality_model,
    "op9_url_filter": op9_url_filter,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_hard_negatives": op13_hard_negatives,
}


def _rounds_sql(rounds: int) -> str:
    """op11 in SQL: every round compares all vectors with all centroids."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, v, struct_extract(near, 'c') AS c, struct_extract(near, 'd') AS d FROM (SELECT r, v, min({{'d': (list_inner_product(v, v) - 2 * list_inner_product(v, s) + list_inner_product(s, s))::BIGINT, 'c': c}}) AS near FROM kept, c{n} GROUP BY r, v))""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT c, j, floor(sum(x)::DOUBLE / count(*)) AS x FROM (SELECT c, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{n}) GROUP BY c, j),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(list(x ORDER BY j) FILTER (x IS NOT NULL), any_value(s)) AS s FROM c{n} LEFT JOIN m{n} USING (c) GROUP BY c)""")
    return ",".join(steps)

def _license_sql() -> str:
    """op6 in SQL: lines of documents and of the known texts are brought to one form, units are put together and joined by digest."""
    from tarnwick.llm.license_scan import COMMENT_SIGNS, COPYRIGHT_LINE, KNOWN_TEXTS, SPELLINGS, TITLES

    text = lambda x: "'" + x.replace("'", "''") + "'"
    spelled = "concat(' ', replace({}, ' ', '  '), ' ')"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    spelled = f"trim(replace({spelled}, '  ', ' '))"
    many = lambda xs: ", ".join(map(text, xs))
    known = ", ".join(f"({text(i)}, {text(k)}, {text(t)})" for i, k, t in KNOWN_TEXTS)
    return f"""
WITH known(license_id, kind, text) AS (VALUES {known}),
texts AS (SELECT row_number() OVER () AS n, doc_id, NULL AS license_id, NULL AS kind, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, license_id, kind, text FROM known),
cut AS (SELECT n, string_split(lower(text), chr(10)) AS l FROM texts WHERE text IS NOT NULL),
lines AS (SELECT n, k, l[k] AS line FROM (SELECT n, l, unnest(generate_series(1, len(l))) AS k FROM cut)),
worded AS (SELECT n, k, line, CASE WHEN regexp_matches(line, {text(COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END AS words FROM lines),
formed AS (SELECT n, k, words, {spelled.format("words")} AS form, substr(ltrim(line, ' '), 1, 1) IN ({many(COMMENT_SIGNS)}) AS remark FROM worded),
titled AS (SELECT *, CASE WHEN form IN ({many(TITLES)}) THEN '' ELSE words END AS kept, k - row_number() OVER (PARTITION BY n, remark ORDER BY k) AS run FROM formed),
units AS (SELECT n, 'text' AS unit, string_agg(kept, ' ' ORDER BY k) FILTER (kept <> '') AS words FROM titled GROUP BY n
    UNION ALL SELECT n, 'comment', string_agg(kept, ' ' ORDER BY k) FILTER (kept <> '') FROM titled WHERE remark GROUP BY n, run HAVING count_if(words <> '') > 1
    UNION ALL SELECT n, 'line', words FROM titled WHERE words <> ''),
digests AS (SELECT n, unit, sha256({spelled.format("words")}) AS digest FROM units WHERE words <> ''),
wanted AS (SELECT digest, min({{'license_id': license_id, 'kind': kind}}) AS w FROM digests JOIN texts USING (n) WHERE n < 0 AND unit = 'text' GROUP BY digest)
SELECT doc_id, unit, w.license_id AS license_id, w.kind AS kind, digest, count(*) AS n_units FROM digests JOIN wanted USING (digest) JOIN texts USING (n) WHERE n > 0 GROUP BY n, doc_id, unit, w, digest
"""


#: SQL for DuckDB. The other operators of this subpackage follow algorithms that SQL does not express; tests/llm holds those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_join": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT r.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op6_license_scan": _license_sql(),
    "op11_centroid_clustering": f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v AS s FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16),{_rounds_sql(3)},
told AS (SELECT c, sum(d)::BIGINT AS own FROM a3 GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM told) AS inertia,
    sha256(array_to_string(list_transform(s, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a3 JOIN kept USING (r) JOIN told USING (c) JOIN c3 USING (c)
""",
    "op13_hard_negatives": """
WITH part AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
good AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS w FROM scored WHERE same QUALIFY w <= 5)
SELECT g.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY g.r, w ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM good g JOIN scored s ON g.r = s.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
""",
    "op10_secret_scan": r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
patterns(kind, pattern) AS (VALUES
    ('0assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('1access', 'AKIA[A-Z0-9]{14,}'), ('2hex', '[0-9a-f]{16,}'),
    ('other', 'gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-[^-]|--[^-]|---[^-])*-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]+={1,2})?)|[A-Za-z0-9+/]{24,}={0,2}')),
cut AS (SELECT n, kind, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps FROM docs, patterns),
hits AS (SELECT n, kind, hits[k] AS hit, sum(length(gaps[k])) OVER w + coalesce(sum(length(hits[k])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM (SELECT n, kind, hits, gaps, unnest(generate_series(1, len(hits))) AS k FROM cut) WINDOW w AS (PARTITION BY n, kind ORDER BY k)),
spans AS (SELECT n, kind, a, a + length(hit) AS e, CASE kind WHEN '0assign' THEN regexp_extract(hit, (SELECT pattern FROM patterns WHERE kind = '0assign'), 2) ELSE hit END AS value FROM hits),
base AS (SELECT * FROM spans WHERE (kind = '0assign' AND length(value) >= 12) OR kind IN ('1access', '2hex')),
found AS (
    SELECT DISTINCT n, e - length(value) AS a, e, value FROM base UNION
    SELECT n, e - length(value), e, value FROM spans WHERE kind = '0assign' AND length(value) BETWEEN 6 AND 11 UNION
    SELECT n, a, e, coalesce(nullif(CASE WHEN starts_with(value, '-----') THEN regexp_replace(value, '-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|\s+|\\[nr]|["'']', '', 'g') ELSE value END, ''), value)
    FROM spans s WHERE kind = 'other' AND (starts_with(value, '-----') OR NOT EXISTS (SELECT 1 FROM base b WHERE b.n = s.n AND b.a < s.e AND s.a < b.e))),
cand AS (SELECT found.*, docs.source FROM found JOIN docs USING (n) WHERE starts_with(substr(text, a::BIGINT + 1, 5), '-----') OR (
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND round(list_aggregate(string_split(value, ''), 'entropy'), 9) >= CASE WHEN length(value) >= 12 THEN 3 ELSE 2.5 END)),
owned AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM cand GROUP BY value),
judged AS (SELECT n, count_if(owners = 1) AS n_live, count_if(owners > 1) AS n_shared, max(owners) AS most_owners FROM cand JOIN owned USING (value) GROUP BY n),
every AS (SELECT n, kind, a, e FROM base UNION ALL SELECT n, '3live', a, e FROM cand JOIN owned USING (value) WHERE owners = 1),
listed AS (SELECT n, count_if(kind = '0assign') AS n_assign, count_if(kind = '1access') AS n_access, count_if(kind = '2hex') AS n_hex,
    string_agg(concat(substr(kind, 2), ':', a, ':', e), ',' ORDER BY a, kind, e) FILTER (WHERE kind <> '3live') AS base, string_agg(concat(substr(kind, 2), ':', a, ':', e), ',' ORDER BY a, kind, e) AS spans FROM every GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(most_owners, 0)::BIGINT AS most_owners
FROM docs LEFT JOIN listed USING (n) LEFT JOIN judged USING (n)
""",
    "op9_url_filter": r"""
WITH cut AS (
    SELECT page_id, url, instr(url, '://') AS place, substr(url, instr(url, '://') + 3) AS rest FROM pages
), read AS (
    SELECT page_id, url,
        translate(coalesce(CASE WHEN place > 0 THEN regexp_extract(rest, '^[^/?#]*', 0) END, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(CASE WHEN place > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END, '') AS path,
        TRY_CAST(nullif(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)', 1), '') AS BIGINT) AS doc_id
    FROM cut
), fits AS (
    SELECT read.*, r.rule, r.said,
        row_number() OVER (PARTITION BY read.page_id, read.url ORDER BY length(r.rule) DESC NULLS LAST) AS k
    FROM read LEFT JOIN (VALUES ('block', 'com', '/en/', 'com/en/'), ('allow', 'example.com', '/en/7', 'example.com/en/7'), ('allow', 'net', '/de/', 'net/de/'),
        ('block', 'example.net', '/de/8', 'example.net/de/8'), ('block', 'org', '/es/', 'org/es/')) AS r(said, site, below, rule)
    ON (read.host = r.site OR ends_with(read.host, '.' || r.site)) AND starts_with(read.path, r.below)
), bad AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), hosts AS (
    SELECT read.host, count(bad.bad) AS n, coalesce(sum(bad.bad), 0) AS b FROM read LEFT JOIN bad USING (doc_id) GROUP BY read.host
), labels_of AS (
    SELECT *, string_split(host, '.') AS l FROM hosts
), parts AS (
    SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS two FROM labels_of
), named AS (
    SELECT host, n, b, array_to_string(l[-two:], '.') AS suffix, array_to_string(l[-(two + 1):], '.') AS domain FROM parts
), overall AS (SELECT coalesce(sum(b)::DOUBLE / nullif(sum(n), 0), 0) AS pa FROM named
), s0 AS (SELECT suffix, sum(b) AS b, sum(n) AS n FROM named GROUP BY suffix HAVING sum(n) > 0
), ws AS (SELECT coalesce(1 / greatest(1 / 2001.0::DOUBLE, least(1 / 3.0::DOUBLE, sum((b - n * pa) ** 2 - n * pa * (1 - pa)) / nullif(sum(n * pa * (1 - pa) * (n - 1)), 0))) - 1, sqrt(4000.0::DOUBLE)) AS w FROM s0, overall
), s1 AS (SELECT suffix, (b + w * pa) / (n + w) AS ps FROM s0, overall, ws
), d0 AS (SELECT domain, suffix, sum(b) AS b, sum(n) AS n FROM named GROUP BY domain, suffix HAVING sum(n) > 0
), wd AS (SELECT coalesce(1 / greatest(1 / 2001.0::DOUBLE, least(1 / 3.0::DOUBLE, sum((b - n * ps) ** 2 - n * ps * (1 - ps)) / nullif(sum(n * ps * (1 - ps) * (n - 1)), 0))) - 1, sqrt(4000.0::DOUBLE)) AS w FROM d0 JOIN s1 USING (suffix)
), d1 AS (SELECT domain, (b + w * ps) / (n + w) AS pd FROM d0 JOIN s1 USING (suffix), wd
), wh AS (SELECT coalesce(1 / greatest(1 / 2001.0::DOUBLE, least(1 / 3.0::DOUBLE, sum((b - n * pd) ** 2 - n * pd * (1 - pd)) / nullif(sum(n * pd * (1 - pd) * (n - 1)), 0))) - 1, sqrt(4000.0::DOUBLE)) AS w FROM named JOIN d1 USING (domain) WHERE n > 0
), h1 AS (SELECT host, pa, b + w * coalesce(pd, ps, pa) AS x, n - b + w * (1 - coalesce(pd, ps, pa)) AS y FROM named LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), overall, wh
), h2 AS (SELECT host, pa, x, y, greatest(y, 1) AS g, 1 / (2 * x - 1) AS p, 1 / (2 * greatest(y, 1) - 1) AS q FROM h1
), h3 AS (SELECT *, 2 / (p + q) AS h, (1.645::DOUBLE * 1.645::DOUBLE - 3) / 6 AS lo FROM h2
), rated AS (SELECT host, pa, x / (x + y) AS p_host, CASE WHEN x >= 1 THEN x / (x + g * exp(2 * (1.645::DOUBLE * sqrt(h + lo) / h - (q - p) * (lo + 5 / 6.0::DOUBLE - 2 / (3 * h))))) ELSE 0 END AS bound FROM h3)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound > pa THEN 'block' ELSE 'allow' END) AS verdict, round(p_host, 9) AS p_host, round(bound, 9) AS bound
FROM fits JOIN rated USING (host) WHERE k = 1
""",
}
