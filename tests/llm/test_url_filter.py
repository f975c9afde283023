import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarnwick.llm.queries import ORACLE_SQL, URL_RULES
from tarnwick.llm.url_filter import domain_of, suffix_of, url_verdicts

RULES = [(said, *text.partition("/")) for said, text in URL_RULES]


def brute_rule(url):
    """Host, path, rule and verdict of the rules alone."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(at + s + p), at + s + p, said) for said, at, s, p in RULES if (host == at or host.endswith("." + at)) and path.startswith(s + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://example.com/fr", "ftp://x.net/de/8", "http://example.net/de/88",
    "http://badexample.net/de/8", "http://org/es/", "http://a.org/es", "http://a.org?x=/es/", "http://a.org#/es/", "x://y://example.com/en/", "http://İ.com/en/", "http://com/en/\n",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad int")
    for r in url_verdicts(pages, none, URL_RULES).collect():
        host, path, rule, said = brute_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, said or "allow")


def names_of(host):
    """suffix and registered domain of a host."""
    parts = host.split(".")
    k = 2 if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in ("ac", "co", "com", "edu", "gov", "net", "org") else 1
    return ".".join(parts[-k:]), ".".join(parts[-k - 1 :])


def brute_posteriors(seen, hosts):
    """host -> (a, b) of its beta posterior, level by level from counts in dictionaries."""
    bad, n = Counter(h for h, x in seen if x), Counter(h for h, x in seen)
    overall = sum(bad.values()) / len(seen)

    def worth(groups):  # (bad, n, parent's mean)
        over = sum((x - k * m) ** 2 - k * m * (1 - m) for x, k, m in groups)
        pairs = sum(k * (k - 1) * m * (1 - m) for _, k, m in groups)
        return 1 / min(1 / 3, max(1 / 2001, over / pairs)) - 1 if pairs else 4000**0.5

    def rolled(level):
        x, k = Counter(), Counter()
        for h in n:
            x[level(h)] += bad[h]
            k[level(h)] += n[h]
        return x, k

    suffix, domain = (lambda h: names_of(h)[0]), (lambda h: names_of(h)[1])
    x, k = rolled(suffix)
    w = worth([(x[g], k[g], overall) for g in k])
    p_s = {g: (x[g] + w * overall) / (k[g] + w) for g in k}
    x, k = rolled(domain)
    w = worth([(x[g], k[g], p_s[suffix(g)]) for g in k])
    p_d = {g: (x[g] + w * p_s[suffix(g)]) / (k[g] + w) for g in k}
    w = worth([(bad[h], n[h], p_d[domain(h)]) for h in n])
    prior = {h: p_d.get(domain(h), p_s.get(suffix(h), overall)) for h in hosts}
    return overall, {h: (bad[h] + w * prior[h], n[h] - bad[h] + w * (1 - prior[h])) for h in hosts}


def beta_share_below(x, a, b):
    """P(Beta(a, b) < x), by sums over a fine grid of logits."""
    u = np.linspace(-60, 60, 240_001)
    log = a * -np.logaddexp(0, -u) + b * -np.logaddexp(0, u)
    f = np.exp(log - log.max())
    return float(f[u < np.log(x / (1 - x))].sum() / f.sum())


def test_reputation_of_hosts_that_differ(spark):
    rng = random.Random(5)
    shares = {"casino.spam.com": 0.9, "www.spam.com": 0.7, "www.good.org": 0.02, "few.good.org": 0.5, "news.example.co.uk": 0.1, "cheap.example.co.uk": 0.8, "shop.bad.net": 0.6, "a.net": 0.1}
    seen = [(h, int(rng.random() < p)) for h, p in shares.items() for _ in range(3 if h.startswith("few") else 60)]
    hosts = [*shares, "new.spam.com", "new.good.org", "other.net", "nowhere.xyz", ""]
    outcomes = spark.createDataFrame([(f"http://{h.upper()}/1", x) for h, x in seen] + [("http://casino.spam.com/2", None)], "url string, bad int")
    pages = spark.createDataFrame([(k, f"http://{h}/x") for k, h in enumerate(hosts)] + [(0, f"http://{hosts[0]}/x")], "page_id long, url string")
    got = url_verdicts(pages, outcomes, []).collect()
    assert len(got) == len(hosts) + 1
    overall, posterior = brute_posteriors(seen, hosts)
    for r in got:
        a, b = posterior[r.host]
        assert abs(r.p_host - a / (a + b)) < 1e-8
        if a >= 1:
            assert abs(beta_share_below(r.bound, a, max(b, 1)) - 0.05) < 0.02, (r.host, a, b)
        assert r.verdict == ("block" if r.bound > overall else "allow")
    verdicts = {r.host: r.verdict for r in got}
    assert {h for h, v in verdicts.items() if v == "block"} >= {"casino.spam.com", "www.spam.com", "cheap.example.co.uk"}
    assert all(verdicts[h] == "allow" for h in ("www.good.org", "few.good.org", "news.example.co.uk", "a.net", "new.good.org", "nowhere.xyz"))
    assert url_verdicts(pages.limit(0), outcomes, []).count() == 0
    strict = url_verdicts(pages, outcomes, [], limit=0.65).collect()
    assert {r.host for r in strict if r.verdict == "block"} == {r.host for r in got if r.bound > 0.65}


def test_hosts_that_differ_by_chance_only_are_not_blocked(spark):
    rng = random.Random(11)
    outcomes = spark.createDataFrame([(f"http://h{k % 40}.x{k % 7}.com/1", int(rng.random() < 0.2)) for k in range(2000)], "url string, bad int")
    pages = spark.createDataFrame([(k, f"http://h{k % 40}.x{k % 7}.com/") for k in range(280)], "page_id long, url string")
    assert {r.verdict for r in url_verdicts(pages, outcomes, []).collect()} == {"allow"}


def test_levels(spark):
    rows = spark.createDataFrame([("a.b.example.co.uk",), ("example.com",), ("com",), ("",), ("x.y.z",)], "h string")
    got = [tuple(r) for r in rows.select("h", domain_of(F.col("h")), suffix_of(F.col("h"))).collect()]
    assert got == [("a.b.example.co.uk", "example.co.uk", "co.uk"), ("example.com", "example.com", "com"), ("com", "com", "com"), ("", "", ""), ("x.y.z", "y.z", "z")]


def test_oracle_is_registered():
    assert "op9_url_filter" in ORACLE_SQL

