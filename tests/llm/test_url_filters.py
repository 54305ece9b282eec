import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallywright.llm import url_filters as uf

PAGES = "page_id long, url string, html string, host int, rule string, key string"


def split(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")


def ruled(host, path, rules):
    fits = [(rule, verdict) for verdict, rule in rules if (name := rule.partition("/")[0]) == host or host.endswith(f".{name}") if path.startswith(rule[len(rule.partition("/")[0]):])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def weight(groups):
    groups = [(n, k) for n, k in groups if n >= 2]
    if not groups:
        return uf.USUAL
    m1 = sum(math.floor(k / n * 1e9) for n, k in groups) / len(groups) / 1e9
    m2 = sum(math.floor(k * (k - 1) / (n * (n - 1)) * 1e9) for n, k in groups) / len(groups) / 1e9
    return uf.STRONGEST if m2 <= m1 * m1 else min(uf.STRONGEST, max(uf.WEAKEST, (m1 - m2) / (m2 - m1 * m1)))


def bounds(outcomes):
    """{host: lower bound} from [(host, bad)], summed up one host at a time; hosts are label.domain.suffix."""
    hosts = {}
    for host, bad in outcomes:
        n, k = hosts.get(host, (0, 0))
        hosts[host] = (n + (bad is not None), k + bool(bad))
    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    total = lambda keep: tuple(map(sum, zip(*([(0, 0)] + [v for h, v in hosts.items() if keep(h)]))))
    wh, wd = weight(hosts.values()), weight([total(lambda h: domain(h) == d) for d in {domain(h) for h in hosts}])
    ws, out = weight([total(lambda h: suffix(h) == s) for s in {suffix(h) for h in hosts}]), {}
    for host, (n, k) in hosts.items():
        (dn, dk), (sn, sk), (tn, tk) = total(lambda h: domain(h) == domain(host)), total(lambda h: suffix(h) == suffix(host)), total(lambda h: True)
        s = (ws * (tk - sk + 1) / (tn - sn + 2) + sk - dk) / (ws + sn - dn)
        d = (wd * s + dk - k) / (wd + dn - n)
        r = (wh * d + k) / (wh + n)
        out[host] = r - uf.DEVIATIONS * math.sqrt(r * (1 - r) / (wh + n + 1))
    return out


URLS = [
    None, "", "no scheme", "mailto:x@example.org", "http://", "HTTP://WWW.Example.ORG/ES/1", "https://example.org/es/2?q=://evil.com/de/", "https://a.example.org/es", "https://notexample.org/es/3",
    "https://example.org/en/1", "https://example.org/en/19", "https://example.org/en/2", "https://example.org", "https://example.org?x", "https://b.com/fr/1#/de/", "https://b.com/de/", "https://com/de/x",
    "x://y://z/", "https://ÄB.com/de/", "https://b.com:80/de/1", "https://b.net/\nline/4", "//b.com/de/", "http:///de/1", "https://b.com/de%2F",
]


def test_hosts_paths_and_rules_by_plain_python(spark):
    rows = [(i, u, "h", 1, "r", "k") for i, u in enumerate(URLS)] + [(None, URLS[9], None, 1, "", ""), (3, URLS[9], None, 1, "", "")]
    none = spark.createDataFrame([], "key long, bad boolean")
    got = uf.judge(spark.createDataFrame(rows, PAGES), none, F.lit(None).cast("long"))
    key = lambda r: (r[0] is not None, *map(str, r))
    want = []
    for i, url, *_ in rows:
        rule, verdict = ruled(*split(url), uf.RULES)
        want.append((i, *split(url), rule, verdict or "allow"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_rules_of_one_length_and_none_at_all(spark):
    one = spark.createDataFrame([("x.a.io", "/p/q")], "host string, path string")
    judged = lambda rules: one.select(uf.matching_rule(F.col("host"), F.col("path"), rules).alias("m")).first()["m"]
    assert judged([("allow", "io/p/q"), ("block", "a.io/p")])["rule"] == "a.io/p"  # of one length
    assert judged([("allow", "a.io/p"), ("block", "a.io/p")])["verdict"] == "block"
    assert judged([]) is None


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.example.co.uk", "example.co.uk", "co.uk"), ("example.co.uk", "example.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("www.example.net", "example.net", "net"), ("net", "net", "net"),
    ("", "", ""), ("user@www.example.com:8080", "example.com", "com"), ("192.0.2.7", "192.0.2.7", "192.0.2.7"), ("[::1]:80", "[::1]", "[::1]"), ("example.com.", "example.com", "com"),
])
def test_registered_domains(spark, host, domain, suffix):
    got = spark.createDataFrame([(host,)], "host string").select(uf.domain_of(F.col("host")), uf.suffix_of(F.col("host"))).first()
    assert tuple(got) == (domain, suffix)


def test_verdicts_of_hosts_by_plain_python(spark):
    rng = random.Random(2)
    share = {"bad.one.net": 0.97, "worse.one.net": 1.0, "fine.one.net": 0.05, "a.two.net": 0.1, "b.two.net": 0.0, "c.three.info": 0.6, "few.three.info": 1.0}
    size = {"few.three.info": 2}
    pages, outcomes = [], []
    for host, rate in share.items():
        for _ in range(size.get(host, 60)):
            pages.append((len(pages), f"https://{host}/x/{len(pages)}", "", 1, "", ""))
            outcomes.append((host, None if rng.random() < 0.3 else rng.random() < rate))
    pages.append((9_999, "https://new.one.net/x/", "", 1, "", ""))
    outcomes.append(("new.one.net", None))
    known = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(outcomes)] + [(None, True), (123_456, True)], "key long, bad boolean")
    number = F.expr("try_cast(nullif(regexp_extract(path, '^/x/([0-9]+)', 1), '') AS BIGINT)")
    frame = spark.createDataFrame(pages, PAGES)
    want = bounds(outcomes)
    sites = uf.host_outcomes(frame.select(uf.host_of(F.col("url")).alias("host"), uf.path_of(F.col("url")).alias("path")).select("host", number.alias("key")), known)
    for r in uf.reputation(sites).collect():
        assert math.isclose(r["bound"], want[r["host"]], rel_tol=1e-9)
    got = {split(r["host"] and f"://{r['host']}")[0]: r["verdict"] for r in uf.judge(frame, known, number).collect()}
    assert got == {host: "block" if bound > uf.MOST_BAD else "allow" for host, bound in want.items()}
    assert got["worse.one.net"] == "block" and got["new.one.net"] == "allow"


def test_few_bad_pages_among_good_hosts_do_not_block(spark):
    sites = [(f"h{i}.one.net", 40, i % 4) for i in range(12)] + [("few.one.net", 2, 2), ("many.one.net", 200, 190)]
    bound = {r["host"]: r["bound"] for r in uf.reputation(spark.createDataFrame(sites, "host string, n long, bad long")).collect()}
    assert bound["few.one.net"] < uf.MOST_BAD < bound["many.one.net"]


def test_empty_table_and_very_long_url(spark):
    known = spark.createDataFrame([(1, True)], "key long, bad boolean")
    frame = spark.createDataFrame([(1, "https://b.com/de/" + "y" * 300_000, "", 1, "", "")], PAGES)
    assert uf.judge(frame.limit(0), known, F.lit(1).cast("long")).collect() == []
    assert [(r["rule"], len(r["path"])) for r in uf.judge(frame, known, F.lit(None).cast("long")).collect()] == [("com/de/", 300_004)]
