"""Url rules and host reputation against a plain version."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kindsort.llm import queries, reputation

RULES = queries.URL_RULES
SCHEMA = "page_id long, url string"


def plain_address(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def parts(host):
    bare = re.sub(r"^.*@|:[0-9]*$|\.+$", "", host)
    if re.search(r"^[0-9.]*$|:|^\[", bare):
        return bare, bare
    labels = bare.split(".")
    n = 2 if ".".join(labels[-2:]) in reputation.TWO_LABEL_SUFFIXES else 1
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def plain_low(outcomes, level=0.9):
    """{host: lower bound} from [(host, blocked or None)]."""
    def summed(key):
        out = {}
        for h, o in outcomes:
            n, k = out.get(key(h), (0, 0))
            out[key(h)] = (n + (o is not None), k + bool(o))
        return out

    hosts, domains, suffixes, whole = (summed(key) for key in (lambda h: h, parts, lambda h: parts(h)[1], lambda h: 0))
    total = whole.get(0, (0, 0))

    def weight(children):
        some = [(n, k, p) for n, k, p in children if n > 1]
        pairs = sum(p * (1 - p) for _, _, p in some)
        if len(some) < 2 or not pairs:
            return 1.0
        return 1 / min(max(sum(((k - n * p) ** 2 - n * p * (1 - p)) / (n * (n - 1)) for n, k, p in some) / pairs, 0.0001), 0.9) - 1

    root = {s: (total[1] - k + 0.5) / (total[0] - n + 1) for s, (n, k) in suffixes.items()}
    w = weight([(*suffixes[s], root[s]) for s in suffixes])
    upper = {d: (suffixes[d[1]][1] - k + w * root[d[1]]) / (suffixes[d[1]][0] - n + w) for d, (n, k) in domains.items()}
    w = weight([(*domains[d], upper[d]) for d in domains])
    mean = {h: (domains[parts(h)][1] - k + w * upper[parts(h)]) / (domains[parts(h)][0] - n + w) for h, (n, k) in hosts.items()}
    w = weight([(*hosts[h], mean[h]) for h in hosts])
    out = {}
    for h, (n, k) in hosts.items():
        m = (k + w * mean[h]) / (n + w)
        out[h] = m - math.sqrt(level / (1 - level)) * math.sqrt(m * (1 - m) / (n + w + 1))
    return out


def plain_verdicts(rows):
    seen = [(i, *(at := plain_address(u)), *plain_rule(*at)) for i, u in rows]
    low = plain_low([(h, None if a is None else a == "block") for _, h, _, _, a in seen])
    return [(i, h, p, r, a or ("block" if low[h] >= 0.5 else "allow")) for i, h, p, r, a in seen]


def some_urls(rng, n):
    hosts = ["www.example.com", "m.Example.COM", "a.example.net", "b.example.net", "shop.evil.net", "evil.net", "x.co.uk", "y.x.co.uk", "10.0.0.1", "user@z.example.org:8080", "org", "example.org.", "[::1]:80", "hot.example.net"]
    paths = ["/en/1", "/es/2", "/fr/", "/de/x?q=/en/", "", "/", "/es", "?a=://b/en/", "#t"]
    return [(i, f"http://{rng.choice(hosts if rng.random() < 0.6 else hosts[-1:])}{rng.choice(paths)}") for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_plain(make, folder, spark, seed):
    rows = some_urls(random.Random(seed), 400) + [(9001, None), (9002, ""), (9003, "nothing here"), (None, "ftp://net/es/x"), (9004, "://"), (9004, "://"), (9005, "a://b://net/es/"), (9006, "http://" + "n" * 100_000 + ".net/fr/" + "p" * 100_000)]
    got = queries.op12_url_filter(spark, folder(pages=make(rows, SCHEMA)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_verdicts(rows), key=str)


def test_longest_rule_wins_and_paths_count_from_the_host(make):
    urls = ["http://www.example.com/en/1", "http://m.www.example.com/en/1", "http://m.example.com/en/1", "http://example.com/en", "http://notexample.com/en/", "http://com/x", "http://com", "http://a.net/es/1", "http://a.net/x/es/1"]
    got = {r["url"]: r["rule"] for r in make([(u,) for u in urls], "url string").withColumn("r", reputation.rule_of(*reputation.address(F.col("url")), RULES)).selectExpr("url", "r.name as rule").collect()}
    assert [got[u] for u in urls] == ["www.example.com/en/", "www.example.com/en/", "example.com/en/", "com/", "com/", "com/", None, "net/es/", None]


def test_hosts_are_drawn_to_their_domain(make):
    bad = [(f"h{i}.bad.net", True) for i in range(30) for _ in range(5)]
    good = [(f"h{i}.good.net", False) for i in range(30) for _ in range(5)]
    some = [("new.bad.net", None), ("new.good.net", None), ("new.other.net", None), ("far.org", None)]
    rows = bad + good + some + [("own.third.net", False)] * 40
    by = {r["host"]: r for r in reputation.reputation(make(rows, "host string, bad boolean"), "host", "bad").collect()}
    assert by["new.bad.net"]["low"] > 0.5 and by["new.bad.net"]["labelled"] == 0
    assert by["new.good.net"]["high"] < 0.5 and by["own.third.net"]["mean"] < 0.1
    assert by["new.other.net"]["low"] < 0.5 < by["new.other.net"]["high"] and by["far.org"]["low"] < 0.5 < by["far.org"]["high"]
    want = plain_low(rows)
    assert all(by[h]["low"] == pytest.approx(want[h], abs=1e-9) for h in want)


def test_the_bound_holds_the_promised_share():
    """Monte Carlo: the posterior lies above ``low`` with at least the stated probability, for skewed shapes too."""
    rng = random.Random(3)
    for a, b in ((0.3, 0.2), (5, 1), (40, 3), (0.05, 2), (200, 150)):
        mean = a / (a + b)
        low = mean - 3 * math.sqrt(mean * (1 - mean) / (a + b + 1))
        assert sum(rng.betavariate(a, b) >= low for _ in range(4000)) >= 0.9 * 4000 - 60


def test_a_hot_host_is_joined_by_broadcast(make):
    left = make([(i, "hot" if i % 3 == 0 else f"h{i}") for i in range(6000)], "i long, host string").checkpoint()
    right = left.groupBy("host").count().withColumnRenamed("count", "rows").checkpoint()
    joined = reputation.keyed_join(left, right, "host", "rows")
    assert joined.count() == 6000 and joined.select("i").distinct().count() == 6000
    assert joined.where("host = 'hot'").select("rows").distinct().collect()[0][0] == 2000
    plan = joined._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_empty_tables_and_clashing_names(make):
    assert reputation.judge(make([], SCHEMA), RULES).collect() == []
    df = make([(1, "http://a.b/c")], SCHEMA).selectExpr("*", "'x' as host", "'y' as r", "'z' as verdict", "1 as key")
    (row,) = reputation.judge(df, RULES).collect()
    assert (row["page_id"], row["host"], row["path"], row["rule"], row["verdict"]) == (1, "a.b", "/c", None, "allow")
