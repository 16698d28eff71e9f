"""Url filter: fixed rules first, then the host's reputation by empirical Bayes.

Pages that a rule decides are labelled outcomes (blocked or not).  A host's rate of
blocked pages gets a beta prior centred on its registered domain's rate, that one on its
suffix's, that one on the rate of all; each is taken without the part below it, so no page
counts twice.  How strongly a level is drawn to the one above is learned: the spread of
the children's outcomes beyond a binomial gives the beta-binomial's overdispersion
(method of moments).  A host is blocked if the lower bound of its posterior rate reaches
the limit.  The bound is one-sided Chebyshev, ``mean - sd * sqrt(level / (1 - level))``,
which holds for whatever shape the posterior has.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

# FIXED VALUES: suffixes of two labels under which names are registered
TWO_LABEL_SUFFIXES = (
    "ac.uk co.uk gov.uk org.uk com.au net.au org.au co.nz org.nz co.jp ne.jp or.jp co.kr or.kr co.in org.in "
    "com.br org.br com.ar com.mx com.co com.tr com.cn org.cn com.hk com.tw com.sg co.za org.za co.il com.ua"
).split()

#: Rules as (action, host, path): the host and its subdomains, paths that start with the path.
Rule = tuple[str, str, str]
#: A key that holds at least one row in so many is joined by broadcast; there are at most so many such keys.
HEAVY = 1000
#: Overdispersion is kept between these, so a prior weighs 1/9 to 9,999 pages.
SPREAD = (0.0001, 0.9)
#: Overdispersion of a level that has no two children of two labelled pages or more.
UNKNOWN_SPREAD = 0.5


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; empty for null and without ``://``."""
    pattern = "://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def in_order(rules: list[Rule]) -> list[Rule]:
    """Longest first (host and path together; of equal length, the longer host, then a block)."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1:]))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``action, name`` of the longest rule that fits, else null.  The rules are a list, meant for some hundreds."""
    told = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("name")))
        for action, h, p in in_order(rules)
    ]
    return F.coalesce(*told, F.lit(None).cast("struct<action: string, name: string>"))


def domain_and_suffix(host: Column, two_label: list[str] | None = None) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port and user; an IP address is its own."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    number = bare.rlike(r"^[0-9.]*$|:|^\[")
    two = last(2).isin(*(TWO_LABEL_SUFFIXES if two_label is None else two_label))
    return F.when(number, bare).when(two, last(3)).otherwise(last(2)), F.when(number, bare).when(two, last(2)).otherwise(last(1))


def keyed_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """``left`` with the one row of ``right`` of its ``key``, however many rows of ``left`` share it.

    ``right.rows``: rows of ``left`` with the key.  Keys that hold a ``HEAVY``-th of them
    are at most ``HEAVY`` and go by broadcast; the others are joined by shuffle.  Both
    sides are read more than once (checkpointed).
    """
    heavy = right.where(F.col(rows) * HEAVY >= right.agg(F.sum(rows)).scalar())
    light = right.where(F.col(rows) * HEAVY < right.agg(F.sum(rows)).scalar())
    near = left.join(F.broadcast(heavy), key)
    far = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.hint("shuffle_merge"), key)
    return near.unionByName(far)


def _fitted(children: DataFrame, n: str, k: str, mean: str) -> float:
    """Pages that a prior of mean ``mean`` weighs, from the children's outcomes: two sums come to the driver."""
    p, pages, blocked = F.col(mean), F.col(n), F.col(k)
    several = pages > 1
    # two pages of one child agree beyond chance by spread * p * (1 - p); children count alike, however many pages they have
    beyond = F.sum(F.when(several, ((blocked - pages * p) * (blocked - pages * p) - pages * p * (1 - p)) / (pages * (pages - 1))))
    pairs = F.sum(F.when(several, p * (1 - p)))
    got = children.agg(beyond.alias("b"), pairs.alias("p"), F.sum(several.cast("int")).alias("m")).first()
    spread = got["b"] / got["p"] if (got["m"] or 0) > 1 and got["p"] else UNKNOWN_SPREAD
    return 1 / min(max(spread, SPREAD[0]), SPREAD[1]) - 1


def reputation(pages: DataFrame, host: str, blocked: str, level: float = 0.9) -> DataFrame:
    """One row a host: ``host, pages, labelled, bad, mean, sd, low, high``.

    ``blocked`` is a boolean column, null for pages without a label.  ``low`` and ``high``
    bound the posterior rate, each with probability ``level``.  A host without labelled
    pages has its prior; without any label at all the rate of all is one half.  A null
    host is the empty host.
    """
    prepare(pages.sparkSession)
    one = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(blocked).alias("o"))
    hosts = one.groupBy("host").agg(F.count("*").alias("pages"), F.count("o").alias("n"), F.count(F.when(F.col("o"), 1)).alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix}).checkpoint()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.count("*").alias("hosts")).checkpoint()
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"), F.count("*").alias("domains"))
    whole = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sk"), F.lit(0)).alias("k")).first()  # one row
    rest = (F.lit(whole["k"]) - F.col("sk") + 0.5) / (F.lit(whole["n"]) - F.col("sn") + 1)
    suffixes = suffixes.withColumn("root_mean", rest).checkpoint()
    s1 = _fitted(suffixes, "sn", "sk", "root_mean")
    domains = keyed_join(domains, suffixes, "suffix", "domains")
    domains = domains.withColumn("suffix_mean", (F.col("sk") - F.col("dk") + s1 * F.col("root_mean")) / (F.col("sn") - F.col("dn") + s1)).drop("domains", "suffix").checkpoint()
    s2 = _fitted(domains, "dn", "dk", "suffix_mean")
    hosts = keyed_join(hosts.drop("suffix"), domains, "domain", "hosts")
    hosts = hosts.withColumn("domain_mean", (F.col("dk") - F.col("k") + s2 * F.col("suffix_mean")) / (F.col("dn") - F.col("n") + s2)).select("host", "pages", "n", "k", "domain_mean").checkpoint()
    s3 = _fitted(hosts, "n", "k", "domain_mean")
    mean = (F.col("k") + s3 * F.col("domain_mean")) / (F.col("n") + s3)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s3 + 1))
    z = sqrt(level / (1 - level))
    told = hosts.withColumn("mean", mean).withColumn("sd", sd)
    return told.select("host", "pages", F.col("n").alias("labelled"), F.col("k").alias("bad"), "mean", "sd", (F.col("mean") - z * F.col("sd")).alias("low"), (F.col("mean") + z * F.col("sd")).alias("high"))


def judge(pages: DataFrame, rules: list[Rule], limit: float = 0.5, level: float = 0.9, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, labelled, bad, low, high`` of every page.

    A rule's action is the verdict of the pages it fits, and their outcome; the others
    are blocked if the lower bound of their host's rate reaches ``limit``.  ``labelled``,
    ``bad``, ``low`` and ``high`` are the host's (null where a rule decides).  Null urls
    and urls without ``://`` share the empty host, which is judged like any other.
    Repeated rows stay.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), *(c.alias(n) for c, n in zip(address(F.col(url)), ("host", "path"), strict=True)))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).checkpoint()
    outcome = F.col("r.action") == "block"
    hosts = reputation(rows.select("host", outcome.alias("bad")), "host", "bad", level).checkpoint()
    open_pages = rows.where("r is null").drop("r")
    told = keyed_join(open_pages, hosts.withColumnRenamed("pages", "rows"), "host", "rows")
    verdict = F.when(F.col("low") >= limit, "block").otherwise("allow")
    told = told.select("key", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "labelled", "bad", "low", "high")
    none = {c: F.lit(None) for c in ("labelled", "bad", "low", "high")}
    ruled = rows.where("r is not null").select("key", "host", "path", F.col("r.name").alias("rule"), F.col("r.action").alias("verdict"), *(v.cast(told.schema[c].dataType).alias(c) for c, v in none.items()))
    return ruled.union(told).withColumnRenamed("key", key)


def oracle(rules: list[Rule], limit: float = 0.5, level: float = 0.9) -> str:
    """The same verdicts in DuckDB's SQL."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in in_order(rules))
    action = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in in_order(rules))
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    number = r"regexp_matches(bare, '^[0-9.]*$|:|^\[')"

    def last(n: int) -> str:
        return f"array_to_string(l[greatest(1, len(l) - {n - 1}):], '.')"

    def strength(table: str, n: str, k: str, p: str) -> str:
        beyond = f"sum((({k} - {n} * {p}) * ({k} - {n} * {p}) - {n} * {p} * (1 - {p})) / ({n} * ({n} - 1))) FILTER ({n} > 1)"
        pairs = f"sum({p} * (1 - {p})) FILTER ({n} > 1)"
        spread = f"CASE WHEN count(*) FILTER ({n} > 1) > 1 AND {pairs} <> 0 THEN {beyond} / {pairs} ELSE {UNKNOWN_SPREAD} END"
        return f"(SELECT 1 / least(greatest({spread}, {SPREAD[0]}::DOUBLE), {SPREAD[1]}::DOUBLE) - 1 AS s FROM {table})"

    return f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
),
ruled AS MATERIALIZED (SELECT *, CASE {name} END AS rule, CASE {action} END AS action FROM parsed),
counted AS (SELECT host, count(action) AS n, count(*) FILTER (action = 'block') AS k FROM ruled GROUP BY host),
cut AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\\.+$', '', 'g') AS bare FROM counted),
labels AS (SELECT *, string_split(bare, '.') AS l FROM cut),
hosts AS MATERIALIZED (
  SELECT host, n, k, CASE WHEN {number} THEN bare WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain,
         CASE WHEN {number} THEN bare WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM labels
),
d0 AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM hosts GROUP BY domain, suffix),
s0 AS MATERIALIZED (
  SELECT *, (sum(sk) OVER () - sk + 0.5)::DOUBLE / (sum(sn) OVER () - sn + 1)::DOUBLE AS rm
  FROM (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d0 GROUP BY suffix)
),
s1 AS MATERIALIZED {strength("s0", "sn", "sk", "rm")},
d1 AS MATERIALIZED (SELECT d0.*, (sk - dk + s * rm) / (sn - dn + s) AS sm FROM d0 JOIN s0 USING (suffix), s1),
s2 AS MATERIALIZED {strength("d1", "dn", "dk", "sm")},
h1 AS MATERIALIZED (SELECT host, n, k, (dk - k + s * sm) / (dn - n + s) AS dm FROM hosts JOIN d1 USING (domain, suffix), s2),
s3 AS MATERIALIZED {strength("h1", "n", "k", "dm")},
post AS (SELECT host, n, (k + s * dm) / (n + s) AS mean, n + s + 1 AS size FROM h1, s3),
told AS (SELECT host, mean - {sqrt(level / (1 - level))!r} * sqrt(mean * (1 - mean) / size) AS low FROM post)
SELECT page_id, r.host, path, rule, coalesce(action, CASE WHEN low >= {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN told USING (host)"""
