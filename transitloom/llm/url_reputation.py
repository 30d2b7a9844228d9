"""URL filters: rules by host and path, and empirical-Bayes reputations of hosts for all other urls.

A host's pages with a labelled outcome, good or bad, give it a reputation: the posterior of its share of bad pages.

1. Outcomes are added up per host, registered domain and suffix (grouped sums, combined before they are exchanged).
2. A suffix is shrunk towards the share of all outcomes, a domain towards its suffix's posterior mean, a host
   towards its domain's: each level has a beta prior around the level above, whose weight in outcomes is estimated from the
   level's own spread by the moments of the beta-binomial distribution, between ``WEIGHTS``.
3. A host is blocked when it is bad beyond doubt: when the lower bound of its posterior, mean less ``SIGMAS`` standard
   deviations, exceeds ``LIMIT``. A host without outcomes has its domain's mean and a wide posterior, and is allowed.

Rules come first: a rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule wins, of equals the first by bytes. They are a list in the driver, ``MAX_RULES`` at most.

Verdicts are made per host and joined to the pages. The hosts that hold a thousandth of all pages or more, of which there
cannot be over a thousand, are broadcast; pages of any other host are joined by host.

The host is what stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path follows, up to ``?``, ``#`` or
the end. Null urls and urls without ``://`` have empty ones: they share the host "". For domains, user names and ports
are left out; an address of digits is its own domain, with the suffix "". Repeated rows are judged each. Empty tables give an empty
result or no outcomes (every host is allowed then). Extra columns are ignored.

The outcome of a page of the query: ``labels`` of the document whose number begins the last segment of the url's path; it is bad with quality 0
or toxic 1. A document that is labelled more than once is bad if any label says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, table, written

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 100_000
#: Suffixes of two names under which domains are registered; any other suffix is the last name.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "co.za", "com.br", "com.cn")
#: Share of bad pages that a host must exceed to be blocked, standard deviations below the mean, least and largest weight of a prior.
LIMIT, SIGMAS, WEIGHTS = 0.5, 1.645, (2.0, 10_000.0)
#: A host with more than one page in so many is joined by broadcast.
HOT = 1000

_HOST, _PATH, _NUMBER = r"^.*?://([^/?#]*)", r"^.*?://[^/?#]*([^?#]*)", "/([0-9]{1,18})[^/]*/?$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, f"(?s){_HOST}", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, f"(?s){_PATH}", 1), F.lit(""))


def document_of(path: Column) -> Column:
    """The number that begins a path's last segment, or null."""
    return F.regexp_extract(path, _NUMBER, 1).try_cast("bigint")


def _with_domain(hosts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]*$|^\[")
    last, two, three = (F.substring_index(name, ".", -n) for n in (1, 2, 3))
    double = two.isin(*suffixes)
    return hosts.withColumns(
        {
            "domain": F.when(address, name).when(double, three).otherwise(two),
            "suffix": F.when(address, F.lit("")).when(double, two).otherwise(last),
        }
    )


def _shrunk(level: DataFrame, name: str) -> DataFrame:
    """With ``{name}_mean``, the posterior mean of each row, and ``weight``, the prior's: level has n, bad and the prior's mean ``prior``."""
    own = F.col("prior") * (1 - F.col("prior"))
    moments = level.agg(
        F.coalesce(F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2 - F.col("n") * own), F.lit(0.0)).alias("excess"),
        F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) * own), F.lit(0.0)).alias("pairs"),
    )
    # the correlation of two outcomes of one unit is 1 / (weight + 1)
    apart = F.when(F.col("pairs") > 0, F.col("excess") / F.col("pairs")).otherwise(0.0)
    weight = F.when(apart <= 1 / (WEIGHTS[1] + 1), WEIGHTS[1]).when(apart >= 1 / (WEIGHTS[0] + 1), WEIGHTS[0]).otherwise(1 / apart - 1)
    rows = level.join(F.broadcast(moments.select(weight.alias("weight"))))  # one row
    return rows.withColumn(f"{name}_mean", (F.col("bad") + F.col("prior") * F.col("weight")) / (F.col("n") + F.col("weight")))


def reputations(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, limit: float = LIMIT, sigmas: float = SIGMAS) -> DataFrame:
    """From ``host, pages, n, bad`` (a row a host; n of its pages have an outcome): the same with domain, suffix, mean, bound and verdict."""
    hosts = _with_domain(outcomes, suffixes)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    levels = domains.groupBy("suffix").agg(*sums)
    everything = levels.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))  # one row
    levels = _shrunk(written(levels.join(F.broadcast(everything)), "suffix-outcomes"), "suffix")
    domains = domains.join(levels.select("suffix", F.col("suffix_mean").alias("prior")), "suffix")
    domains = _shrunk(written(domains, "domain-outcomes"), "domain")
    hosts = hosts.join(domains.select("domain", "suffix", F.col("domain_mean").alias("prior")), ["domain", "suffix"])
    hosts = _shrunk(written(hosts, "host-outcomes"), "host").withColumnRenamed("host_mean", "mean")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    bound = F.col("mean") - sigmas * spread
    return hosts.select("host", "domain", "suffix", "pages", "n", "bad", "mean", bound.alias("bound"), F.when(bound > limit, "block").otherwise("allow").alias("verdict"))


def _rules_by_host(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """host, rules: what fits the host by itself or as a subdomain."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, {MAX_RULES} at most")
    frame = hosts.sparkSession.createDataFrame([(h, h + p, p, v) for h, p, v in rules], "rule_host string, rule string, rule_path string, rule_verdict string")
    names = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    found = hosts.select("host", F.explode(parents).alias("rule_host")).join(F.broadcast(frame), "rule_host")
    rule = F.struct(F.length("rule").alias("size"), "rule", "rule_path", "rule_verdict")
    return found.groupBy("host").agg(F.collect_set(rule).alias("rules"))  # of a driver's list


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **options) -> DataFrame:
    """``pages(url, ...)`` with host, path, rule and verdict (and the host's mean and bound).

    outcomes: ``url string, bad boolean``, a row for every page whose outcome is known. Columns of pages that are named like those
    added are kept; the added ones then have a ``_`` before.
    """
    labelled = outcomes.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    return _judged(pages, labelled, rules, **options)


def _judged(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]], **options) -> DataFrame:
    hosts = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))
    hosts = written(hosts.join(labelled, "host", "left").na.fill(0, ["n", "bad"]), "host-pages")
    known = reputations(hosts, **options).select("host", "pages", "mean", "bound", "verdict")
    known = known.join(_rules_by_host(hosts.select("host"), rules), "host", "left")
    known = written(known.select("host", "pages", F.struct("mean", "bound", "verdict", "rules").alias("known")), "host-verdicts")
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = F.col("pages") * HOT >= total
    own, few, rest, at = (free_name(pages, c) for c in ("host_key", "hot", "cold", "at"))
    rows = pages.withColumns({own: host_of(F.col("url")), at: path_of(F.col("url"))})
    rows = rows.join(F.broadcast(known.where(hot).select(F.col("host").alias(own), F.col("known").alias(few))), own, "left")
    # a page that has its host's row already is dealt out by its path and joins nothing
    key, cold_key = free_name(pages, "join_key"), free_name(pages, "cold_key")
    rows = rows.withColumn(key, F.when(F.col(few).isNull(), F.concat(F.lit("h"), own)).otherwise(F.concat(F.lit("p"), at)))
    cold = known.where(~hot).select(F.concat(F.lit("h"), "host").alias(cold_key), F.col("known").alias(rest))
    rows = rows.join(cold, F.col(key) == F.col(cold_key), "left")
    found = F.coalesce(F.col(few), F.col(rest))
    fitting = F.filter(F.coalesce(found["rules"], F.array().cast(known.schema["known"].dataType["rules"].dataType)), lambda r: F.startswith(F.col(at), r["rule_path"]))
    # the longest; of equals the first by bytes
    best = F.array_sort(fitting, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"]).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    best = F.get(best, F.lit(0))
    added = {"host": F.col(own), "path": F.col(at), "rule": best["rule"], "verdict": F.coalesce(best["rule_verdict"], found["verdict"]), "mean": found["mean"], "bound": found["bound"]}
    return rows.select(*pages.columns, *(c.alias(free_name(pages, name)) for name, c in added.items()))


def op13_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("document")).agg(bad)
    documents = pages.groupBy(host_of(F.col("url")).alias("host"), document_of(path_of(F.col("url"))).alias("document")).agg(F.count("*").alias("n"))
    labelled = documents.where("document IS NOT NULL").join(labels, "document").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("bad"))
    return _judged(pages, labelled, RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql_level(name: str, source: str) -> str:
    """CTEs of one level: its rows with the prior's weight and the posterior mean."""
    return f"""{name}_weight AS (
  SELECT CASE WHEN pairs > 0 THEN excess / pairs ELSE 0 END AS apart
  FROM (SELECT sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) AS excess,
               sum(n * (n - 1) * prior * (1 - prior)) AS pairs FROM {source})
), {name}_shrunk AS (
  SELECT l.*, w.weight, (bad + prior * weight) / (n + weight) AS mean
  FROM {source} l, (SELECT CASE WHEN apart <= {1 / (WEIGHTS[1] + 1)!r} THEN {WEIGHTS[1]} WHEN apart >= {1 / (WEIGHTS[0] + 1)!r} THEN {WEIGHTS[0]}
                                ELSE 1 / apart - 1 END AS weight FROM {name}_weight) w
)"""


QUERIES = {"op13_url_reputation": op13_url_reputation}
ORACLE_SQL = {
    "op13_url_reputation": rf"""
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s){_HOST}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s){_PATH}', 1), '') AS path
  FROM pages
), outcomes AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, CAST(count(o.bad) AS DOUBLE) AS n, CAST(coalesce(sum(o.bad), 0) AS DOUBLE) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM urls LEFT JOIN outcomes o ON o.doc_id = TRY_CAST(regexp_extract(path, '{_NUMBER}', 1) AS BIGINT) GROUP BY host
), named AS (
  SELECT *, regexp_matches(name, '^[0-9.]*$|^\[') AS address, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS two,
         array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') AS three, string_split(name, '.')[-1] AS last
  FROM hosts
), placed AS (
  SELECT host, n, bad, CASE WHEN address THEN name WHEN two IN {SUFFIXES!r} THEN three ELSE two END AS domain,
         CASE WHEN address THEN '' WHEN two IN {SUFFIXES!r} THEN two ELSE last END AS suffix
  FROM named
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM placed) AS prior FROM placed GROUP BY suffix
), {_sql_level("suffix", "suffixes")}, domains AS (
  SELECT p.domain, p.suffix, sum(p.n) AS n, sum(p.bad) AS bad, any_value(s.mean) AS prior
  FROM placed p JOIN suffix_shrunk s ON p.suffix = s.suffix GROUP BY p.domain, p.suffix
), {_sql_level("domain", "domains")}, units AS (
  SELECT p.*, d.mean AS prior FROM placed p JOIN domain_shrunk d ON p.domain = d.domain AND p.suffix = d.suffix
), {_sql_level("host", "units")}, verdicts AS (
  SELECT host, CASE WHEN mean - {SIGMAS} * sqrt(mean * (1 - mean) / (n + weight + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM host_shrunk
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {", ".join(map(repr, RULES))}
), fitting AS (
  SELECT DISTINCT u.host, u.path, r.rule_host || r.rule_path AS rule, rule_verdict
  FROM urls u JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(rule) DESC, rule) = 1
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.rule_verdict, v.verdict) AS verdict
FROM urls u JOIN verdicts v ON u.host = v.host LEFT JOIN fitting f ON f.host = u.host AND f.path = u.path
"""
}
