"""URL filters: listed rules first, then the reputation of hosts.

A host's share of bad pages is learned from labelled ones. Few labels say little, so the share is
shrunk towards that of the rest of its registered domain, this towards that of the rest of its
suffix, and this towards that of all other pages: at each level the prior is a beta distribution around the level above, whose strength is
fitted to how much the shares differ at that level. A host is blocked if the lower bound of its
posterior share is above what is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored, table

#: Second-level labels that belong to the suffix before a country code of two letters. Fixed values.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: A host is blocked if, by its bound, so much of it is bad.
MAX_BAD = 0.5
#: Posterior standard deviations between mean and bound.
DEVIATIONS = 1.645
#: Weakest and strongest prior, in pages.
STRENGTHS = 1.0, 1e6
#: A key of more than this share of the rows is joined by a broadcast of at most 1 / HOT_SHARE rows.
HOT_SHARE = 0.001
#: Rules of the registered query, as host, path and verdict. Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), r"\.$", "")


def suffix_length(labels: Column) -> Column:
    """Labels of a name's suffix: two for ``co.uk`` and the like, one otherwise."""
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return F.when(before.isin(SECOND_LEVEL) & (F.length(last) == 2), 2).otherwise(1)


def with_domains(hosts: DataFrame) -> DataFrame:
    """hosts (``host``) with ``domain``, the suffix and one label more, and ``suffix``.

    Addresses in digits, and names that are no longer than a suffix, are their own domain.
    """
    labels = F.split(name_of(F.col("host")), r"\.")
    n = suffix_length(labels)
    ip = name_of(F.col("host")).rlike(r"^\[.*\]$|^[0-9.]+$")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    name = name_of(F.col("host"))
    return hosts.withColumns({"domain": F.when(ip, name).otherwise(tail(n + 1)), "suffix": F.when(ip, F.lit("")).otherwise(tail(n))})


def _strength(children: DataFrame, parent: str) -> float:
    """Size of the beta prior of children (``n, bad`` and parent): from the correlation of pages within a child.

    The analysis of variance of counted shares: between children of one parent against within them.
    """
    sums = children.groupBy(parent).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("between"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    between = F.sum(F.col("between") - F.col("bad") * F.col("bad") / F.col("n"))
    within = F.sum(F.col("bad") - F.col("between"))
    f = sums.agg(between, within, F.sum(F.col("k") - 1), F.sum(F.col("n") - F.col("k")), F.sum(F.col("n") - F.col("squares") / F.col("n"))).first()
    low, high = STRENGTHS
    if not f[2] or not f[3] or not f[4]:
        return low
    msb, msw, size = f[0] / f[2], f[1] / f[3], f[4] / f[2]
    rho = (msb - msw) / (msb + (size - 1) * msw) if msb + (size - 1) * msw > 0 else 0.0
    return high if rho <= 0 else min(max(1 / rho - 1, low), high)


def reputations(hosts: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """hosts (``host, n, bad``: labelled pages, bad ones) with ``mean`` and ``bound`` of the posterior share of bad pages.

    Hosts of no label have the prior, of their domain. Without any label at all mean and bound are null.
    """
    hosts = with_domains(hosts)
    labelled = hosts.where(F.col("n") > 0)
    domains = labelled.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total[0]:
        return hosts.withColumns({"mean": F.lit(None).cast("double"), "bound": F.lit(None).cast("double")})
    s_suffix = _strength(suffixes.withColumn("all", F.lit(1)), "all")
    s_domain, s_host = _strength(domains, "suffix"), _strength(labelled, "domain")

    # what is above a level without the level's own pages, so that none of them counts twice
    shrunk = lambda bad, n, s, prior: (bad + F.lit(s) * prior) / (n + F.lit(s))
    n, bad = F.lit(total[0]), F.lit(total[1])
    others = F.when(n > F.col("s_n"), (bad - F.col("s_bad")) / F.nullif(n - F.col("s_n"), F.lit(0))).otherwise(bad / n)
    suffixes = suffixes.select("suffix", F.col("n").alias("s_n"), F.col("bad").alias("s_bad")).withColumn("others", others)
    domains = domains.select("suffix", "domain", F.col("n").alias("d_n"), F.col("bad").alias("d_bad"))
    out = hosts.join(domains, ["suffix", "domain"], "left").join(suffixes, "suffix", "left").na.fill(0, ["d_n", "d_bad", "s_n", "s_bad"])
    of_suffix = shrunk(F.col("s_bad") - F.col("d_bad"), F.col("s_n") - F.col("d_n"), s_suffix, F.coalesce("others", bad / n))
    prior = shrunk(F.col("d_bad") - F.col("bad"), F.col("d_n") - F.col("n"), s_domain, of_suffix)
    a, size = F.col("bad") + F.lit(s_host) * prior, F.col("n") + F.lit(s_host)
    mean = a / size
    bound = mean - F.lit(deviations) * F.sqrt(mean * (1 - mean) / (size + 1))
    return out.withColumns({"mean": mean, "bound": bound}).drop("d_n", "d_bad", "s_n", "s_bad", "others")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, rule_verdict`` of the distinct urls (``host, path``) that a rule (``host, path, verdict``) fits: the longest.

    A rule is looked for by its host among the ends of the url's host, then by its path among the
    starts of the url's, of the lengths that this host has rules of; so any number of rules will do.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    rules = rules.select(F.translate("host", upper, upper.lower()).alias("rule_host"), F.col("path").alias("start"), F.col("verdict").alias("rule_verdict"))
    rules = rules.groupBy("rule_host", "start").agg(F.max("rule_verdict").alias("rule_verdict"))  # block, where both are listed
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("start")).alias("lengths"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hosts = urls.select("host").distinct().withColumn("rule_host", F.explode(ends)).join(lengths, "rule_host")
    tried = urls.join(hosts, "host").withColumn("length", F.explode("lengths")).where(F.col("length") <= F.length("path"))
    tried = tried.withColumn("start", F.expr("substring(path, 1, length)")).join(rules, ["rule_host", "start"])
    rule = F.concat("rule_host", "start")
    best = F.max(F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("own"), rule.alias("rule"), "rule_verdict")).alias("best")
    return tried.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.rule_verdict")


def judged(pages: DataFrame, rules: DataFrame, labels: DataFrame, max_bad: float = MAX_BAD, deviations: float = DEVIATIONS) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_share, bound`` for each row of pages (``page_id, url``).

    rules (``host, path, verdict``: allow or block) decide where they fit: the host itself and all
    below it, if the url's path starts with the rule's; the longest of several. Elsewhere a host is
    blocked if the lower bound of its posterior share of bad pages is above max_bad. A labelled page
    (``doc_id, quality, toxic`` of labels, joined by page_id) is bad if any of its labels says so:
    quality 0, or toxic not 0.

    * A null url, or one without ``://``, has an empty host and path: no rule fits, it counts for no
      host, and is allowed, with null bad_share and bound. So is all if no page has a label.
    * Labels without quality and toxic, or without doc_id, say nothing. Rows of pages that repeat count each.
    * Keys of more than a thousandth of the rows are joined by a broadcast of at most a thousand rows.
    * Other columns are ignored; an empty table gives an empty result.
    """
    url = F.make_valid_utf8(F.col("url").cast("string"))
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") != 0).cast("int"))
    outcome = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("page_id is not null and bad is not null")
    outcome = outcome.groupBy("page_id").agg(F.max("bad").alias("bad"))
    with Scratch(pages.sparkSession) as scratch:
        marked = pages.where(F.col("host") != "").join(outcome, "page_id", "left")
        urls = marked.groupBy("host", "path").agg(F.count("*").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        urls = scratch.store(urls, "urls-distinct")
        hosts = scratch.store(urls.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "urls-hosts")
        known = scratch.store(reputations(hosts, deviations).select("host", "mean", "bound"), "urls-reputations")
        found = fitting_rules(urls.select("host", "path"), rules)
        found = urls.select("host", "path", "rows").join(known, "host").join(found, ["host", "path"], "left")
        found = scratch.store(found, "urls-verdicts")
        least = HOT_SHARE * (urls.agg(F.sum("rows")).first()[0] or 0)
        hot = found.where(F.col("rows") > least).drop("rows")
        rest = found.where(F.col("rows") <= least).drop("rows")
        at_hot = pages.join(F.broadcast(hot), ["host", "path"])
        others = pages.where(F.col("host") != "").join(F.broadcast(hot.select("host", "path")), ["host", "path"], "left_anti").join(rest, ["host", "path"])
        nowhere = pages.where(F.col("host") == "")
        by_method = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
        out = at_hot.unionByName(others).unionByName(nowhere, allowMissingColumns=True).withColumn("verdict", F.coalesce("rule_verdict", by_method))
        return stored(out.select("page_id", "host", "path", "rule", "verdict", F.col("mean").alias("bad_share"), "bound"), "urls-result")


def op13_url_filter(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judged(table(spark, sf_dir, "pages"), rules, table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def _strength_sql(name: str, children: str, parent: str) -> str:
    return f"""
{name}_sums AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(bad::DOUBLE * bad / n) AS between_, sum(n::DOUBLE * n) AS squares
  FROM {children} GROUP BY {parent}
), {name}_parts AS (
  SELECT sum(between_ - bad * bad / n) / nullif(sum(k - 1), 0) AS msb, sum(bad - between_) / nullif(sum(n - k), 0) AS msw,
    nullif(sum(n - squares / n), 0) / nullif(sum(k - 1), 0) AS size FROM {name}_sums
), {name} AS (
  SELECT CASE WHEN msb IS NULL OR msw IS NULL OR size IS NULL THEN {STRENGTHS[0]}
    WHEN msb + (size - 1) * msw <= 0 OR msb <= msw THEN {STRENGTHS[1]}
    ELSE least(greatest((msb + (size - 1) * msw) / (msb - msw) - 1, {STRENGTHS[0]}), {STRENGTHS[1]}) END AS s FROM {name}_parts
)"""


OP13_SQL = f"""
WITH rules(rule_host, start, verdict) AS (VALUES {_RULE_ROWS}
), pages_ AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), outcome AS (
  SELECT doc_id AS page_id, max(greatest((quality = 0)::INT, (toxic <> 0)::INT)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    string_split(regexp_replace(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '\\.$', ''), '.') AS labels
  FROM pages_ LEFT JOIN outcome USING (page_id) WHERE host <> '' GROUP BY host
), sized AS (
  SELECT *, CASE WHEN len(labels) > 1 AND labels[-2] IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) AND length(labels[-1]) = 2 THEN 2 ELSE 1 END AS k,
    regexp_matches(array_to_string(labels, '.'), '^\\[.*\\]$|^[0-9.]+$') AS ip FROM hosts
), named AS (
  SELECT host, n, bad, CASE WHEN ip THEN array_to_string(labels, '.') ELSE array_to_string(labels[greatest(len(labels) - k, 1):], '.') END AS domain,
    CASE WHEN ip THEN '' ELSE array_to_string(labels[greatest(len(labels) - k + 1, 1):], '.') END AS suffix FROM sized
), labelled AS (SELECT * FROM named WHERE n > 0
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM labelled GROUP BY ALL
), suffixes AS (SELECT suffix, 1 AS one, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), share AS (SELECT sum(n) AS all_n, sum(bad) AS all_bad FROM suffixes
), {_strength_sql("s_suffix", "suffixes", "one")}, {_strength_sql("s_domain", "domains", "suffix")}, {_strength_sql("s_host", "labelled", "domain")}
, joined AS (
  SELECT h.host, h.n, h.bad, coalesce(d.n, 0) AS d_n, coalesce(d.bad, 0) AS d_bad, coalesce(x.n, 0) AS s_n, coalesce(x.bad, 0) AS s_bad, all_n, all_bad
  FROM named h LEFT JOIN domains d ON h.suffix = d.suffix AND h.domain = d.domain LEFT JOIN suffixes x ON h.suffix = x.suffix, share
), of_suffix AS (
  SELECT j.*, (s_bad - d_bad + s * CASE WHEN all_n > s_n THEN (all_bad - s_bad) / (all_n - s_n) ELSE all_bad / all_n END) / (s_n - d_n + s) AS suffix_mean FROM joined j, s_suffix
), of_domain AS (SELECT o.*, (d_bad - bad + s * suffix_mean) / (d_n - n + s) AS prior FROM of_suffix o, s_domain
), means AS (SELECT host, n + s AS size, (bad + s * prior) / (n + s) AS mean FROM of_domain, s_host
), method AS (
  SELECT host, CASE WHEN mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (size + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict FROM means
), fits AS (
  SELECT host, path, arg_max(rule_host || start, (length(rule_host || start), length(rule_host))) AS rule,
    arg_max(verdict, (length(rule_host || start), length(rule_host))) AS verdict
  FROM (SELECT DISTINCT host, path FROM pages_) u
  JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start) GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, m.verdict, 'allow') AS verdict
FROM pages_ p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path LEFT JOIN method m ON p.host = m.host
"""
