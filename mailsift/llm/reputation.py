"""Host reputation by empirical Bayes, with DataFrame functions only.

Labelled outcomes (good or bad) of pages are shrunk through three levels: host, registered domain,
suffix. Each level's pages are binomial with a share that is drawn from a beta distribution around
the posterior mean of the level above; the uppermost prior is the share of all labelled pages. The
strength of each level's beta prior is estimated from the data by the method of moments: with q_i the
shares of the groups, n_i their pages and m the mean they are drawn around, the sum of
n_i (q_i - m)^2 beyond what binomial noise explains gives the variance between groups and with it
``strength = m (1 - m) / variance - 1``, kept within bounds. A
host without labels has the posterior of its domain, and so on. A page is blocked if the lower bound
of the posterior for "bad" (mean minus ``z`` standard deviations) is above ``limit``.

Rules decide before the method. A rule fits its host and all subdomains if the path starts with the
path of the rule; the longest wins.

Plan: labels and pages are joined once; outcomes are counted per host in the map before they are
shuffled, so a host of a third of all pages is one row per task. Everything above works on one row
per host. The verdict is joined back on the host; Spark splits a hot host there, and no side is
broadcast by hint.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and takes
part as the host "". Labels that are null do not count. Repeated rows are judged each on its own and
repeated labels of a page count each.
"""

from functools import reduce

from pyspark.sql import functions as F

from mailsift.data.lists import MULTI_PART_SUFFIXES
from mailsift.functions.columns import among
from mailsift.functions.domains import is_ip, registrable

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LIMIT, Z = 0.2, 1.645
STRENGTH = (2.0, 1000.0)  # bounds of the number of pages that a prior weighs as much as
IPS = "[ip]"  # the suffix of all IP addresses
AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """Host and path of a url as columns."""
    rest = F.when(url.contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), AZ, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules=RULES):
    """The longest rule that fits, else null."""
    def fits(rule):
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)

    ordered = sorted((r for _, r in rules), key=len, reverse=True)
    return F.coalesce(*[F.when(fits(r), r) for r in ordered], F.lit(None).cast("string"))


def levels(host):
    """Registered domain and suffix of a host, without user and port; an IP address is a domain of its own."""
    name = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*\z", "")
    domain = F.when(is_ip(name), name).otherwise(registrable(name))
    suffix = F.when(is_ip(name), IPS).when(among(domain, MULTI_PART_SUFFIXES), domain).otherwise(
        F.regexp_replace(domain, r"^[^.]*\.", ""))
    return domain, suffix


def strength(groups, bad, n, mean):
    """Strength of the beta prior of a level, by the method of moments over its groups with labels."""
    p = F.greatest(F.col(mean), F.lit(1e-6))
    share = F.col(bad) / F.col(n)
    found = groups.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * (share - p) * (share - p)).alias("spread"), F.sum(p * (1 - p)).alias("noise"),
        F.sum((F.col(n) - 1) * p * (1 - p)).alias("weight")).first()
    if found["spread"] is None or found["spread"] <= found["noise"]:
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], found["weight"] / (found["spread"] - found["noise"]) - 1))


def reputations(outcomes):
    """``host`` with the posterior for "bad": ``labelled``, ``bad``, ``prior_mean``, ``posterior_mean``, ``bad_bound``.

    ``outcomes`` has one row per page: ``host`` and ``bad`` (0, 1, or null if not labelled).
    """
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")).withColumns(
        {"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(
        F.sum("labelled").alias("domain_labelled"), F.sum("bad").alias("domain_bad"))
    suffixes = domains.groupBy("suffix").agg(
        F.sum("domain_labelled").alias("suffix_labelled"), F.sum("domain_bad").alias("suffix_bad"))
    total = suffixes.agg(F.sum("suffix_bad").alias("b"), F.sum("suffix_labelled").alias("n")).first()
    overall = (total["b"] or 0) / total["n"] if total["n"] else 0.0

    def shrunk(groups, bad, n, mean, out):
        weight = round(strength(groups, bad, n, mean), 6)
        return groups.withColumn(f"{out}_weight", F.lit(weight)).withColumn(
            out, (F.col(bad) + weight * F.col(mean)) / (F.col(n) + weight))

    suffixes = shrunk(suffixes.withColumn("overall", F.lit(float(overall))), "suffix_bad", "suffix_labelled",
                      "overall", "suffix_mean")
    domains = shrunk(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "domain_bad", "domain_labelled",
                     "suffix_mean", "domain_mean")
    hosts = shrunk(hosts.join(domains.select("domain", "domain_mean"), "domain"), "bad", "labelled", "domain_mean",
                   "posterior_mean")
    p, size = F.col("posterior_mean"), F.col("labelled") + F.col("posterior_mean_weight")
    return hosts.select("host", "labelled", "bad", F.col("domain_mean").alias("prior_mean"), "posterior_mean",
                        (p - Z * F.sqrt(p * (1 - p) / (size + 1))).alias("bad_bound"))


def judge(pages, labels, rules=RULES, limit=LIMIT):
    """Every page (``page_id``, ``url``) with ``host``, ``path``, ``rule``, ``verdict`` and the posterior of its host.

    ``labels`` has ``page_id`` and ``bad`` for some pages.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.filter("bad is not null").select("page_id", "bad")
    known = reputations(parts.select("page_id", "host").join(marks, "page_id", "left"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict_of = reduce(lambda acc, r: acc.when(F.col("rule") == r[1], r[0]), rules, F.when(F.lit(False), ""))
    return parts.withColumn("rule", rule).join(known, "host", "left").withColumn(
        "verdict", F.coalesce(verdict_of, F.when(F.col("bad_bound") > limit, "block").otherwise("allow")))


def outcome():
    """A page is bad if its label says low quality or toxic."""
    return F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (
        F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int"))


def oracle_levels():
    """Registered domain and suffix of ``host`` in plain SQL, from its labels as a list."""
    some = ", ".join(f"'{s}'" for s in MULTI_PART_SUFFIXES)
    octet = r"(25[0-5]|2[0-4]\d|[01]?\d{1,2})"
    return f"""
    named AS (SELECT DISTINCT host, regexp_replace(host, '(?s)^.*@|:[0-9]*$', '', 'g') AS name FROM parts),
    told AS (
      SELECT host, name, string_split(regexp_replace(lower(name), '\\.$', ''), '.') AS labels,
             regexp_matches(trim(name, '[]'), '^{octet}(\\.{octet}){{3}}$')
             OR (contains(name, ':') AND regexp_matches(lower(trim(name, '[]')), '^[0-9a-f:.]+$')) AS ip FROM named),
    owned AS (
      SELECT host, name, ip, array_to_string(labels[-2:], '.') AS two,
             array_to_string(labels[(CASE WHEN array_to_string(labels[-2:], '.') IN ({some}) THEN -3 ELSE -2 END):], '.') AS domain
      FROM told),
    level AS (
      SELECT host, CASE WHEN ip THEN name ELSE domain END AS domain,
             CASE WHEN ip THEN '{IPS}' WHEN domain IN ({some}) OR NOT contains(domain, '.') THEN domain
                  ELSE substr(domain, instr(domain, '.') + 1) END AS suffix FROM owned)"""


def oracle_sql(rules=RULES, limit=LIMIT):
    """The same verdicts as plain SQL over ``pages`` and ``labels``."""
    ordered = sorted((r for _, r in rules), key=len, reverse=True)

    def fits(rule):
        name, _, rest = rule.partition("/")
        return f"((host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}'))"

    def shrunk(source, bad, n, mean, out):
        p = f"greatest({mean}, 1e-6)"
        share = f"({bad} / {n})"
        return f"""{out}_w AS (
          SELECT round(CASE WHEN spread > noise THEN least({STRENGTH[1]}, greatest({STRENGTH[0]},
                   weight / (spread - noise) - 1)) ELSE {STRENGTH[1]} END, 6) AS w
          FROM (SELECT sum({n} * ({share} - {p}) * ({share} - {p})) AS spread, sum({p} * (1 - {p})) AS noise,
                       sum(({n} - 1) * {p} * (1 - {p})) AS weight FROM {source} WHERE {n} > 0)),
        {out}_t AS (SELECT s.*, w, ({bad} + w * {mean}) / ({n} + w) AS {out} FROM {source} s, {out}_w)"""

    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{AZ}', '{LOWER}') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    marks AS (
      SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad FROM labels
      WHERE quality IS NOT NULL OR toxic IS NOT NULL),{oracle_levels()},
    hosts AS (
      SELECT host, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0.0::DOUBLE) AS bad, domain, suffix
      FROM parts LEFT JOIN marks ON doc_id = page_id JOIN level USING (host) GROUP BY host, domain, suffix),
    domains AS (SELECT domain, suffix, sum(labelled) AS domain_labelled, sum(bad) AS domain_bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(domain_labelled) AS suffix_labelled, sum(domain_bad) AS suffix_bad,
                 (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) FROM hosts) AS overall FROM domains GROUP BY suffix),
    {shrunk("suffixes", "suffix_bad", "suffix_labelled", "overall", "suffix_mean")},
    domains_2 AS (SELECT d.*, suffix_mean FROM domains d JOIN suffix_mean_t USING (suffix)),
    {shrunk("domains_2", "domain_bad", "domain_labelled", "suffix_mean", "domain_mean")},
    hosts_2 AS (SELECT h.*, domain_mean FROM hosts h JOIN domain_mean_t USING (domain)),
    {shrunk("hosts_2", "bad", "labelled", "domain_mean", "posterior")},
    known AS (SELECT *, posterior - {Z} * sqrt(posterior * (1 - posterior) / (labelled + w + 1)) AS bound FROM posterior_t),
    ruled AS (SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for r in ordered)} END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules)}
                WHEN bound > {limit} THEN 'block' ELSE 'allow' END AS verdict,
           labelled::BIGINT AS labelled, bad::BIGINT AS bad
    FROM ruled JOIN known USING (host)"""
