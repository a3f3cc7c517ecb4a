"""The catalogue as small tables. All have a fixed number of rows (below 200), so broadcasting them is safe."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsift.data import catalogue, lists
from mailsift.operators.attachments import ext_group


def rule(spark):
    """The rules with their place in the registry."""
    return ranked(rule_table(spark))


def ranked(rules):
    """Rules with registry_source and registry_rank: points descending, then title in the order of the root
    collation, which knows no code points. One window over a catalogue, whose size ``RuleBook`` bounds."""
    sources = F.create_map(*[F.lit(x) for pair in catalogue.REGISTRY_SOURCE.items() for x in pair])
    order = Window.orderBy(F.desc("points"), F.collate("title", "UNICODE"), "rule_id")
    return rules.withColumn("registry_source", sources[F.col("source")]).withColumn(
        "registry_rank", F.row_number().over(order))


def rule_table(spark):
    """The catalogue as the first of the tables that rules can be read from."""
    return spark.createDataFrame(
        [(i, r.rule_id, r.source, r.category, r.severity, r.points, r.title, r.why, r.advice)
         for i, r in enumerate(catalogue.ALL_RULES, 1)],
        "place int, rule_id string, source string, category string, severity string, points int, title string, "
        "why string, advice string")


def rule_pattern(spark):
    return spark.createDataFrame([(r.rule_id, i, p) for r in catalogue.ALL_RULES for i, p in enumerate(r.patterns, 1)],
                                 "rule_id string, ord int, pattern string")


def rule_combo(spark):
    return spark.createDataFrame([(combo, c, i, member) for combo, clauses in catalogue.COMBO_CLAUSES.items()
                                  for c, members in enumerate(clauses, 1) for i, member in enumerate(members, 1)],
                                 "rule_id string, clause int, ord int, member string")


def band(spark):
    return spark.createDataFrame(catalogue.BANDS, "band string, min_score int, max_score int, label string, blurb string")


def indicator(spark):
    return spark.createDataFrame(catalogue.REQUIRED_INDICATORS, "indicator string, rule_id string")


def extension(spark):
    return spark.createDataFrame(ext_group(), "ext string, grp string")


def tld(spark):
    """Distinct union of the common and the risky suffixes."""
    make = lambda values: spark.createDataFrame([(v,) for v in values], "tld string")
    return make(lists.COMMON_TLDS).union(make(lists.RISKY_TLDS)).distinct()


def lookup(spark):
    """All lookup lists as (list, entry); those of brands name the brand in front of a slash."""
    named = {"multi_part_suffix": lists.MULTI_PART_SUFFIXES, "risky_tld": lists.RISKY_TLDS,
             "shortener": lists.SHORTENERS, "free_mail": lists.FREE_MAIL_DOMAINS,
             "brand": [b for b, _, _ in lists.BRANDS],
             "brand_token": [f"{b}/{t}" for b, tokens, _ in lists.BRANDS for t in tokens],
             "brand_domain": [f"{b}/{d}" for b, _, domains in lists.BRANDS for d in domains],
             "host_stopword": lists.HOST_STOPWORDS, "severity": list(lists.SEVERITIES),
             "category": lists.CATEGORY_ORDER, "band": [b[0] for b in catalogue.BANDS]}
    return spark.createDataFrame([(n, v) for n, values in named.items() for v in values], "list string, entry string")


def brand_token(spark):
    """Words that stand for a brand, in the order of the brands."""
    return spark.createDataFrame([(i, brand, t) for i, (brand, tokens, _) in enumerate(lists.BRANDS, 1) for t in tokens],
                                 "brand_ord int, brand string, token string")


def brand_domain(spark):
    """Domains that belong to a brand, in list order."""
    owned = [(i, brand, d) for i, (brand, _, domains) in enumerate(lists.BRANDS, 1) for d in domains]
    return spark.createDataFrame([(n, *row) for n, row in enumerate(owned, 1)],
                                 "domain_ord int, brand_ord int, brand string, domain string")
