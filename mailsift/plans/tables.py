"""Flat tables read off analysed messages. Each is a map over them; none shuffles."""

from pyspark.sql import functions as F

from mailsift.functions import domains
from mailsift.operators import attachments, scoring
from mailsift.operators.findings import rows
from mailsift.plans import dims, lookalikes
from mailsift.sources.shared import cut_lineage


def each(df, column, *keep, ord_name="ord"):
    """One row per array element with its 1-based place.

    The array goes through an expression, not a bare column: for a column the
    optimiser would add a size filter below the generator and run the
    extraction a second time.
    """
    items = F.filter(column if not isinstance(column, str) else F.col(column), lambda x: x.isNotNull())
    return (df.select(*keep, F.posexplode(items).alias("pos", "x"))
            .withColumn(ord_name, (F.col("pos") + 1).cast("bigint")).drop("pos"))


def finding_table(analysed, rules, column="findings"):
    """(msg_id, seq, rule_id, ...) with the rule's metadata by broadcast join."""
    found = rows(analysed, column, "msg_id").select(
        "msg_id", "seq", "rule_id", F.array_join("evidence", " | ").alias("evidence"), "extra")
    return found.join(F.broadcast(rules), "rule_id")


def url_table(df):
    return each(df, "links", "msg_id", ord_name="url_ord").select("msg_id", "url_ord", "x.*")


def file_table(df):
    return each(df, "files", "msg_id", ord_name="file_ord").select(
        "msg_id", "file_ord", F.col("x").alias("name"), attachments.extension(F.col("x")).alias("ext"))


def recommendation_table(analysed):
    return each(scoring.with_recommendations(analysed), "recommendations", "msg_id", ord_name="rank").select(
        "msg_id", "rank", "x.tag", "x.text")


def ordered_findings(analysed):
    """Findings with their place in the order really used and in the documented one."""
    actual = each(analysed, scoring.ordered(F.col("findings")), "msg_id", "findings", ord_name="rank")
    documented = F.array_position(F.transform(scoring.ordered(F.col("findings"), documented=True),
                                              lambda x: x["seq"]), F.col("x.seq"))
    return actual.select("msg_id", "rank", documented.cast("bigint").alias("rank_documented"),
                         F.col("x.seq").cast("bigint").alias("seq"), F.col("x.f.rule_id").alias("rule_id"))


def host_profile(df):
    """What there is to know about a host, once per distinct host of the corpus.

    Messages naming a host are counted before the shuffle, so a host that a third
    of all messages name arrives as one row per task. Brands are met by index joins.
    """
    spark = df.sparkSession
    named = each(df, F.array_distinct(F.transform("urls", lambda u: u["host"])), "msg_id")
    hosts = cut_lineage(named.groupBy(F.col("x").alias("host")).agg(F.count("*").alias("messages"))
                        .withColumn("registrable", domains.registrable(F.col("host"))))
    brands, owned = dims.brand_token(spark), dims.brand_domain(spark)
    h, reg = F.col("host"), F.col("registrable")
    typo = lookalikes.typosquats(hosts, owned).select(
        "host", F.col("brand").alias("typo_brand"), F.col("domain").alias("typo_domain"), F.col("distance").alias("typo_distance"))
    official = owned.select("brand_ord", F.col("domain").alias("registrable"), F.lit(True).alias("is_official"))
    return (hosts.join(lookalikes.in_host(hosts, brands), "host", "left")
            .join(brands.select("brand_ord", "brand").distinct(), "brand_ord", "left")
            .join(official, ["brand_ord", "registrable"], "left").join(typo, "host", "left")
            .select("host", "messages", "registrable", domains.core_of(reg).alias("core"),
                    domains.last_label(h).alias("tld"), domains.is_ip(h).alias("is_ip"),
                    F.coalesce("brand", F.lit("")).alias("brand"),
                    F.coalesce("is_official", F.lit(False)).alias("is_official"),
                    F.coalesce("typo_brand", F.lit("")).alias("typo_brand"),
                    F.coalesce("typo_domain", F.lit("")).alias("typo_domain"),
                    F.coalesce("typo_distance", F.lit(0)).cast("bigint").alias("typo_distance")))
