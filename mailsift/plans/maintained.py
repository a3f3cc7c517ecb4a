"""Reports that are kept up to date part by part, without analysing a message twice.

A part is what arrives together: a day, a source, a batch of files. Its messages are analysed once; what
reports need of them is stored as ``facts`` (narrow rows without texts), and the totals of each report are
stored per part. Reading a report adds up the totals of the parts, which are few rows. A part that is stored
again replaces itself, so a failed or corrected part is simply run again; its totals come after its facts.

Every table lies in a folder of its own below the given one, partitioned by ``part``.
"""

import re

from pyspark.sql import functions as F

from mailsift.plans import corpus

FACTS = ["msg_id", "raw_score", "score", "band", "headers_found"]
TOTALS = {"bands": corpus.band_totals, "rules": corpus.rule_hits, "rule_sets": corpus.rule_sets,
          "domains": corpus.domain_totals, "senders": corpus.sender_totals}


def facts_of(analysed):
    """What reports need of a message: verdict, rules with points, domains with tones, sender and its checks."""
    sender = lambda c: F.col("sender")[c].alias(c)
    return analysed.select(
        *FACTS, F.transform("findings", lambda f: F.struct(f["rule_id"].alias("rule_id"), f["points"].alias("points"))).alias("findings"),
        F.transform("links", lambda u: F.struct(u["registrable"].alias("registrable"), F.transform(
            u["flags"], lambda f: F.struct(f["id"].alias("id"), f["tone"].alias("tone"))).alias("flags"))).alias("links"),
        F.struct(*map(sender, ("from_registrable", "spf", "dkim", "dmarc"))).alias("sender"))


def store(analysed, folder, part):
    """Store facts and totals of a part, in place of those stored for it before."""
    if not re.fullmatch(r"[\w.-]+", part, re.A):
        raise ValueError(f"part {part!r} is no name for a folder")
    spark = analysed.sparkSession
    facts = f"{folder}/facts/part={part}"
    facts_of(analysed).write.mode("overwrite").parquet(facts)
    for name, total in TOTALS.items():
        total(spark.read.parquet(facts)).write.mode("overwrite").parquet(f"{folder}/{name}/part={part}")


def stored(spark, folder, name="facts", parts=None):
    """A stored table, of some parts or of all; files of other parts are not read."""
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("part", F.col("part").cast("string"))
    return rows if parts is None else rows.filter(F.col("part").isin(list(parts)))


def band_distribution(spark, folder, parts=None):
    return corpus.band_shares(stored(spark, folder, "bands", parts))


def rule_prevalence(spark, folder, parts=None):
    hits = stored(spark, folder, "rules", parts).groupBy("rule_id").agg(
        F.sum("messages").alias("messages"), F.sum("points_given").alias("points_given"))
    return corpus.registry_with(spark, hits).select("rule_id", "messages", "points_given")


def rule_cooccurrence(spark, folder, parts=None):
    return corpus.rule_pairs(stored(spark, folder, "rule_sets", parts).groupBy("rules").agg(F.sum("n").alias("n")))


def domain_leaderboard(spark, folder, k=20, parts=None):
    return corpus.top_domains(corpus.added_domains(stored(spark, folder, "domains", parts)), k)


def sender_profile(spark, folder, parts=None):
    sums = [F.sum(c).alias(c) for c in ("messages", *corpus.CHECKS, "high", "total")]
    return corpus.sender_shares(stored(spark, folder, "senders", parts).groupBy("sender_domain").agg(*sums))


def all_reports(spark, folder):
    """The five reports as rows (report, name, messages, value)."""
    row = lambda df, report, name, value: df.select(
        F.lit(report).alias("report"), name.alias("name"), F.col("messages").cast("bigint").alias("messages"),
        F.col(value).cast("double").alias("value"))
    out = row(band_distribution(spark, folder), "band", F.col("band"), "avg_score")
    for more in (row(rule_prevalence(spark, folder), "rule", F.col("rule_id"), "points_given"),
                 row(rule_cooccurrence(spark, folder), "pair", F.concat_ws("+", "rule_a", "rule_b"), "lift"),
                 row(domain_leaderboard(spark, folder), "domain", F.col("registrable"), "flags"),
                 row(sender_profile(spark, folder), "sender", F.col("sender_domain"), "avg_score")):
        out = out.unionByName(more)
    return out
