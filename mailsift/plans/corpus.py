"""Reports over all messages."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from mailsift.data import catalogue
from mailsift.functions.columns import constant, is_first
from mailsift.plans import dims
from mailsift.plans.tables import each
from mailsift.sources.shared import cut_lineage


# A report is made in two steps: totals that add up over any parts of the messages, and what is read off
# them. ``plans.maintained`` stores the totals of each part.

def band_totals(analysed):
    """(band, messages, total): messages and added scores."""
    return analysed.groupBy("band").agg(F.count("*").alias("messages"), F.sum("score").alias("total"))


def band_shares(totals):
    """Messages per band, empty bands included, from rows of ``band_totals``."""
    bands = [b[0] for b in catalogue.BANDS]
    of = lambda b, c: F.sum(F.when(F.col("band") == b, F.col(c)))
    row = totals.agg(F.sum("messages").alias("all"), *[c for b in bands for c in (
        F.coalesce(of(b, "messages"), F.lit(0)).alias(f"n_{b}"), of(b, "total").alias(f"t_{b}"))])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(b).alias("band"), F.col(f"n_{b}").alias("messages"), ratio(F.col(f"n_{b}"), F.col("all")).alias("share"),
        ratio(F.col(f"t_{b}"), F.col(f"n_{b}")).alias("avg_score")) for b in bands])).alias("x")).select("x.*")


def band_distribution(spark, analysed):
    return band_shares(band_totals(analysed.select("band", "score")))


def rule_hits(analysed):
    """(rule_id, messages, points_given): a rule fires at most once per message, so no distinct is needed."""
    found = each(analysed, F.transform("findings", lambda f: F.struct(
        f["rule_id"].alias("rule_id"), f["points"].alias("points"))), "msg_id").select("x.*")
    return found.groupBy("rule_id").agg(F.count("*").alias("messages"),
                                        F.sum("points").cast("bigint").alias("points_given"))


def rule_prevalence(spark, analysed):
    return registry_with(spark, rule_hits(analysed))


def registry_with(spark, hits):
    """Every rule of the registry with the messages it fired on, never-fired ones included."""
    joined = dims.rule(spark).join(hits, "rule_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select("rule_id", "registry_source", "title", "severity",
                         F.col("points").cast("bigint").alias("points"),
                         F.col("registry_rank").cast("bigint").alias("registry_rank"),
                         zero("messages"), zero("points_given"))


def rule_coverage(spark, analysed):
    """Indicators that must exist, matched with the registry and with what fired."""
    known = dims.rule(spark).select("rule_id", "severity", "points")
    return (dims.indicator(spark).join(known, "rule_id", "left").join(rule_hits(analysed), "rule_id", "left")
            .select("indicator", "rule_id", F.col("severity").isNotNull().alias("registered"),
                    F.coalesce("severity", F.lit("")).alias("severity"),
                    F.coalesce("points", F.lit(0)).cast("bigint").alias("points"),
                    F.coalesce("messages", F.lit(0).cast("bigint")).alias("messages")))


def rule_sets(analysed):
    """(rules, n): messages per set of rules."""
    ids = F.array_sort(F.transform("findings", lambda f: f["rule_id"]))
    return analysed.groupBy(ids.alias("rules")).agg(F.count("*").alias("n"))


def rule_cooccurrence(analysed):
    return rule_pairs(rule_sets(analysed))


def rule_pairs(sets):
    """Pairs of rules on the same message with their lift.

    Messages with the same set of rules are counted first; pairs are then made
    once per distinct set, not per message. A set has at most 59 rules.
    """
    single = each(sets, F.concat("rules", F.array(F.lit("*"))), "n").groupBy(F.col("x").alias("rule")).agg(
        F.sum("n").alias("n"))
    pairs = F.flatten(F.transform("rules", lambda a, i: F.transform(
        F.slice("rules", i + 2, F.size("rules")), lambda b: F.struct(a.alias("rule_a"), b.alias("rule_b")))))
    both = each(sets, pairs, "n").groupBy("x.rule_a", "x.rule_b").agg(F.sum("n").alias("messages"))
    a, b, whole = (single.select(F.col("rule").alias(f"rule_{s}"), F.col("n").alias(f"n_{s}"))
                   for s in ("a", "b", "all"))
    lift = F.col("messages") * F.col("n_all") / (F.col("n_a") * F.col("n_b"))
    return (both.withColumn("rule_all", F.lit("*")).join(F.broadcast(a), "rule_a")
            .join(F.broadcast(b), "rule_b").join(F.broadcast(whole), "rule_all").select("rule_a", "rule_b", "messages", F.round(lift, 6).alias("lift")))


def domain_totals(df):
    """(registrable, messages, flags, tone): messages, scored flags and worst tone per domain; needs links."""
    flagged = F.zip_with("links", is_first(F.col("links"), lambda d: d["registrable"]), lambda d, first: F.struct(
        d["registrable"].alias("registrable"), first.cast("bigint").alias("messages"),
        F.size(F.filter(d["flags"], lambda f: f["tone"] != "ok")).alias("flags"),
        F.when(F.exists(d["flags"], lambda f: f["tone"] == "bad"), 2)
        .when(F.exists(d["flags"], lambda f: f["tone"] == "warn"), 1).otherwise(0).alias("tone")))
    named = each(df, flagged, "msg_id").select("x.*")
    return added_domains(named)


def added_domains(rows):
    return rows.groupBy("registrable").agg(
        F.sum("messages").alias("messages"), F.sum("flags").cast("bigint").alias("flags"), F.max("tone").alias("tone"))


def domain_leaderboard(df, k=20):
    return top_domains(domain_totals(df), k)


def top_domains(totals, k=20):
    """The domains of most messages."""
    return (totals.orderBy(F.desc("messages"), "registrable").limit(k)
            .select("registrable", "messages", "flags",
                    F.element_at(constant("array('ok', 'warn', 'bad')"), F.col("tone") + 1).alias("worst_tone")))


CHECKS = [f"{c}_{r}" for c in ("spf", "dkim", "dmarc") for r in ("pass", "fail")]


def sender_totals(analysed):
    """(sender_domain, messages, results of the three checks, high, total) per From domain."""
    s = lambda f: F.col("sender")[f]
    mails = analysed.select(s("from_registrable").alias("sender_domain"), s("spf").alias("spf"),
                            s("dkim").alias("dkim"), s("dmarc").alias("dmarc"), "score", "band", "headers_found")
    passed = lambda c: F.count_if(F.col(c) == "pass").alias(f"{c}_pass")
    failed = lambda c: F.count_if(F.col(c) == "fail").alias(f"{c}_fail")
    grouped = mails.groupBy("headers_found", "sender_domain").agg(
        F.count("*").alias("messages"), *[m(c) for c in ("spf", "dkim", "dmarc") for m in (passed, failed)],
        F.count_if(F.col("band") == "high").alias("high"), F.sum("score").alias("total"))
    return grouped.filter("headers_found").select("sender_domain", "messages", *CHECKS, "high", "total")


def sender_profile(analysed):
    return sender_shares(sender_totals(analysed))


def sender_shares(totals):
    """Per From domain: mails, results of the three checks, mean score."""
    return totals.select("sender_domain", "messages", *CHECKS, "high", F.round(F.col("total") / F.col("messages"), 6).alias("avg_score"))


def golden_check(spark, analysed, expectation):
    """Messages whose verdict is outside of what is expected of them; ``expectation`` is keyed by msg_id."""
    joined = expectation.join(analysed.select("msg_id", "raw_score", "score", "band"), "msg_id", "left")
    wrong = (F.col("band").isNull() | (F.col("band") != F.col("expected_band"))
             | (F.col("score") < F.coalesce("min_score", F.lit(0)))
             | (F.col("score") > F.coalesce("max_score", F.lit(100))))
    return joined.withColumn("failed", wrong)


SALTS = 16


def duplicate_collapse(messages, score):
    """Score each distinct text once and give the result to all its copies.

    Only hashes and ids are aggregated; copies are collapsed before that shuffle. The one message
    that stands for a text is found by its id, and its narrow result is joined back on the hash,
    salted, so that a text of a third of all messages is dealt over ``SALTS`` tasks.
    """
    hashed = messages.withColumn("text_hash", F.sha2(F.coalesce("raw", F.lit("")), 256))
    keys = hashed.select("msg_id", "text_hash")
    firsts = keys.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("msg_id").alias("first_id"))
    chosen = messages.join(firsts.select(F.col("first_id").alias("msg_id"), "copies", "text_hash"), "msg_id")
    scored = cut_lineage(score(chosen).select("text_hash", "copies", F.col("msg_id").alias("first_id"), "score", "band"))
    spread = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("msg_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["text_hash", "salt"]).drop("salt")


def sender_sessions(mails, gap_minutes):
    """Bursts of mails per sender: mails no further apart than the gap belong together.

    Mails are first counted per sender and bucket of one gap. Two mails of one
    bucket are never further apart than the gap, so whole buckets move together
    and a sender with a third of all mails shrinks to one row per bucket.
    """
    gap = gap_minutes * 60
    seconds = F.unix_timestamp("ts")
    buckets = mails.groupBy("sender_domain", F.floor(seconds / gap).alias("bucket")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("mails"), F.count_if(F.col("band") == "high").alias("high"))
    order = Window.partitionBy("sender_domain").orderBy("bucket")
    apart = F.unix_timestamp("first_ts") - F.unix_timestamp(F.lag("last_ts").over(order))
    numbered = buckets.withColumn("starts", F.coalesce(apart > gap, F.lit(True)).cast("int")).withColumn(
        "session", F.sum("starts").over(order))
    return numbered.groupBy("sender_domain", "session").agg(
        F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"),
        F.sum("mails").alias("mails"), F.sum("high").alias("high"))
