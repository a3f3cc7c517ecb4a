"""From findings to a verdict: combinations, score, band, statistics, order, advice."""

from pyspark.sql import functions as F

from mailsift.data import catalogue, lists
from mailsift.functions.columns import among, compact, constant, first_of_each, let, once, sql_text, text_list
from mailsift.operators.findings import finding, with_metadata
from mailsift.operators.rulebook import BUILT_IN

PARTS = ["text_findings", "url_findings", "attachment_findings", "html_findings", "header_findings"]


def with_hosts(df):
    """Adds hosts: distinct link hosts in order."""
    return df.withColumn("hosts", F.array_distinct(F.transform("urls", lambda u: u["host"])))


@once
def _findings(rules):
    def combos(ids):
        def combo(rule):
            first, second = rules.combos[rule.rule_id]
            shown = F.slice("hosts", 1, 2) if rule.rule_id == "combo_credential_link" else ()
            return F.when(F.arrays_overlap(ids, text_list(first)) & F.arrays_overlap(ids, text_list(second)),
                          finding(rule.rule_id, shown))
        return compact(*[combo(r) for r in rules.combo_rules])

    return with_metadata(F.concat("base_findings", let(
        F.transform("base_findings", lambda f: f["rule_id"]), combos)), rules)


def with_findings(df, rules=BUILT_IN):
    """Adds base_findings (all but combinations) and findings (with them), in order of insertion."""
    base = F.concat(*PARTS)
    if rules is not BUILT_IN:  # what shows a rule that is not in the tables does not count
        base = F.filter(base, lambda f: among(f["rule_id"], rules.ids))
    return df.withColumn("base_findings", base).withColumn("findings", _findings(rules))


def band_of(score):
    chain = F.when(F.lit(False), F.lit(""))
    for band, low, high, _, _ in catalogue.BANDS:
        chain = chain.when(score.between(low, high), F.lit(band))
    return chain


def _is_severity(severity):
    return lambda f: f["severity"] == severity


@once
def _raw_score():
    return F.aggregate("findings", F.lit(0).cast("bigint"), lambda acc, f: acc + f["points"])


@once
def _statistics():
    count = lambda condition: F.size(F.filter("findings", condition)).cast("bigint")
    return {
        "capped": F.col("raw_score") > lists.MAX_SCORE, "band": band_of(F.col("score")),
        **{f"n_{s}": count(_is_severity(s)) for s in lists.SEVERITIES},
        "n_counted": count(lambda f: f["points"] > 0)}


def with_score(df):
    """Adds raw_score, score, capped, band and a count per severity."""
    df = df.withColumn("raw_score", _raw_score())
    df = df.withColumn("score", F.least(F.col("raw_score"), F.lit(lists.MAX_SCORE).cast("bigint")))
    return df.withColumns(_statistics())


def ordered(findings, documented=False):
    """Findings in display order with their place (seq) in order of insertion.

    The order really used puts critical last; the documented one puts it first.
    """
    rank = lambda f: f["sev_rank"] if not documented else F.when(
        f["severity"] == "critical", F.lit(0)).otherwise(f["sev_rank"])
    return F.transform(F.sort_array(F.transform(findings, lambda f, i: F.struct(
        rank(f).alias("rank"), (-f["points"]).alias("points"), (i + 1).alias("seq"), f.alias("f")))),
        lambda x: F.struct(x["seq"].alias("seq"), x["f"].alias("f")))


def _advice_item(tag, text):
    return F.struct(tag.alias("tag"), text.alias("text"))


def _standing(key):
    tag, text = catalogue.ADVICE[key]
    return _advice_item(F.lit(tag), F.lit(text))


@once
def _recommendations(rules):
    advice_of = constant("map({})".format(", ".join(
        f"'{r.rule_id}', {sql_text(r.advice)}" for r in rules.rules)))
    scoring = F.filter(ordered(F.col("findings")), lambda x: x["f"]["points"] > 0)
    own = F.transform(scoring, lambda x: _advice_item(
        F.lit(catalogue.FINDING_ADVICE_TAG), F.element_at(advice_of, x["f"]["rule_id"])))
    key = lambda r: F.substring(F.lower(r["text"]), 1, catalogue.ADVICE_KEY_LENGTH)
    candidates = F.concat(
        compact(_standing("never_test"), F.when(F.col("band") == "high", _standing("acted_now"))),
        own, F.array(_standing("verify"), _standing("report")))

    def says(items, words):
        return F.exists(items, lambda r: r["text"].rlike(f"(?i){words}"))

    def close(items):
        return let(F.concat(items, compact(F.when(says(items, "bank details|payment"), _standing("bank_call")))),
                   lambda more: first_of_each(F.concat(more, compact(
                       F.when(says(more, "macro"), _standing("macro_care")),
                       F.when(F.col("n_counted") == 0, _standing("quiet")),
                       _standing("keep_evidence"))), key))

    return F.slice(let(first_of_each(candidates, key), close), 1, catalogue.MAX_ADVICE)


def with_recommendations(df, rules=BUILT_IN):
    """Adds recommendations: ordered advice, each once, at most eight."""
    return df.withColumn("recommendations", _recommendations(rules))
