"""The shape of a finding and how rows are made of findings."""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions.columns import constant, let

FINDING = ("struct<rule_id:string,points:int,severity:string,sev_rank:int,"
           "evidence:array<string>,extra:string>")


BARE = "struct<rule_id:string,evidence:array<string>,extra:string>"


def finding(rule_id, evidence=(), extra=None):
    """A finding of one rule (an id or a column with one) before its metadata is added."""
    evidence = evidence if not isinstance(evidence, (list, tuple)) else (
        F.array(*evidence) if evidence else constant("cast(array() as array<string>)"))
    return F.struct((F.lit(rule_id) if isinstance(rule_id, str) else rule_id).alias("rule_id"),
                    evidence.alias("evidence"),
                    (constant("cast(null as string)") if extra is None else extra).alias("extra"))


def no_findings():
    return constant(f"cast(array() as array<{BARE}>)")


def with_metadata(findings, rules):
    """Adds what the score needs of each finding's rule, from one constant map (a row per rule)."""
    meta = constant("map({})".format(", ".join(
        f"'{r.rule_id}', named_struct('points', {r.points}, 'severity', '{r.severity}', "
        f"'sev_rank', {lists.SEVERITIES[r.severity][0]})" for r in rules.rules)))
    return F.transform(findings, lambda f: let(F.element_at(meta, f["rule_id"]), lambda m: F.struct(
        f["rule_id"], m["points"], m["severity"], m["sev_rank"], f["evidence"], f["extra"]).cast(FINDING)))


def rows(df, column, *keep):
    """One row per finding of ``column``, with its 1-based place as ``seq``.

    The expression (rather than a bare column) keeps the optimiser from adding a
    size filter below the generator, which would run the extraction twice.
    """
    items = F.filter(F.col(column), lambda f: f.isNotNull())
    return (df.select(*keep, F.posexplode(items).alias("pos", "f"))
            .select(*keep, (F.col("pos") + 1).cast("bigint").alias("seq"), "f.*"))
