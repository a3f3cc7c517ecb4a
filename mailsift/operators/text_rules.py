"""Language rules over the body, written as Spark SQL text generated from the catalogue."""

from pyspark.sql import functions as F

from mailsift.functions.columns import MARK, STAND_IN, constant, once, sql_text
from mailsift.functions.gates import gate
from mailsift.functions.regex import SPACE, jvm
from mailsift.operators.findings import BARE
from mailsift.operators.rulebook import BUILT_IN

MARGIN = 45
MAX_SNIPPETS = 3


@once
def hit_columns(rules):
    """One boolean per rule; any of its patterns fires it. Cheap word tests come first."""
    test = lambda p: f"({gate('lowered', p)} and body rlike {sql_text(jvm(p))})"
    return {f"hit_{r.rule_id}": constant(" or ".join(map(test, r.patterns))) for r in rules.text_rules}


def with_text_hits(df, rules=BUILT_IN):
    """Adds ``hit_<rule>`` per language rule."""
    return df.withColumn("lowered", F.lower("body")).withColumns(hit_columns(rules)).drop("lowered")


def _snippet(pattern):
    """SQL for the first match of a pattern with its surroundings; null without a match."""
    p, mark = sql_text(jvm(pattern)), sql_text(MARK)
    before = f"substring_index(regexp_replace(replace(body, {mark}, {sql_text(STAND_IN)}), {p}, {mark}), {mark}, 1)"
    found = f"named_struct('start', length({before}), 'match', regexp_extract(body, {p}, 0), 'body', body)"
    around = (f"substring(m.body, greatest(m.start - {MARGIN}, 0) + 1, "
              f"least(m.start, {MARGIN}) + length(m.match) + {MARGIN})")
    tidy = (f"regexp_replace(regexp_replace({around}, {sql_text(f'{SPACE}+')}, ' '), "
            f"{sql_text(r'^ | \z')}, '')")
    return (f"if(body rlike {p}, element_at(transform(array({found}), "
            f"m -> named_struct('text', {tidy}, 'match', m.match)), 1), null)")


def snippets_sql(rule):
    """SQL for at most three snippets of a rule, in pattern order."""
    found = f"filter(array({', '.join(map(_snippet, rule.patterns))}), x -> x is not null)"
    return f"slice({found}, 1, {MAX_SNIPPETS})"


@once
def highlights_column():
    """Per rule that fired its snippets with the matched text and its place in the snippet, -1 if it is not there."""
    def shown(rule):
        return (f"if(hit_{rule.rule_id}, transform({snippets_sql(rule)}, (s, i) -> named_struct('rule_id', "
                f"'{rule.rule_id}', 'ord', i + 1, 'snippet', s.text, 'match', s.match, 'match_at', "
                f"locate(lower(s.match), lower(s.text)) - 1)), array())")
    return constant(f"flatten(array({', '.join(map(shown, BUILT_IN.text_rules))}))")


@once
def findings_column(evidence, rules):
    def found(rule):
        shown = f"transform({snippets_sql(rule)}, s -> s.text)" if evidence else "array()"
        return (f"if(hit_{rule.rule_id}, cast(named_struct('rule_id', '{rule.rule_id}', 'evidence', {shown}, "
                f"'extra', null) as {BARE}), null)")
    return constant(f"filter(array({', '.join(map(found, rules.text_rules))}), x -> x is not null)")


def with_text_findings(df, evidence=True, rules=BUILT_IN):
    """Adds text_findings. Without evidence only the hits are read and the text is scanned once."""
    return df.withColumn("text_findings", findings_column(evidence, rules))
