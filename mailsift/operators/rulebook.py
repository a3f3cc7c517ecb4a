"""The rules that a plan is compiled from: the built-in catalogue, or tables of one's own.

Rules over the text (source ``body``) and combinations are data altogether: a new row in the tables is a
new rule, with its word gates, its points, its place among the findings and its advice. Rules of the other
sources have code behind them; their rows set points, severity, texts, and whether the rule counts at all.
"""

import re
from functools import cached_property

from pyspark.sql import functions as F

from mailsift.data import catalogue, lists
from mailsift.data.catalogue import Rule

MOST_RULES, MOST_PATTERNS, MOST_MEMBERS = 2_000, 10_000, 20_000  # a plan is compiled from them on the driver


class RuleBook:
    def __init__(self, rules, combos):
        """``rules`` in the order in which findings stand; ``combos`` has two lists of rules by combination."""
        self.rules, self.combos = list(rules), dict(combos)
        self._check()

    def _check(self):
        ids = [r.rule_id for r in self.rules]
        known = set(ids)
        if len(known) < len(ids):
            raise ValueError(f"rules stand twice: {sorted({i for i in ids if ids.count(i) > 1})}")
        for r in self.rules:
            if not re.fullmatch(r"\w+", r.rule_id or "", re.A):
                raise ValueError(f"rule id {r.rule_id!r} is no word")
            if r.severity not in lists.SEVERITIES or r.points is None or r.points < 0:
                raise ValueError(f"rule {r.rule_id}: severity {r.severity!r}, points {r.points!r}")
            if r.source not in catalogue.REGISTRY_SOURCE:
                raise ValueError(f"rule {r.rule_id}: unknown source {r.source!r}")
            if r.source == "body" and not r.patterns:
                raise ValueError(f"rule {r.rule_id} has no pattern")
            if r.source == "combination" and not all(self.combos.get(r.rule_id, ())):
                raise ValueError(f"combination {r.rule_id} needs two lists of rules")
            if r.source not in ("body", "combination") and r.rule_id not in catalogue.RULE_BY_ID:
                raise ValueError(f"rule {r.rule_id}: only rules over the text and combinations can be added as rows")
            for p in r.patterns:
                try:
                    re.compile(p)
                except re.error as wrong:
                    raise ValueError(f"rule {r.rule_id}: {p!r}: {wrong}") from wrong
        for combo, clauses in self.combos.items():
            strange = {m for members in clauses for m in members} | {combo}
            if strange - known:
                raise ValueError(f"combination {combo}: no rules {sorted(strange - known)}")

    @cached_property
    def text_rules(self):
        return [r for r in self.rules if r.source == "body"]

    @cached_property
    def combo_rules(self):
        return [r for r in self.rules if r.source == "combination"]

    @cached_property
    def ids(self):
        return [r.rule_id for r in self.rules]

    @classmethod
    def from_tables(cls, rule, rule_pattern, rule_combo):
        """The rules of three tables, shaped like those of ``plans.dims``.

        ``rule`` (place, rule_id, source, category, severity, points, title, why, advice), ``rule_pattern``
        (rule_id, ord, pattern), ``rule_combo`` (rule_id, clause, ord, member; clause 1 or 2). Tables beyond
        a catalogue's size are refused, as every row becomes part of the plan.
        """
        def read(df, most, *order):
            rows = df.orderBy(*order).limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} rows in a table of rules")
            return rows

        patterns, combos = {}, {}
        for r in read(rule_pattern, MOST_PATTERNS, "rule_id", "ord", "pattern"):
            patterns.setdefault(r.rule_id, []).append(r.pattern)
        for r in read(rule_combo, MOST_MEMBERS, "rule_id", "clause", "ord", "member"):
            if r.clause not in (1, 2):
                raise ValueError(f"combination {r.rule_id}: clause {r.clause!r}")
            combos.setdefault(r.rule_id, ([], []))[r.clause - 1].append(r.member)
        text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
        rules = rule.select("place", "rule_id", text("source"), text("category"), text("severity"),
                            F.col("points").cast("int").alias("points"), text("title"), text("why"), text("advice"))
        return cls([Rule(r.rule_id, r.source, r.category, r.severity, r.points, r.title, r.why, r.advice,
                         patterns.get(r.rule_id, ())) for r in read(rules, MOST_RULES, "place", "rule_id")], combos)


BUILT_IN = RuleBook(catalogue.ALL_RULES, catalogue.COMBO_CLAUSES)
