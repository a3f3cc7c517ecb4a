"""Rules read from tables."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators.rulebook import BUILT_IN, RuleBook
from mailsift.plans import dims, reports
from mailsift.plans.analysis import analyse, verdict
from mailsift.sources import mail

SF = "/root/testdata/sf0.001"
RULE = (99, "lottery", "body", "Money and payments", "high", 11, "A lottery", "Nobody wins what they did not enter.", "Bin it.")


@pytest.fixture
def tables(spark):
    return dims.rule_table(spark), dims.rule_pattern(spark), dims.rule_combo(spark)


def add(table, *rows):
    return table.union(table.sparkSession.createDataFrame(list(rows), table.schema))


def messages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "msg_id long, raw string")


def test_the_built_in_tables_give_the_built_in_rules(spark, tables):
    book = RuleBook.from_tables(*(t.orderBy(F.rand(1)) for t in tables))
    assert book.rules == BUILT_IN.rules and book.combos == BUILT_IN.combos
    some = mail.mails(spark, SF).filter("msg_id < 800")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(verdict(analyse(some, evidence=False, rules=book))) == rows(verdict(analyse(some, evidence=False)))


def test_a_row_more_is_a_rule_more(spark, tables):
    rule, pattern, combo = tables
    book = RuleBook.from_tables(add(rule, RULE, (100, "combo_lottery", "combination", "Combination of findings", "high", 20, "Both", "w", "a")),
                                add(pattern, ("lottery", 1, r"\blottery\b[^.]{0,20}\bwon\b")),
                                add(combo, ("combo_lottery", 1, 1, "lottery"), ("combo_lottery", 2, 1, "shortened_url")))
    df = messages(spark, "The Lottery you won!", "lottery", "lottery: won, see http://bit.ly/x")
    rows = analyse(df, rules=book).orderBy("msg_id").collect()
    own = [[(f.rule_id, f.points) for f in r.findings if "lottery" in f.rule_id] for r in rows]
    assert own == [[("lottery", 11)], [], [("lottery", 11), ("combo_lottery", 20)]]
    assert rows[0].raw_score == 11 and rows[0].findings[0].evidence == ["The Lottery you won!"]
    text = reports.report_text(analyse(df, rules=book), book).filter("msg_id = 0").first().report
    assert "+11 A lottery" in text and "advice: Bin it." in text


def test_points_change_and_rules_go(spark, tables):
    rule, pattern, combo = tables
    df = messages(spark, "please confirm your password at http://bit.ly/x")
    before = analyse(df).first()
    changed = RuleBook.from_tables(rule.withColumn("points", F.expr("if(rule_id = 'password_request', 1, points)")), pattern, combo)
    assert before.raw_score - analyse(df, rules=changed).first().raw_score == 17
    fewer = RuleBook.from_tables(rule.filter("rule_id <> 'shortened_url'"), pattern, combo.filter("member <> 'shortened_url'"))
    assert "shortened_url" not in {f.rule_id for f in analyse(df, rules=fewer).first().findings}


@pytest.mark.parametrize("rows, words", [
    ([("lottery", 1, "(")], "lottery"), ([], "no pattern"), ([("lottery", 1, "x")] * 10_001, "more than")])
def test_bad_patterns_are_refused(spark, tables, rows, words):
    rule, pattern, combo = tables
    with pytest.raises(ValueError, match=words):
        RuleBook.from_tables(add(rule, RULE), add(pattern, *rows) if rows else pattern, combo)


@pytest.mark.parametrize("place, value", [(1, "password_request"), (1, "a b"), (2, "url"), (2, "nowhere"), (4, "fatal"), (5, -1), (5, None)])
def test_bad_rules_are_refused(spark, tables, place, value):
    rule, pattern, combo = tables
    row = tuple(value if i == place else v for i, v in enumerate(RULE))
    with pytest.raises(ValueError):
        RuleBook.from_tables(add(rule, row), add(pattern, (row[1], 1, "x")), combo)


def test_registry_order_is_collated(spark):
    rows = spark.createDataFrame([(i, f"r{i}", "body", "c", "low", 5, t, "", "") for i, t in enumerate(["SPF", "Shown", "éclair", "zebra", "Eel"])],
                                 dims.rule_table(spark).schema)
    assert [r.title for r in dims.ranked(rows).orderBy("registry_rank").collect()] == ["éclair", "Eel", "Shown", "SPF", "zebra"]
