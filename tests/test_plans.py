"""Shape of the plans and helpers that results rest on."""

import re

from pyspark.sql import functions as F

from mailsift.data.catalogue import TEXT_RULES
from mailsift.functions import domains
from mailsift.functions.gates import word_groups
from mailsift.operators.findings import rows
from mailsift.plans.analysis import analyse, verdict
from mailsift.plans.corpus import sender_sessions
from mailsift.sources import files, mail

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_does_not_shuffle(spark):
    text = plan(verdict(analyse(mail.mails(spark, SF), evidence=False)))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert "o_orderkey" in text and "o_totalprice" not in text


def test_rows_do_not_repeat_the_extraction(spark):
    text = plan(rows(analyse(mail.mails(spark, SF), evidence=False), "findings", "msg_id").select("rule_id"))
    assert "Generate" in text and text.count("size(findings") == 0


def test_gates_never_hide_a_match():
    samples = ["please confirm your password", "buy gift cards", "6-digit code", "click \"enable macros\"", "act now",
               "change of bank details", "your parcel is held", "we detected an attempt", "within 3 days or else"]
    for rule in TEXT_RULES:
        for p in rule.patterns:
            for s in samples:
                if re.search(p, s, re.I | re.A):
                    assert all(any(w in s.lower() for w in g) for g in word_groups(p)), (p, s)


def test_domains(spark):
    hosts = ["login.barclays.co.uk", "paypal.com", "CO.UK", "a.b.c.d.", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.reg, r.core) for r in df.select("h", domains.registrable(F.col("h")).alias("reg"), domains.core_of(
        domains.registrable(F.col("h"))).alias("core")).collect()}
    assert got["login.barclays.co.uk"] == ("barclays.co.uk", "barclays")
    assert got["paypal.com"] == ("paypal.com", "paypal") and got["CO.UK"] == ("co.uk", "co.uk")
    assert got["a.b.c.d."] == ("c.d", "c") and got["localhost"] == ("localhost", "localhost")


def test_sessions_match_brute_force(spark):
    minutes = [0, 3, 9, 30, 31, 45, 54, 64, 100]
    df = spark.createDataFrame([("s", m * 60, "high") for m in minutes], "sender_domain string, sec long, band string")
    got = sorted((r.session_start, r.session_end, r.mails) for r in sender_sessions(
        df.withColumn("ts", F.timestamp_seconds("sec")), 10).select(
            F.unix_timestamp("session_start").alias("session_start"),
            F.unix_timestamp("session_end").alias("session_end"), "mails").collect())
    expected, start, last, n = [], None, None, 0
    for m in minutes:
        if last is not None and m - last > 10:
            expected.append((start * 60, last * 60, n))
            start, n = None, 0
        start, last, n = m if start is None else start, m, n + 1
    assert got == expected + [(start * 60, last * 60, n)]


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(["A penalty applies.", "hello"]):
        (tmp_path / "in" / f"{i}.eml").write_text(text)
    scored = verdict(analyse(files.read_eml(spark, str(tmp_path / "in")), evidence=False))
    files.write_partitioned(scored, str(tmp_path / "out"))
    assert sorted(r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 9]
