"""Queries against the same questions asked in SQL of a second engine."""

import datetime

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# The full set is compared by the driver; these cover each part of the pipeline once.
CHECKED = ["header_kv", "url_flags", "findings_union", "verdict", "recommendations", "duplicate_collapse",
           "stream_dedupe", "sender_session", "stream_session", "stream_domain_leaderboard", "band_lookup", "band_distribution", "golden_check", "remote_hosts", "header_gate",
           "text_evidence", "lookup_dims", "custom_rules", "rule_registry", "report_export", "maintained_reports", "host_profile", "typosquat", "brand_lookalike", "report_fields", "report_json", "report_text"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    from mailsift.plans.queries import QUERIES
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.sql(oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_golden_copies_all_pass(spark):
    wrong = queries()["golden_check"](spark, SF).filter("failed or raw_score <> expected_raw")
    assert wrong.count() == 0


def test_reports(spark):
    import json
    reports = queries()["report_json"](spark, SF).orderBy("msg_id").limit(5).collect()
    parsed = [json.loads(r.report) for r in reports]
    assert parsed[0]["score"] == 100 and parsed[0]["band"]["id"] == "high"
    assert parsed[0]["findings"][0]["evidence"] and len(parsed[0]["recommendations"]) == 8
    text = queries()["report_text"](spark, SF).orderBy("msg_id").limit(1).collect()[0].report
    assert "Score 100 of 100: High Risk" in text and "FINDINGS: 15" in text and "\n  1) " in text


def test_entry(spark):
    assert entry(spark).columns == ["msg_id", "raw_score", "score", "band"]
