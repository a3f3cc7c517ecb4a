"""Stored reports, and files in and out."""

import os

import pytest
from pyspark.sql import functions as F

from mailsift.plans import corpus, maintained, reports
from mailsift.plans.analysis import analyse, verdict
from mailsift.sources import files, mail
from mailsift.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two increments of mails; the second is stored twice, at first with rows that do not belong there."""
    top = str(tmp_path_factory.mktemp("reports"))
    mails = mail.mails(spark, SF)
    for part, chosen in (("1996-01-01", "msg_id % 8 = 0"), ("1996-01-02", "msg_id % 24 = 0"), ("1996-01-02", "msg_id % 8 = 4")):
        maintained.store(analyse(mails.filter(chosen), evidence=False), top, part)
    return top


def test_reports_equal_the_full_scan(spark, folder):
    whole = analyse(mail.mails(spark, SF), evidence=False)
    assert rows(maintained.band_distribution(spark, folder)) == rows(corpus.band_distribution(spark, whole))
    assert rows(maintained.rule_cooccurrence(spark, folder)) == rows(corpus.rule_cooccurrence(whole))
    assert rows(maintained.domain_leaderboard(spark, folder)) == rows(corpus.domain_leaderboard(whole))
    assert rows(maintained.sender_profile(spark, folder)) == rows(corpus.sender_profile(whole))
    assert rows(maintained.rule_prevalence(spark, folder)) == rows(
        corpus.rule_prevalence(spark, whole).select("rule_id", "messages", "points_given"))


def test_reading_neither_scores_nor_reads_other_parts(spark, folder):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(maintained.all_reports(spark, folder))
    assert "rlike" not in text.lower() and "facts" not in text
    text = plan(maintained.stored(spark, folder, parts=["1996-01-02"]))
    assert "PartitionFilters: [" in text and "1996-01-02" in text
    one = maintained.stored(spark, folder, parts=["1996-01-02"])
    assert one.count() == mail.mails(spark, SF).filter("msg_id % 8 = 4").count()


def test_a_part_without_messages_and_a_bad_name(spark, folder, tmp_path):
    none = analyse(mail.mails(spark, SF).limit(0), evidence=False)
    maintained.store(none, str(tmp_path / "none"), "p")
    assert {r.messages for r in maintained.band_distribution(spark, str(tmp_path / "none")).collect()} == {0}
    with pytest.raises(ValueError):
        maintained.store(none, folder, "../x")


def test_reports_as_files_by_band(spark, tmp_path):
    made = reports.report_json(analyse(mail.mails(spark, SF).filter("msg_id < 400")))
    files.write_reports(made, str(tmp_path / "out"))
    back = files.read_reports(spark, str(tmp_path / "out"))
    assert rows(reports.report_fields(back)) == rows(reports.report_fields(made))
    text = back.filter("band = 'high'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in text
    spark.read.json(str(tmp_path / "out")).select("msg_id", "score", "findings", "band").collect()


def test_a_stream_of_message_files(spark, tmp_path):
    """Whole files, the ids of the batch reader, and only new files after a restart."""
    mails = tmp_path / "in" / "deep"
    mails.mkdir(parents=True)

    def drop(name, text):
        (mails / name).write_text(text, newline="")

    def run():
        scored = verdict(analyse(files.eml_stream(spark, str(tmp_path / "in"), files_per_batch=1), evidence=False), "ts")
        return jobs.append_available(scored, str(tmp_path / "work"))

    drop("a.eml", "Subject: x\r\nFrom: a@b.com\r\n\r\nA penalty applies.\n\nOr else.")
    drop("empty.eml", "")  # a file without a byte gives no row
    drop("blank.eml", "\n")
    drop("note.txt", "A penalty applies.")
    assert sorted(r.score for r in run().collect()) == [0, 9]
    drop("c.eml", "see http://bit.ly/x ünï")
    got = run()
    batch = verdict(analyse(files.read_eml(spark, str(tmp_path / "in")), evidence=False))
    assert rows(got.select(batch.columns)) == rows(batch) and got.count() == 3
    assert got.filter(F.col("ts").isNull()).count() == 0 and os.listdir(tmp_path / "work" / "out")
