"""Streams over one batch, over several, with late rows, and after a restart."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from mailsift.plans.corpus import sender_sessions
from mailsift.sources import mail
from mailsift.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of 40 days in four files by time; some rows come one file, but less than a week, late."""
    top = tmp_path_factory.mktemp("orders")
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").limit(600)
    orders = orders.withColumn("h", F.pmod(F.xxhash64("o_orderkey"), F.lit(40 * 24)))
    orders = orders.withColumn("o_orderdate", F.expr("timestamp_ntz'1996-01-01' + make_interval(0, 0, 0, 0, h)"))
    part = F.least(F.floor(F.col("h") / 240) + ((F.col("h") % 240 > 180) & (F.col("h") % 7 == 0)).cast("int"), F.lit(3))
    rows = orders.withColumn("part", part).toPandas()
    for name in ("one", "four", "ordered", "growing"):
        (top / name).mkdir()
    frame = lambda r: spark.createDataFrame(r, jobs.ORDERS).coalesce(1).toPandas()
    for i in range(4):
        for name, chosen in (("four", rows.part == i), ("ordered", rows.h // 240 == i)):
            file = top / name / f"orders-{i}.parquet"
            frame(rows[chosen].drop(columns=["part", "h"])).to_parquet(file, index=False, coerce_timestamps="us")
            os.utime(file, (1e9 + 60 * i, 1e9 + 60 * i))  # files arrive in the order of their times
    frame(rows.drop(columns=["part", "h"])).to_parquet(top / "one" / "orders-0.parquet", index=False, coerce_timestamps="us")
    return top


def messages(spark, folder, name):
    return mail.mails_of(jobs.order_stream(spark, str(folder / name), files_per_batch=1))


def verdicts(df):
    """Stand-in for scoring, which has no state."""
    return df.select("ts", F.when(F.col("msg_id") % 3 == 0, "high").otherwise("clear").alias("band"),
                     F.concat(F.lit("s"), F.col("msg_id") % 5).alias("sender_domain"))


JOBS = {
    "band_window": lambda df, f: jobs.update_available(jobs.band_window(verdicts(df)), ["window_start", "band"], f),
    "sender_burst": lambda df, f: jobs.update_available(jobs.sender_burst(verdicts(df)), ["window_start", "sender_domain"], f),
    "dedupe": lambda df, f: jobs.fresh(jobs.update_available(jobs.sightings(df), ["text_hash", "bucket"], f)),
    "sender_session": lambda df, f: jobs.append_available(jobs.sender_session(verdicts(df), "5 hours"), f),
    "top_domains": lambda df, f: jobs.top_domains(jobs.update_available(jobs.domain_sketch(
        verdicts(df).withColumnRenamed("sender_domain", "domain"), days=3), ["window_start"], f)),
}


@pytest.mark.parametrize("name", JOBS)
def test_batches_and_a_restart_change_nothing(spark, folder, tmp_path, name):
    rows = lambda df: sorted(map(tuple, df.collect()))
    several = "four"
    once = rows(JOBS[name](messages(spark, folder, "one"), str(tmp_path / "one")))
    assert once and once == rows(JOBS[name](messages(spark, folder, several), str(tmp_path / "several")))
    growing = folder / "growing" / name
    growing.mkdir()
    for i in range(4):
        shutil.copy2(folder / several / f"orders-{i}.parquet", growing / f"orders-{i}.parquet")
        if i % 2:  # stopped after two files and started again
            got = JOBS[name](messages(spark, folder, f"growing/{name}"), str(tmp_path / "growing"))
    assert once == rows(got)


def test_a_text_counts_again_after_a_week(spark, folder, tmp_path):
    rows = [(k, 7, d) for k, d in ((1, 1), (1, 3), (1, 9), (1, 20), (1, 27))]  # equal orders make equal texts
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d int").selectExpr(
        "o_orderkey", "o_custkey", "timestamp_ntz'1996-01-01' + make_interval(0, 0, 0, d) as o_orderdate").write.parquet(
        str(tmp_path / "in" / "orders.parquet"))
    stream = mail.mails_of(spark.readStream.schema(jobs.ORDERS).parquet(str(tmp_path / "in" / "orders.parquet")))
    got = jobs.fresh(jobs.update_available(jobs.sightings(stream), ["text_hash", "bucket"], str(tmp_path / "out"))).collect()
    assert sorted(r.ts.day for r in got) == [2, 21]


def test_sessions_of_a_stream_equal_those_of_the_batch(spark, folder, tmp_path):
    """All sessions that are over: the watermark is a week behind the last mail."""
    got = jobs.append_available(jobs.sender_session(verdicts(messages(spark, folder, "four")), "5 hours"), str(tmp_path))
    batch = verdicts(mail.mails_of(spark.read.schema(jobs.ORDERS).parquet(str(folder / "four"))))
    last = batch.agg(F.max("ts")).first()[0]
    ended = sender_sessions(batch, 300).filter(F.col("session_end") + F.expr("interval 7 days 5 hours") <= F.lit(last))
    rows = lambda df: sorted(map(tuple, df.select("sender_domain", "session_start", "session_end", "mails", "high").collect()))
    assert rows(got) == rows(ended) and len(rows(got)) > 20


def test_states_need_no_python(spark, folder):
    stream = messages(spark, folder, "one")
    for df in (jobs.sightings(stream), jobs.sender_session(verdicts(stream)), jobs.domain_sketch(
            verdicts(stream).withColumnRenamed("sender_domain", "domain"))):
        text = df._jdf.queryExecution().analyzed().toString()
        assert "ython" not in text and "Pandas" not in text and "Aggregate" in text


def test_summary_of_more_domains_than_it_tracks(spark, tmp_path):
    """Frequent domains stay within the stated bound however many rare ones arrive."""
    rows = spark.range(40_000).selectExpr("timestamp'1996-01-01' + make_interval(0, 0, 0, id % 60) AS ts",
                                          "CASE WHEN id % 4 = 0 THEN concat('hot', id % 5) ELSE concat('rare', id) END AS domain")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = jobs.update_available(jobs.domain_sketch(stream, tracked=512, lateness="90 days"), ["window_start"], str(tmp_path / "out"))
    assert max(len(r.sketch.sketch) for r in kept.collect()) < 512 * 40
    top = {r.domain: r.messages for r in jobs.top_domains(kept, 5, tracked=512).collect()}
    assert set(top) == {f"hot{i}" for i in range(5)}
    assert all(abs(n - 2000) <= 40_000 * 3.5 / 512 for n in top.values())
