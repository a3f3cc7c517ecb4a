"""Messages with very many links, files and labels."""

import random
import time

from pyspark.sql import functions as F

from mailsift.functions.columns import contained, is_first, runs, where
from mailsift.operators import attachments, headers, messages, urls
from mailsift.plans.analysis import structure


def one(spark, raw):
    return spark.createDataFrame([(1, raw)], "msg_id long, raw string")


def test_spans_firsts_and_runs_equal_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        spans = [(a, a + draw.randrange(12)) for a in (draw.randrange(60) for _ in range(draw.randrange(9)))]
        items = sorted((a, a + draw.randrange(6)) for a in (draw.randrange(60) for _ in range(draw.randrange(9))))
        rows.append((i, spans, items, [draw.choice(["a", "b", "c", None]) for _ in range(draw.randrange(7))]))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, spans {kind}, items {kind}, names array<string>").repartition(3)
    got = df.select("i", contained(F.col("items"), F.col("spans")).alias("held"), is_first(F.col("names"), lambda x: x).alias("first"),
                    where(F.col("names"), F.transform("names", lambda x: x == "a")).alias("kept"),
                    runs(F.filter("names", lambda x: x.isNotNull()), lambda x: x, lambda x: F.ascii(x)).alias("runs"))
    for r in got.collect():
        _, spans, items, names = rows[r.i]
        assert r.held == [any(s <= a and b <= e for s, e in spans) for a, b in items]
        assert r.first == [x is not None and x not in names[:k] for k, x in enumerate(names)]
        assert r.kept == [x for x in names if x == "a"]
        assert [tuple(x) for x in r.runs] == [(x, ord(x), names.count(x)) for x in sorted({x for x in names if x})]


def test_twenty_thousand_links_and_files(spark):
    parts = [f"https://host{i}.example.com/a/file{i}.zip (plan{i}.pdf.exe) with site{i}.example.org\n" for i in range(20_000)]
    df = one(spark, "see " + "".join(parts) + "https://host7.example.com/a/file7.zip site7.example.org")
    read = lambda: attachments.with_files(urls.with_urls(messages.with_words(headers.with_headers(messages.prepare(df)))))
    began = time.time()
    row = read().select(F.size("urls").alias("urls"), F.size("files").alias("files"), F.col("files")[0].alias("name"),
                        F.col("urls")[20_000]["host"].alias("host")).first()
    assert (row.urls, row.files, row.name, row.host) == (40_000, 20_000, "plan0.pdf.exe", "site0.example.org")
    assert time.time() - began < 60


def test_hosts_of_many_labels_are_found_whole(spark):
    for n in (1, 63, 64, 65, 126, 127, 128, 129, 200, 5000):
        host = "".join(f"l{i}." for i in range(n)) + "com"
        found = structure(one(spark, f"look at {host}.notatld or {host} now")).select("urls").first().urls
        assert [u.host for u in found] == [host]
