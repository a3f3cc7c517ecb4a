"""Index joins over hosts against the comparison of every host with every brand."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions import domains
from mailsift.plans import dims, lookalikes


@pytest.fixture(scope="module")
def hosts(spark):
    draw = random.Random(5)
    tokens = [t for _, ts, _ in lists.BRANDS for t in ts]
    owned = [d for _, _, ds in lists.BRANDS for d in ds]

    def bent(word):
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word = word[:at] + draw.choice(["", "x", "0", "-"]) + word[at + draw.randrange(2):]
        return word or "x"

    made = [f"{bent(draw.choice(tokens))}{draw.choice(['', '-login', '_x', 'help'])}.{draw.choice(['com', 'co.uk', 'xyz'])}" for _ in range(400)]
    made += [draw.choice(["", "a.b.", "www."]) + bent(draw.choice(owned)) for _ in range(400)] + owned
    made += ["x", "", ".", "a..b", "q" * 300 + ".com", "ünïcode.example", "paypal." * 40 + "com", "203.0.113.9"]
    rows = spark.createDataFrame([(h,) for h in set(made)], "host string").repartition(4)
    return rows.withColumn("registrable", domains.registrable(F.col("host")))


def test_brands_in_hosts(spark, hosts):
    joined = {tuple(r) for r in lookalikes.in_host(hosts, dims.brand_token(spark)).collect()}
    each = hosts.select("host", domains.brand_in_host(F.col("host")).alias("n")).filter("n IS NOT NULL")
    assert joined == {tuple(r) for r in each.collect()} and len(joined) > 200


def test_typosquats(spark, hosts):
    joined = {tuple(r) for r in lookalikes.typosquats(hosts, dims.brand_domain(spark)).collect()}
    each = hosts.select("host", domains.typosquat(F.col("host"), F.col("registrable")).alias("t")).filter("t IS NOT NULL")
    assert joined == {tuple(r) for r in each.select("host", "t.brand", "t.domain", "t.distance").collect()} and len(joined) > 100


def test_brands_of_one_s_own_and_no_rows(spark, hosts):
    tokens = spark.createDataFrame([(1, "qqzz", "qqzz"), (2, "longbrand", "longbrand")], "brand_ord int, brand string, token string")
    mine = spark.createDataFrame([("my-longbrandish.xyz",), ("qqzz.net",), ("aqqzz.net",)], "host string")
    assert {tuple(r) for r in lookalikes.in_host(mine, tokens).collect()} == {("my-longbrandish.xyz", 2), ("qqzz.net", 1)}
    assert lookalikes.in_host(mine.limit(0), tokens).count() == 0 and lookalikes.in_host(mine, tokens.limit(0)).count() == 0
    assert lookalikes.typosquats(hosts, dims.brand_domain(spark).limit(0)).count() == 0


def test_no_host_meets_every_brand(spark, hosts):
    for df in (lookalikes.in_host(hosts, dims.brand_token(spark)), lookalikes.typosquats(hosts, dims.brand_domain(spark))):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text and "Join" in text
