import duckdb
import pytest
from pyspark.sql import functions as F

from mailsift.llm import reputation
from mailsift.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(ORACLE_SQL["op4_host_reputation"])
    df = QUERIES["op4_host_reputation"](spark, SF)
    assert df.columns == expected.columns and df.dtypes[-1] == ("bad", "bigint")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, expected.fetchall()))


CASES = {
    "http://Shop.NET/a?b#c": ("shop.net", "/a", "net/"), "http://net/": ("net", "/", "net/"), "http://a.net": ("a.net", "", None),
    "https://x.example.net/en/1": ("x.example.net", "/en/1", "example.net/en/"),
    "https://example.net/EN/1": ("example.net", "/EN/1", "net/"), "a://example.com/de/?q": ("example.com", "/de/", "example.com/de/"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None), "http://w.org/fr/x": ("w.org", "/fr/x", "org/fr/"),
    "http://w.org?u=http://a.net/": ("w.org", "", None), "no scheme": ("", "", None), "": ("", "", None), None: ("", "", None),
    "x://": ("", "", None), "http://É.net/\n/z": ("É.net", "/\n/z", "net/"),
}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(CASES)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in reputation.judge(pages, labels).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert reputation.judge(pages.limit(0), labels).count() == 0


@pytest.mark.parametrize("limit,verdict", [(0.2, "block"), (1.0, "allow")])
def test_bad_hosts_are_blocked_and_new_hosts_lean_on_their_domain(spark, limit, verdict):
    rows = [(i, f"http://{h}.farm.test/x") for i, h in enumerate(["a"] * 60 + ["b"] * 60)]
    rows += [(1000 + i, f"http://h{i % 20}.good.test/x") for i in range(400)] + [(2000, "http://new.farm.test/"), (2001, None)]
    labels = [(i, 1) for i in range(120)] + [(1000 + i, int(i % 50 == 0)) for i in range(400)] + [(2001, None), (9999, 1)]
    got = {r.page_id: r for r in reputation.judge(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"),
        limit=limit).collect()}
    assert got[0].verdict == verdict and got[1003].verdict == "allow" and len(got) == len(rows)
    assert got[2000].labelled == 0 and got[2000].posterior_mean > 0.5 > got[1003].posterior_mean


def test_levels_are_registered_domains(spark):
    cases = {"a.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk:80": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "b.com.au": ("b.com.au", "com.au"), "x.example.net": ("example.net", "net"), "net": ("net", "net"), "": ("", ""),
             "10.1.2.3": ("10.1.2.3", "[ip]"), "u@10.1.2.3:8080": ("10.1.2.3", "[ip]"), "[::1]:80": ("[::1]", "[ip]")}
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    got = {r[0]: (r[1], r[2]) for r in hosts.select("host", *reputation.levels(F.col("host"))).collect()}
    assert got == cases


def test_a_hot_site_does_not_block_others_below_its_suffix(spark):
    rows = [(i, f"http://{h}/x") for i, h in enumerate(["bad.co.uk"] * 300 + [f"h{i % 40}.co.uk" for i in range(200)] + ["new.co.uk"])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(500)], "page_id long, bad int")
    got = {r.host: r for r in reputation.judge(pages, labels).collect()}
    assert got["bad.co.uk"].verdict == "block" and got["h1.co.uk"].prior_mean < 0.3 < got["bad.co.uk"].prior_mean


def test_suffixes_ips_and_repeats_equal_sql(spark):
    hosts = ["a.shop.co.uk", "b.shop.co.uk:80", "shop.co.uk", "co.uk", "other.co.uk", "x.com.au", "10.1.2.3", "u@10.1.2.3:8080", "10.1.2.4",
             "[::1]:80", "[2001:db8::1]", "1.2.3.456", "q.example.net", "example.net.", "net", "", "plain", "a..b"]
    pages = [(i % 390, f"http://{hosts[i * 7 % 18]}/p{i % 3}") for i in range(400)] + [(500 + i, f"https://{h}/") for i, h in enumerate(hosts)]
    pages += [(600, None), (601, "none"), (None, "http://a.shop.co.uk/")]
    bad, good = ((0, 0), (1, 1), (None, 1), (0, None), (1, 0), (None, None)), ((1, 0), (1, None), (None, 0), (1, 0), (None, None), (1, 0))
    labels = [(i, *(bad if i * 7 % 18 in (0, 1, 4, 6, 9, 14) else good)[i % 37 % 6]) for i in range(400)] + [(3, 0, 0), (None, 0, 0)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    con.register("labels", labels.toArrow())
    expected = con.sql(ORACLE_SQL["op4_host_reputation"])
    got = reputation.judge(pages, labels.select(F.col("doc_id").alias("page_id"), reputation.outcome().alias("bad")))
    assert sorted(map(tuple, got.select(*expected.columns).collect()), key=str) == sorted(map(tuple, expected.fetchall()), key=str)
    assert {r.verdict for r in got.filter("rule is null").collect()} == {"allow", "block"}
    known = {r[0]: (r[1], r[2]) for r in con.sql(ORACLE_SQL["op4_host_reputation"].split("hosts AS (", 1)[0].rstrip().rstrip(",")
                                                 + " SELECT host, domain, suffix FROM level").fetchall()}
    rows = got.select("host").distinct().select("host", *reputation.levels(F.col("host"))).collect()
    assert known == {r[0]: (r[1], r[2]) for r in rows}
