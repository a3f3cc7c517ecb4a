"""What keeps a message cheap must not change what is found in it."""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions import domains
from mailsift.functions.columns import among


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_lists_are_hash_sets(spark):
    rows = spark.createDataFrame([("gmail.com",), ("gmail",), ("",), ("gmail.com,x",), (None,)], "x string")
    found = rows.select(among(F.col("x"), ["gmail.com", *map(str, range(40))]).alias("found"))
    assert "INSET" in plan(found).upper() and "find_in_set" not in plan(found)
    assert [r.found for r in found.collect()] == [True, False, False, False, None]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_typosquats_and_brands_as_by_hand(spark):
    hosts = ["paypa1.example", "www.paypal.com", "a-netflx-b.example", "gogle.example", "amazn-appel.example", "x.example", "ups-dhl.example",
             "mydhl.example", "dhl.example", "micros0ftonline.example", "faceboook.co.uk", "", "instagramm-paypall.xyz", "s_team.example",
             "h\u00e9lloydsbanc.example"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    reg = domains.registrable(F.col("h"))
    told = rows.select("h", domains.typosquat(F.col("h"), reg).alias("t"), domains.label_tokens(F.col("h")).alias("tokens"), reg.alias("reg"),
                       domains.core_of(reg).alias("core"), domains.brand_in_host(F.col("h")).alias("brand")).orderBy("i").collect()
    for r in told:
        words = dict.fromkeys(w for w in [*r.tokens, r.core.replace("-", "").replace("_", "")]
                              if len(w) >= 5 and w not in lists.HOST_STOPWORDS)
        hits = [(b, d, near[0]) for b, d, c in domains.typosquat_targets()
                if (near := [n for w in words if 1 <= (n := distance(w, c)) <= 2])]
        wanted = hits[0] if hits and r.reg not in domains.official_domains() else None
        assert (tuple(r.t) if r.t else None) == wanted, r.h
        parts = f".{r.h.replace('-', '.').replace('_', '.')}."
        brand = [n for n, (_, tokens, _) in enumerate(lists.BRANDS, 1)
                 if any((f".{t}." in parts) if len(t) < 5 else t in r.h for t in tokens)]
        assert r.brand == (brand[0] if brand else None), r.h
