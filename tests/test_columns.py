from itertools import accumulate

from pyspark.sql import functions as F

from mailsift.functions.columns import offsets, running


def test_running_sums_and_maxima(spark):
    rows = [([],), ([4],), (list(range(50)),), ([3, 9, 2, 9, 1, 0, 12, 5],)]
    got = spark.createDataFrame(rows, "v array<int>").select(
        "v", running(F.col("v"), 0, lambda a, b: a + b).alias("sums"), running(F.col("v"), -1, F.greatest).alias("tops"))
    for r in got.collect():
        assert r.sums == list(accumulate(r.v, initial=0))[:-1] and r.tops == list(accumulate(r.v, max, initial=-1))[:-1]


def test_offsets(spark):
    df = spark.createDataFrame([("ab12c345",), ("7",), ("none",)], "t string")
    got = df.select(offsets(F.split("t", "[0-9]+", -1), F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0))).alias("o"))
    assert [r.o for r in got.collect()] == [[2, 5], [0], []]
