"""Connected components of a graph given by its edges."""

from pyspark.sql import functions as F

from mailsift.sources.shared import cut_lineage


def components(edges):
    """``node``, ``root`` for every node of the undirected ``edges`` (``a``, ``b``): root is the smallest node reachable.

    Every round links each node to the smallest node among its neighbours and itself, and that node's
    own neighbours likewise (large star, then small star). Edges never grow in number, a path of n
    nodes takes about log n rounds, and each round is two aggregations, cut in lineage by a checkpoint
    in the shared folder. A node with very many neighbours is never collected: only the minimum over
    its edges is kept, aggregated before the shuffle, and joined back.
    """
    links = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
                                              .alias("a"), F.col("m").alias("b"))
        links = cut_lineage(small.filter("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
