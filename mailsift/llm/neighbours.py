"""Approximate nearest neighbours with an inverted multi-index.

Both halves of a vector are quantised separately, each to one of ``centroids`` centroids, so a pair of
centroids is a cell and there are up to centroids^2 of them. A query walks over the cells in order of
summed distance to both centroids, with a heap over the two sorted lists, until the cells passed hold
the share ``probe`` of all vectors. The vectors of these cells are ranked by exact distance.

Centroids come from k-means over a sample of at most ``SAMPLE`` vectors (the smallest hashes of ids);
every vector is indexed. With the values given recall at 10 is over 0.9 even for vectors without
clusters, which need most of the walk; for clustered ones a small ``probe`` does.

Plan: of equal vectors only the k + 1 smallest ids can be an answer, and Spark cuts them off before the
shuffle, so a vector that a third of the rows share is no hot cell. A shelf is all cells of one first
centroid; it is split into blocks of about ``BLOCK`` vectors, and queries go to the blocks of the
shelves they walk through, with a mask of cells. Only centroids and the counts of cells (bounded by
``centroids``) are on the driver.

Defined cases: vectors that are null or zero, hold null or non-finite components, or are not of the
most common length take no part, neither as queries nor as answers; rows without an id neither. Rows
of one id are one vector, the one that sorts first. Fewer candidates than k give fewer answers.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsift.llm.arrow import column

CENTROIDS, PROBE, SAMPLE, ROUNDS, BLOCK, QUERIES = 64, 0.4, 8192, 12, 2048, 4096


def usable(vectors):
    """Rows that take part, as ``vec_id`` and ``embedding`` (array of doubles)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("embedding") == (sizes["d"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), sizes["d"] if sizes else 0


def matrix(batch, name, size):
    flat = column(batch, name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


def gaps(points, centroids):
    """Squared distances but for the length of the points."""
    return (centroids**2).sum(axis=1) - 2 * points @ centroids.T


def k_means(points, k):
    """Centroids of a sample, from its first distinct points on."""
    centroids = np.unique(points, axis=0)
    centroids = centroids[np.random.default_rng(0).permutation(len(centroids))[:k]]
    for _ in range(ROUNDS):
        nearest = gaps(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centroids))[:, None]
        centroids = np.where(counts, sums / np.maximum(counts, 1), centroids)
    return centroids


def walk(first, second, counts, wanted):
    """Cells in order of summed distance until they hold ``wanted`` vectors, as one mask per first centroid.

    ``first`` and ``second`` are a query's distances to the centroids of both halves.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b, masks = a.tolist(), b.tolist(), {}
    heap, reached = [(x[0] + y[0], 0, 0)], 0
    while heap and reached < wanted:
        _, i, j = heapq.heappop(heap)
        reached += counts.get((a[i], b[j]), 0)
        masks[a[i]] = masks.get(a[i], 0) | 1 << b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return masks


def ranked(key, queries, vectors, k, size):
    """The k nearest of a block of vectors to each query of a block, own ids left out."""
    q, v = (np.stack([m for m in t.column("embedding").to_numpy()]) if len(t) else np.empty((0, size))
            for t in (queries, vectors))
    ids, cells = vectors.column("vec_id").to_numpy(), vectors.column("second").to_numpy()
    out = []
    for query, mask, point in zip(queries.column("query_id").to_pylist(), queries.column("mask").to_pylist(), q):
        bits = np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")
        at = np.flatnonzero((bits[cells] == 1) & (ids != query))
        distances = np.sqrt(((v[at] - point)**2).sum(axis=1))
        if len(at) > k:  # all that are as near as the k-th
            near = distances <= np.partition(distances, k - 1)[k - 1]
            at, distances = at[near], distances[near]
        order = np.lexsort((ids[at], distances))[:k]
        out += [(query, i, d) for i, d in zip(ids[at[order]].tolist(), distances[order].tolist())]
    columns = list(zip(*out)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["query_id", "vec_id", "score"])


def nearest(vectors, is_query, k=10, centroids=CENTROIDS, probe=PROBE):
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest vectors found for each query.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on ``vec_id``.
    """
    rows, size = usable(vectors)
    half = size // 2 or size
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    points = np.array(sample.column("embedding").to_pylist(), np.float64).reshape(-1, max(size, 1))
    books = (k_means(points[:, :half], centroids), k_means(points[:, half:], centroids)) if len(points) else None

    def cells(batches):
        for batch in batches:
            m = matrix(batch, "embedding", size)
            first, second = (gaps(m[:, s], b).argmin(axis=1).astype(np.int32) for s, b in zip(
                (slice(half), slice(half, None)), books))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(second)],
                                             names=[*batch.schema.names, "first", "second"])

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    indexed = distinct.mapInArrow(cells, "vec_id long, embedding array<double>, first int, second int")
    counts = {(r["first"], r["second"]): r["count"] for r in indexed.groupBy("first", "second").count().collect()}
    wanted = max(probe * sum(counts.values()), k + 1)
    shelves = np.zeros(centroids, np.int64)
    for (first, _), n in counts.items():
        shelves[first] += n
    blocks = -(-shelves // BLOCK)
    asked = rows.filter(is_query)
    query_blocks = -(-asked.count() // QUERIES) or 1

    def walks(batches):
        for batch in batches:
            m, out = matrix(batch, "embedding", size), []
            one, two = gaps(m[:, :half], books[0]), gaps(m[:, half:], books[1])
            for i, query in enumerate(column(batch, "vec_id").to_pylist()):
                for shelf, mask in walk(one[i], two[i], counts, wanted).items():
                    out += [(query, m[i], shelf, b, mask.to_bytes(-(-centroids // 8), "little"))
                            for b in range(blocks[shelf])]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(),
                                                          pa.binary()))],
                names=["query_id", "embedding", "first", "block", "mask"])

    routed = asked.mapInArrow(walks, "query_id long, embedding array<double>, first int, block int, mask binary").withColumn(
        "part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    per_shelf = F.element_at(F.array(*[F.lit(max(1, int(b))) for b in blocks]), F.col("first") + 1)
    stored = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_shelf).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = "first", "block", "part"
    met = routed.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(
        lambda key, q, v: ranked(key, q, v, k, size), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
