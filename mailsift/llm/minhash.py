"""Near-duplicate documents by a signature-coordinate inverted join.

Every document gets a signature of ``COORDINATES`` values over its set of word shingles, each the
combination of ``EACH`` MinHash values, and is posted under each pair (coordinate, value). Two
documents of similarity J agree on a coordinate with probability J ** EACH; at the wanted similarity
they agree on at least ``needed`` of them but for a chance of ``MISS``.

* Prefix: with postings ordered by length, shortest first, a pair that agrees on ``needed`` of k
  coordinates shares a posting among the first k - needed + 1 of both. Only those are merged. Postings
  of one document come first in the order and cannot be shared, so a text without relatives has no
  posting left, and the long postings of frequent shingles come last.
* Skip: equal shingle sets are one class and only the smallest id of it is posted. In the first merge
  each document is held against one partner, the head of a posting with which it collides most
  often. Postings whose members are then in one component are skipped. Of the others all pairs across
  components are tried (links within one change nothing) that can be similar enough: two sets of sizes
  x and y then have t / (1 + t) (x + y) shingles in common, so with shingles ordered by frequency,
  rarest first, their first common one must stand early enough in both to leave room for the rest.
* Collisions over all coordinates are counted for every candidate, and pairs at or above the match
  threshold are confirmed on the sets of shingles of the whole texts.

So a group of thousands of near copies costs one comparison per copy, and no link that could join two
components is left out.

Defined cases: a document without words (or a null text) has no shingles and is linked with nothing;
one with fewer words than a shingle has its whole sequence as the only one; rows of one id are one
document; rows without an id are not linked and stay.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.llm.arrow import as_bytes, column, mix, whole_texts, window_hashes, word_hashes
from mailsift.llm.components import components
from mailsift.sources.shared import cut_lineage

COORDINATES = 32
EACH = 3  # MinHash values in a coordinate
MISS = 1e-5
ROWS = 2048  # shingles hashed at a time, for texts of any length

_draw = np.random.default_rng(20240229)
MULTIPLY = _draw.integers(1, 2**63, COORDINATES * EACH, np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _draw.integers(0, 2**63, COORDINATES * EACH, np.uint64)
COORDINATE = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(56)


def needed(percent, coordinates=COORDINATES, miss=MISS):
    """The most agreeing coordinates that a pair at the threshold reaches but for a chance of ``miss``."""
    p, tail = (percent / 100) ** EACH, 0.0
    for matches in range(coordinates + 1):
        tail += math.comb(coordinates, matches) * p**matches * (1 - p) ** (coordinates - matches)
        if tail > miss:
            return max(1, matches)


def shingles(text, size):
    """The set of word shingles of a text, as tuples of lower-case words."""
    words = text.lower().split()  # of bytes: white space and case of ASCII only
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def shingle_hashes(text, size):
    words = text.lower().split()
    return np.unique(window_hashes(word_hashes(words), max(1, min(size, len(words)))))


def signature(hashes):
    """The coordinates of a non-empty set, each with its number mixed in."""
    smallest = np.full(COORDINATES * EACH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), ROWS):
        part = (hashes[at:at + ROWS, None] ^ FLIP) * MULTIPLY
        np.minimum(smallest, part.min(axis=0), out=smallest)
    value = COORDINATE
    for part in smallest.reshape(EACH, COORDINATES):
        value = mix(part + mix(value))
    return value


def features(docs, size):
    """``doc_id``, ``n_shingles``, a 128-bit hash of the set (``h1``, ``h2``) and the ``signature``."""
    def run(batches):
        for batch in batches:
            counts, first, second, signatures = [], [], [], []
            with np.errstate(over="ignore"):
                for text in as_bytes(batch):
                    hashes = shingle_hashes(text, size)
                    counts.append(len(hashes))
                    first.append(int(hashes.sum(dtype=np.uint64).view(np.int64)))
                    second.append(int(mix(hashes).sum(dtype=np.uint64).view(np.int64)))
                    signatures.append(signature(hashes).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "h1", "h2", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature array<long>")


def confirmed(pairs, texts, size, percent):
    """The pairs (``a``, ``b``) whose sets have a Jaccard similarity of at least ``percent`` percent."""
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select(
        "a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            keep, last, left = [], None, set()
            for x, y in zip(as_bytes(batch, "text_a"), as_bytes(batch, "text_b")):
                if x != last:
                    last, left = x, shingles(x, size)
                right = shingles(y, size)
                both = len(left & right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs, size=5, percent=80, key="doc_id", text="text"):
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept``."""
    source = whole_texts(docs, key, text)
    found = cut_lineage(features(source, size))
    full = found.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("head"))
    heads = full.join(classes.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi")
    least = needed(percent)
    postings = cut_lineage(prefixes(heads, least))
    texts = cut_lineage(source.join(postings.select("doc_id").distinct(), "doc_id", "left_semi"))
    signatures = full.join(postings.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "signature")

    def matching(pairs):
        """Pairs that agree on enough coordinates; collisions are counted over whole signatures."""
        one, two = (signatures.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b").filter(
            F.size(F.array_intersect("sa", "sb")) >= least).select("a", "b")

    tried = cut_lineage(matching(first_partners(postings, percent)))
    links = cut_lineage(confirmed(tried, texts, size, percent))
    roots = components(links)
    open_ = cut_lineage(spanning(postings, roots))
    crossing = across(early(open_, texts, size, percent), percent)
    crossing = cut_lineage(matching(crossing.join(tried.unionByName(tried.select(
        F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")))
    more = confirmed(crossing, texts, size, percent)
    same = full.join(classes, ["h1", "h2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    roots = components(links.unionByName(more).unionByName(same.filter("a <> b")))
    return (found.join(roots, found["doc_id"] == roots["node"], "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def prefixes(heads, least):
    """The shared postings of every document's prefix: ``posting``, ``doc_id``, ``n_shingles``."""
    posted = heads.select("doc_id", "n_shingles", F.explode("signature").alias("posting"))
    shared = posted.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = posted.join(shared, "posting").groupBy("doc_id", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("all"))
    alone = F.lit(COORDINATES) - F.size("all")
    left = F.greatest(F.lit(COORDINATES - least + 1) - alone, F.lit(0))
    return ranked.select("doc_id", "n_shingles", F.explode(F.slice("all", F.lit(1), left)["posting"]).alias("posting"))


def sizes_fit(one, two, percent):
    return (100 * F.col(one) >= percent * F.col(two)) & (100 * F.col(two) >= percent * F.col(one))


def first_partners(postings, percent):
    """For every document the head of a posting with which it shares most postings."""
    heads = postings.groupBy("posting").agg(F.min(F.struct("doc_id", "n_shingles")).alias("head"))
    heads = heads.select("posting", F.col("head.doc_id").alias("a"), F.col("head.n_shingles").alias("size_a"))
    pairs = postings.join(heads, "posting").filter("doc_id <> a").filter(sizes_fit("n_shingles", "size_a", percent))
    counted = pairs.groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("n"))
    best = counted.groupBy("b").agg(F.min(F.struct(-F.col("n"), "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def spanning(postings, roots):
    """The documents of postings with members of several components: ``doc_id``, ``n_shingles``, ``root``."""
    labelled = postings.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "root", F.coalesce("root", "doc_id"))
    open_ = labelled.groupBy("posting").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return labelled.join(open_.select("posting"), "posting", "left_semi").select("doc_id", "n_shingles", "root").distinct()


def early(members, texts, size, percent):
    """The first shingles of each member, rarest first, as ``shingle`` and ``place`` (from 1).

    Shingles that no other member has take a place but need no row.
    """
    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                hashes = [shingle_hashes(t, size).view(np.int64) for t in as_bytes(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(hashes, pa.list_(pa.int64()))],
                                             names=["doc_id", "shingles"])

    held = texts.join(members.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    single = held.mapInArrow(run, "doc_id long, shingles array<long>").select(
        "doc_id", F.explode("shingles").alias("shingle"))
    shared = single.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = single.join(shared, "shingle").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    placed = members.join(ranked, "doc_id").select(
        "doc_id", "n_shingles", "root", F.size("all").alias("n_shared"), F.posexplode("all").alias("at", "one"))
    return placed.select("doc_id", "n_shingles", "root", F.col("one.shingle").alias("shingle"), (
        F.col("n_shingles") - F.col("n_shared") + F.col("at") + 1).alias("place")).filter(
        100 * (F.col("place") - 1) <= (100 - percent) * F.col("n_shingles"))


def across(rows, percent):
    """Pairs of different components, one common early shingle of which leaves room for enough others.

    ``a`` is the smaller set; its first common shingle must stand still earlier.
    """
    small = rows.select(F.col("doc_id").alias("a"), F.col("root").alias("root_a"), F.col("n_shingles").alias("size_a"),
                        F.col("place").alias("place_a"), "shingle").filter(
        (100 + percent) * (F.col("size_a") - F.col("place_a") + 1) >= 2 * percent * F.col("size_a"))
    large = rows.select(F.col("doc_id").alias("b"), F.col("root").alias("root_b"), F.col("n_shingles").alias("size_b"),
                        F.col("place").alias("place_b"), "shingle")
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    return small.join(large, "shingle").filter(
        "root_a <> root_b and (size_a < size_b or (size_a = size_b and a < b))").filter(
        ((100 + percent) * room >= percent * (F.col("size_a") + F.col("size_b")))
        & sizes_fit("size_a", "size_b", percent)).select("a", "b").distinct()
