"""Document fingerprints by a threshold-scaled sketch.

A sketch keeps every shingle hash below ``FRACTION`` of the hash range, and in any case the smallest
hash, so that short texts have a sketch too. Its size grows with the document, so sketches of very
unequal documents compare well: the share of one sketch's hashes found in the other estimates how
much of the one document stands in the other. Sketches are mergeable: the sketch of a union is the
union of the sketches without those hashes at or above the bound that are not its smallest.

Defined cases: a null or empty text has an empty sketch, written as an empty string; two empty ones
are alike (1), an empty and another one are not (0). A text with fewer words than a shingle has its
whole sequence as the only one. Rows of one id follow each other by text. Rows without an id stand in
no order: the next text is empty for them.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.llm.arrow import add_columns, as_bytes, column, window_hashes, word_hashes

FRACTION = 1 / 8
SIZE = 5  # words of a shingle
BOUND = np.uint64(int(FRACTION * 2**64))
RUN = 4096  # documents that are read one after another


def sketch(text):
    """Sorted hashes of the sketch of a text in bytes."""
    words = text.lower().split()
    hashes = np.unique(window_hashes(word_hashes(words), max(1, min(SIZE, len(words)))))
    return hashes[:max(1, int(np.searchsorted(hashes, BOUND)))]


def merge(one, two):
    """The sketch of all shingles of two documents."""
    both = np.union1d(one, two)
    return both[:max(1, int(np.searchsorted(both, BOUND)))]


def _compared(one, two):
    """Both sketches as far as each is complete, and their common hashes."""
    if len(one) and len(two):
        # above the bound only the smallest of all is known of the union
        both = merge(one, two)
        one, two = one[one <= both[-1]], two[two <= both[-1]]
    return one, two, np.intersect1d(one, two, assume_unique=True)


def likeness(one, two):
    """Estimated Jaccard similarity."""
    one, two, both = _compared(one, two)
    union = len(one) + len(two) - len(both)
    return len(both) / union if union else 1.0


def containment(one, two):
    """Estimated share of the first document's shingles that the second one has."""
    one, _, both = _compared(one, two)
    return len(both) / len(one) if len(one) else float(not len(two))


def as_text(hashes):
    return hashes.astype(">u8").tobytes().hex()


def from_text(text):
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def with_fingerprint(docs, text="text"):
    """``docs`` with the ``fingerprint`` of each text: its hashes as hexadecimal digits, sorted."""
    return add_columns(docs, "fingerprint string", lambda: lambda batch: [
        pa.array([as_text(sketch(t)) for t in as_bytes(batch, text)], pa.string())])


def starts_of_runs(docs):
    """Ids at which runs of about ``RUN`` documents start, in the descending order of ids.

    Ids alone are ranged: Spark deals them into partitions of about equal size, and the largest id of
    each starts a run. Only these reach the driver, one for ``RUN`` documents.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    parts = ids.repartitionByRange(-(-ids.count() // RUN) or 1, F.col("doc_id").desc())
    tops = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("top")).collect()
    return np.array(sorted(r.top for r in tops), np.int64)


def dealt(docs, starts):
    """``docs`` with the ``run`` of each row; the first document of a run is also a ``guest`` of the run before.

    In descending order the last run is followed by the first. Rows without an id get run -1.
    """
    @F.pandas_udf("array<struct<run:int,guest:boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        at = np.searchsorted(starts, keys.fillna(0).to_numpy(np.int64)).tolist()
        return pd.Series([
            [(-1, False)] if not has else
            [(r, False), ((r + 1) % len(starts), True)] if starts[r] == key else [(r, False)]
            for key, has, r in zip(keys, known, at)])

    return docs.select("doc_id", "text", F.explode(places("doc_id")).alias("place")).select(
        "doc_id", "text", "place.run", "place.guest")


def pairs_in_order(batches):
    """Every document with its sketch, followed by the text and sketch of the next one in its run."""
    waiting, run = None, None
    for batch in batches:
        for doc, text, at, guest in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "run", "guest"))):
            if guest and waiting is None:
                continue  # a further row of an id that starts a run
            hashes = sketch(text.encode())
            if waiting is not None:
                yield *waiting, *((text, hashes) if at == run and at >= 0 else ("", sketch(b"")))
            waiting, run = (None if guest else (doc, text, hashes)), at
    if waiting is not None:
        yield *waiting, "", sketch(b"")


def edited_neighbours(docs):
    """Fingerprints of all documents and of edited copies of them.

    The edit replaces the last half of a text by as much from the start of the next document in
    descending order of ids; the last one is followed by the first. One row per document:
    ``doc_id``, ``text``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` (likeness to the edited copy and to the next document), ``next_held`` (share of the
    document that the next one holds).
    """
    names = ["doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_held"]

    def run(batches):
        rows = []
        for doc, text, own, following, other in pairs_in_order(batches):
            half = len(text) // 2
            edited = text[:len(text) - half] + following[:half]
            changed = sketch(edited.encode())
            rows.append((doc, text, edited, as_text(own), as_text(changed), likeness(own, changed), likeness(own, other),
                         containment(own, other)))
            if len(rows) == 1000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), *[pa.string()] * 4, *[pa.float64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ordered = dealt(docs, starts_of_runs(docs)).repartition("run").sortWithinPartitions(
        "run", "guest", F.col("doc_id").desc(), "text")
    return ordered.mapInArrow(run, "doc_id long, text string, edited string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double, next_held double")
