"""Removal of passages that repeat an earlier document, found by difference-cover anchors.

Wanted are all windows of ``window`` words that also start in a document with a smaller id. Anchors
are shorter windows at positions whose remainder modulo a period lies in a difference cover: for any
two positions some shift below the period takes both into the cover, so two copies of a long passage
share an anchor that lies inside of both, wherever the copies stand. Only these positions are hashed
and shuffled. A window is extended from an anchor that several documents share: its own hash goes to
a second shuffle, which finds the smallest id that has it.

Hot passages: tasks work on blocks of documents. Of the documents in a block that share a hash only
the one with the smallest id is sent under it; what the others need to know is known already and is
sent under a key of the document. So a passage of a third of all documents reaches a key once per block.
No pair of documents is ever formed and no posting list is collected.

Hashes have 64 bits; windows with equal hashes are taken for equal.

Defined cases: a null or empty text has no words and stays as it is; so does a document without an
id, or with fewer words than a window. Rows of one id are one document and do not repeat each other.
Texts from which nothing is removed keep their white space; else the kept words are joined by one
space. All columns of the table are kept, whatever their names; those named ``n_words`` and ``n_removed``
are replaced.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsift.llm.arrow import add_columns, as_bytes, aside, column, mix, window_hashes, word_hashes

#: Perfect difference sets by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
BLOCK = 1_000_000  # words that a task compares at once
SENT = "key long, doc_id long, known long"


def cover_for(window):
    """Period and cover whose anchors are at least half as long as the window."""
    period = max((p for p in COVERS if 2 * p <= window + 1), default=1)
    return period, COVERS.get(period, (0,))


def anchors(hashes, window):
    """Hashes and positions of the anchors of a document."""
    period, cover = cover_for(window)
    short = window_hashes(hashes, window - period + 1)
    at = np.flatnonzero(np.isin(np.arange(len(short)) % period, cover))
    return short[at], at


def spread(starts, size, length):
    """Mask of ``length`` places covered by runs of ``size`` from each start."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, length), -1)
    return np.cumsum(change[:-1]) > 0


def send(blocks, of_document, all_known):
    """Rows for the shuffle of the hashes of a block.

    The smallest id of each hash goes under the hash itself. For hashes with several ids, the others
    (with ``all_known``, that one too) are sent as known, under a key of the document.
    """
    for block in blocks:
        found = [(np.unique(of_document(*rest)), doc) for doc, *rest in block]
        hashes = np.concatenate([h for h, _ in found] or [np.empty(0, np.uint64)])
        docs = np.concatenate([np.full(len(h), d, np.int64) for h, d in found] or [np.empty(0, np.int64)])
        order = np.lexsort((docs, hashes))
        hashes, docs = hashes[order], docs[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        smallest = docs[first][group] if len(first) else docs
        known = docs > smallest
        if all_known and len(first):
            known = np.maximum.reduceat(known, first)[group]
        with np.errstate(over="ignore"):
            own = mix(docs[known].view(np.uint64))
        key = np.concatenate([hashes[new], own]).view(np.int64)
        to = np.concatenate([docs[new], docs[known]])
        value = np.concatenate([np.zeros(len(first), np.uint64), hashes[known]]).view(np.int64)
        empty = np.arange(len(key)) < len(first)
        by = np.argsort(to, kind="stable")
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[by]), pa.array(to[by]), pa.array(value[by], mask=empty[by])], names=["key", "doc_id", "known"])


def blocks(batches, rows):
    """Documents with an id as lists of (id, ...), of about ``BLOCK`` words each."""
    block, size = [], 0
    for batch in batches:
        for row in rows(batch):
            block.append(row)
            size += len(row[1])
            if size > BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def unpacked(batch):
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(b) if b else b"" for b in column(batch, "packed_text").to_pylist()]


def shared_anchors(docs, window):
    """``doc_id`` and ``anchor`` for all anchors that stand in several documents."""
    def rows(batch):
        for doc, text in zip(column(batch, "doc_id").to_pylist(), as_bytes(batch)):
            words = text.split()
            if doc is not None and len(words) >= window:
                yield doc, word_hashes(words)

    def run(batches):
        return send(blocks(batches, rows), lambda h: anchors(h, window)[0], True)

    sent = docs.select("doc_id", "text").mapInArrow(run, SENT)
    met = sent.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    return met.filter("n > 1 or known is not null").select("doc_id", F.coalesce("known", "key").alias("anchor"))


def repeated_windows(packed, window):
    """``doc_id`` and ``hash`` of the windows that a document with a smaller id has too.

    ``packed`` has all documents, and their shared anchors as ``anchors``.
    """
    period = cover_for(window)[0]

    def rows(batch):
        for doc, text, shared in zip(column(batch, "doc_id").to_pylist(), unpacked(batch),
                                     column(batch, "anchors").to_pylist()):
            if shared:
                yield doc, word_hashes(text.split()), np.array(shared, np.int64).view(np.uint64)

    def extended(hashes, shared):
        found, at = anchors(hashes, window)
        at = at[np.isin(found, shared)]
        whole = window_hashes(hashes, window)
        # a window that starts up to period - 1 words before an anchor contains it
        return whole[spread(np.maximum(at - period + 1, 0), period, len(whole))[:len(whole)]] if len(at) else whole[:0]

    def run(batches):
        return send(blocks(batches, rows), extended, False)

    sent = packed.mapInArrow(run, SENT)
    met = sent.withColumn("low", F.min("doc_id").over(Window.partitionBy("key")))
    return met.filter("doc_id > low or known is not null").select("doc_id", F.coalesce("known", "key").alias("hash"))


def remove_repeats(docs, window=13):
    """``docs`` (``doc_id``, ``text``, ...) with ``text`` cut, and ``n_words``, ``n_removed`` of every document."""
    docs, back = aside(docs.drop("n_words", "n_removed"), ("doc_id", "text"))
    found = shared_anchors(docs, window).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def pack():
        compress = zstandard.ZstdCompressor(level=3).compress
        return lambda batch: [pa.array([None if t is None else compress(t) for t in
                                        column(batch, "text").cast(pa.binary()).to_pylist()], pa.binary())]

    packed = add_columns(docs, "packed_text binary", pack).drop("text")
    # both joins are outer ones over the same columns, so that the texts are shuffled once for both
    windows = repeated_windows(packed.join(found, "doc_id", "left"), window)
    repeated = windows.groupBy("doc_id").agg(F.collect_set("hash").alias("repeated_windows"))

    def cut():
        unpack = zstandard.ZstdDecompressor().decompress

        def run(batch):
            texts, counts, removed = [], [], []
            for blob, hashes in zip(column(batch, "packed_text").to_pylist(),
                                    column(batch, "repeated_windows").to_pylist()):
                text = None if blob is None else unpack(blob)
                words, gone = (text or b"").split(), 0
                if hashes:
                    whole = window_hashes(word_hashes(words), window)
                    at = np.flatnonzero(np.isin(whole, np.array(hashes, np.int64).view(np.uint64)))
                    mask = spread(at, window, len(words))
                    gone = int(mask.sum())
                if gone:
                    text = b" ".join([w for w, m in zip(words, mask.tolist()) if not m])
                texts.append(text)
                counts.append(len(words))
                removed.append(gone)
            return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64())]
        return run

    joined = packed.join(repeated, "doc_id", "left")
    return back(add_columns(joined, "text string, n_words long, n_removed long", cut).select(
        *docs.columns, "n_words", "n_removed"))
