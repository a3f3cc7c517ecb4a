"""Packing of token sequences: sum-of-squares placement.

``pieces`` encodes documents, ends each with an end token and cuts only those that are longer than a
sequence; ``pack`` gives every piece a sequence and an offset in it.

Encoding. A blank between two characters that are no white space always starts a match of the split
pattern, so a text falls apart there into words whose ids do not depend on their neighbours. A task
remembers the ids of words; those it does not know are encoded together in one call per block.

Packing. Pieces as long as a sequence fill one alone. The others are dealt by a hash of their key to
shards of about ``SHARD`` pieces, each packed in one task with memory for its shard only. In a shard
the pieces come longest first; each goes where the sum over all fill levels of the squared number of
open sequences becomes smallest (ties to the fullest). What then stands in sequences with a gap is
taken out and placed once more, longest first, into the fullest sequence that has room. A shard
leaves some tens of thin sequences behind, however many shards there are.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each on its own;
null keys are kept; an empty table gives no pieces.
"""

import functools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.llm.arrow import column
from mailsift.llm.bpe import codec
from mailsift.sources.shared import cut_lineage

SHARD = 32_768  # pieces packed together
REMEMBERED = 600_000  # words whose ids a task remembers
BLOCK = 512  # texts whose unknown words are encoded in one call
UNEVEN = re.compile(r"[^\S \n]|^[ ]|[ ]\Z")
ADDED = {"<|endoftext|>": 50256}  # tokens that byte_bpe_50k.json reads in a text
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Words:
    """Ids of whole texts by a rank file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path):
        self.codec = codec(path)
        self.size = np.array([len(b) for b in self.codec.bytes_of])
        self.known = {}

    @staticmethod
    def even(text):
        return not ("  " in text or "\n " in text or " \n" in text or UNEVEN.search(text))

    def learn(self, words):
        """Ids of words that follow a blank, all in one call."""
        if not words:
            return
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        ids = np.array(self.codec.encoding.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum(self.size[ids])
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = 4 * (np.searchsorted(ends, stops) + 1)
        packed, at = ids.tobytes(), 0
        for word, cut in zip(words, cuts.tolist()):
            self.known[word] = packed[at:cut]
            at = cut

    def encode(self, texts):
        whole = self.codec.encoding.encode_ordinary
        parts = [t.split(" ") if self.even(t) else None for t in texts]
        new = set()
        for p in parts:
            if p:
                new.update(p[1:])
        wanted = len(new)
        new.difference_update(self.known)
        if len(self.known) + len(new) > REMEMBERED and len(new) < wanted:  # all of a block must be known at once
            self.known.clear()
            new = {w for p in parts if p for w in p[1:]}
        self.learn(list(new))
        get = self.known.__getitem__
        return [np.array(whole(t), "<u4").tobytes() if p is None else
                np.array(whole(p[0]), "<u4").tobytes() + b"".join(map(get, p[1:])) for t, p in zip(texts, parts)]


@functools.lru_cache(1)
def words(path):
    return Words(path)


def with_added(known, texts, added):
    """Ids of texts; where an added token (``added``: string to id) stands, they hold its id."""
    if not added:
        return known.encode(texts)
    pattern = re.compile("(" + "|".join(map(re.escape, added)) + ")")
    parts = [pattern.split(t) for t in texts]  # every other part is an added token
    ids = iter(known.encode([x for p in parts for x in p[::2]]))
    return [b"".join(np.array([added[x]], "<u4").tobytes() if i % 2 else next(ids) for i, x in enumerate(p)) for p in parts]


def pieces(docs, path, capacity=1024, end=2, added=None):
    """Pieces of at most ``capacity`` ids of every document (``doc_id``, ``text``), the end token included.

    Only the first piece of a longer document may be shorter. Strings in ``added`` become their ids.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        known = words(path)
        types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block, rows = batch.slice(at, BLOCK), []  # only the texts of a block become strings at once
                for key, ids in zip(column(block, "doc_id").to_pylist(), with_added(
                        known, [t or "" for t in column(block, "text").to_pylist()], added)):
                    ids += tail
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(key, i, a, b - a, ids[4 * a:4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths, capacity):
    """Sequence and offset of every length; all are below the capacity.

    ``open_[h]`` counts the sequences filled to level h. Placing s at level h moves one of them to
    h + s, which changes the sum of squares by 2 (open_[h + s] - open_[h] + 1).
    """
    order = np.argsort(-lengths, kind="stable")
    open_, at_level = np.zeros(capacity + 1, np.int64), defaultdict(list)
    members, closed = [], []
    for item in order.tolist():
        size = int(lengths[item])
        here = open_[1:capacity - size + 1]
        gain = np.where(here > 0, 2 * (open_[1 + size:] - here + 1), np.iinfo(np.int64).max)
        if len(gain) and here[-1]:
            gain[-1] = 1 - 2 * here[-1]  # a full sequence counts no more
        best = len(gain) - 1 - int(gain[::-1].argmin()) if len(gain) else -1
        if best >= 0 and gain[best] <= 2 * open_[size] + 1:
            level = best + 1
            sequence = at_level[level].pop()
            open_[level] -= 1
        else:
            level, sequence = 0, len(members)
            members.append([])
        members[sequence].append(item)
        if level + size < capacity:
            open_[level + size] += 1
            at_level[level + size].append(sequence)
        else:
            closed.append(sequence)
    done = [members[s] for s in closed]
    gaps = sorted({i for level in at_level.values() for s in level for i in members[s]},
                  key=lambda i: (-lengths[i], i))
    done += best_fit(gaps, lengths, capacity)
    sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(done):
        sequences[items] = number
        offsets[items] = np.cumsum([0, *lengths[items[:-1]]])
    return sequences, offsets


def best_fit(items, lengths, capacity):
    """Items in the order given, each into the fullest sequence with room."""
    open_, at_level, members = np.zeros(capacity + 1, np.int64), defaultdict(list), []
    for item in items:
        size = int(lengths[item])
        levels = np.flatnonzero(open_[1:capacity - size + 1])
        level = int(levels[-1]) + 1 if len(levels) else 0
        if level:
            open_[level] -= 1
            sequence = at_level[level].pop()
        else:
            sequence = len(members)
            members.append([])
        members[sequence].append(item)
        open_[level + size] += 1
        at_level[level + size].append(sequence)
    return members


def pack(cut, capacity=1024):
    """``cut`` (with ``length``, at most the capacity) with ``sequence_id`` and a gapless ``offset``."""
    cut = cut.drop("sequence_id", "offset", "shard")
    cut = cut.withColumn("length", F.col("length").cast("long"))
    cut = cut.withColumn("full", F.col("length") == capacity).withColumn(
        "key", F.xxhash64("doc_id", "piece")).transform(cut_lineage)
    shards = -(-cut.filter("not full").count() // SHARD) or 1
    full = cut.filter("full").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long"))
    names = [c for c in full.columns if c not in ("full", "key")]

    def place(group):
        part = group.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = part.column("length").to_numpy()
        sequences, offsets = sum_of_squares(lengths, capacity)
        ids = part.column("shard").to_numpy() * (2 * SHARD * 1024) + sequences
        return part.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).select(names)

    short = cut.filter("not full").withColumn("shard", F.pmod("key", F.lit(shards)))
    placed = short.groupBy("shard").applyInArrow(place, full.select(names).schema)
    return full.select(names).unionByName(placed)
