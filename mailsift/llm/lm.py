"""Masked pseudo-likelihood of documents by a small bidirectional window network.

Every token is predicted from ``SIDE`` tokens on both sides; the sum of these conditional
log-probabilities scores a document. A token is a word between white space, of any number of distinct
ones. Words fall into ``HIGH * LOW`` ids by hash, and

    P(word | both sides) = P(id | ids on both sides) P(word | id)

The network gives the first factor, in two digits, the second one given the first, so a prediction
costs HIGH + LOW outputs. The second is the share of the word among all words of its id in the documents
that are scored. As neighbours, words are known by their ids only.

Shares are counted in shards. Documents are dealt by hash into chunks of about ``CHUNK`` characters; a
chunk sends each of its distinct words once to the shard of its id, and gets the logarithm of the share
back, so a frequent word is one entry per chunk. Nothing of the vocabulary is on the driver or broadcast.

Network (numpy): embeddings of the neighbours, weighted per position, summed, and squashed to a hidden
layer; from it the first digit; from it and an embedding of the first digit the second one.

Training covers all documents once: each token of each is masked and predicted. In each of ``ROUNDS`` rounds (documents fall into rounds by hash)
every task trains a copy of the network on its documents; the copies are averaged, weighted by
tokens. Copies are cut into parts and summed by Spark in groups of at most ``GROUP``, level by level,
so what is gathered grows with the number of tasks but no task holds more than GROUP parts. Only the
averaged network (a fixed number of parameters) is on the driver, and is broadcast.

Defined cases: a null or empty text has no tokens and a score of 0; a text of one word is predicted
from padding; repeated rows are scored alike; without any text all tokens are equally likely.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mailsift.llm.arrow import add_columns, as_bytes, word_hashes
from mailsift.sources.shared import cut_lineage

HIGH = LOW = 64
SIDE, DIM, ROUNDS = 2, 32, 2
CHUNK = 4_000_000
STEP, BATCH, BLOCK, SCORED = 0.1, 1024, 16_384, 1024  # SCORED tokens at a time fit in a core's cache
GROUP, PARTS = 64, 16
KEPT = 1 << 24  # bytes; the arrays of a training step take a fraction of it
PAD = HIGH * LOW
NEAR = np.array([o for o in range(-SIDE, SIDE + 1) if o])
SHAPES = {"embedding": (PAD + 1, DIM), "position": (2 * SIDE, DIM), "bias": (DIM,), "first": (DIM, HIGH), "first_bias": (HIGH,),
          "digit": (HIGH, DIM), "second": (DIM, LOW), "second_bias": (LOW,)}


def keep_memory():
    """Freeing one large array makes the C library keep what smaller ones free.

    Otherwise it returns the arrays of each step to the system, and the next step spends a quarter of its
    time on getting fresh pages.
    """
    np.empty(KEPT, np.uint8)


def start():
    """The network before training; the outputs are even."""
    draw = np.random.default_rng(7)
    net = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    net["embedding"] = draw.normal(0, 0.3, SHAPES["embedding"]).astype(np.float32)
    net["position"] += 1
    return net


def flat(net):
    return np.concatenate([net[k].ravel() for k in SHAPES])


def shaped(values):
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {k: v.reshape(s) for (k, s), v in zip(SHAPES.items(), np.split(values, ends[:-1]))}


def ids_of(words):
    """Ids of word hashes."""
    return (words % np.uint64(PAD)).astype(np.int32)


def tokens(text):
    """Token ids of a text in bytes."""
    return ids_of(word_hashes(text.split()))


def neighbours(ids):
    """Neighbour ids of every token, padded at both ends."""
    padded = np.full(len(ids) + 2 * SIDE, PAD, np.int32)
    padded[SIDE:len(ids) + SIDE] = ids
    near = np.empty((len(ids), len(NEAR)), np.int32)
    for place, offset in enumerate(NEAR):
        near[:, place] = padded[SIDE + offset:SIDE + offset + len(ids)]
    return near


def hidden_layer(net, near):
    """Embeddings of the neighbours by place, and the hidden layer."""
    around = [net["embedding"].take(near[:, p], axis=0) for p in range(2 * SIDE)]
    total = around[0] * net["position"][0]
    weighted = np.empty_like(total)
    for a, weights in zip(around[1:], net["position"][1:]):
        total += np.multiply(a, weights, out=weighted)
    total += net["bias"]
    return around, np.tanh(total, out=total)


def outputs(net, hidden, high):
    """Hidden layer of the second digit, and the outputs for both, one row per value of a digit: sums over them stay fast."""
    second = net["digit"].take(high, axis=0)
    second += hidden
    one, two = net["first"].T @ hidden.T, net["second"].T @ second.T
    one += net["first_bias"][:, None]
    two += net["second_bias"][:, None]
    return second, one, two


def log_probabilities(net, near, ids):
    """ln P(id | ids on both sides) of every token."""
    out, at = np.empty(len(ids), net["bias"].dtype), np.arange(SCORED)
    for i in range(0, len(ids), SCORED):
        some = ids[i:i + SCORED]
        digits = np.divmod(some, LOW)
        _, *logits = outputs(net, hidden_layer(net, near[i:i + SCORED])[1], digits[0])
        total = 0
        for digit, x in zip(digits, logits):
            x -= x.max(axis=0)
            mine = x[digit, at[:len(some)]]
            total = total + mine - np.log(np.exp(x, out=x).sum(axis=0))
        out[i:i + SCORED] = total
    return out


def gradients(net, near, ids):
    """Gradient of the mean negative log-probability; that of the embeddings as rows and their values."""
    around, hidden = hidden_layer(net, near)
    (high, low), n, at = np.divmod(ids, LOW), len(ids), np.arange(len(ids))
    second, one, two = outputs(net, hidden, high)
    for digit, x in ((high, one), (low, two)):
        x -= x.max(axis=0)
        np.exp(x, out=x)
        x *= 1 / (x.sum(axis=0) * n)
        x[digit, at] -= 1 / n
    back_two = two.T @ net["second"].T
    back = one.T @ net["first"].T
    back += back_two
    slope = hidden * hidden
    back *= np.subtract(1, slope, out=slope)
    chosen = np.zeros((HIGH, n), back.dtype)
    chosen[high, at] = 1
    to_neighbours = (back * net["position"][:, None]).reshape(-1, back.shape[1])
    places = near.T.ravel().astype(np.uint16)  # short integers are sorted by radix
    order = np.argsort(places, kind="stable")
    places = places[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return {"first": (one @ hidden).T, "first_bias": one.sum(axis=1), "second": (two @ second).T, "second_bias": two.sum(axis=1),
            "digit": chosen @ back_two, "bias": back.sum(axis=0), "position": np.stack([np.einsum("bd,bd->d", back, a) for a in around]),
            "embedding": np.add.reduceat(to_neighbours.take(order, axis=0), first)}, places[first]


class Trainer:
    """Adagrad on batches of masked tokens."""

    def __init__(self, net):
        self.net = {k: v.copy() for k, v in net.items()}
        self.seen = {k: np.full(s, 1e-8, np.float32) for k, s in SHAPES.items()}
        self.near, self.ids, self.waiting, self.trained = [], [], 0, 0
        keep_memory()

    def add(self, near, ids):
        self.near.append(near)
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH:
            self.step(self.waiting - self.waiting % BATCH)

    def step(self, n):
        """Trains on the first ``n`` of the waiting tokens; the others go on waiting."""
        if not n:
            return
        near, ids = np.concatenate(self.near), np.concatenate(self.ids)
        for at in range(0, n, BATCH):
            found, rows = gradients(self.net, near[at:min(at + BATCH, n)], ids[at:min(at + BATCH, n)])
            for k, g in found.items():
                where = rows if k == "embedding" else slice(None)
                seen = g * g
                seen += self.seen[k].take(rows, axis=0) if k == "embedding" else self.seen[k]
                self.seen[k][where] = seen
                g *= STEP
                g /= np.sqrt(seen, out=seen)
                self.net[k][where] -= g
        self.trained += n
        self.near, self.ids, self.waiting = [near[n:]], [ids[n:]], len(ids) - n


def trained_copies(docs, net):
    """One trained copy of the network per task: ``task``, ``part``, ``weight`` and ``total`` (values times weight)."""
    def run(batches):
        trainer = Trainer(net)
        for batch in batches:
            for ids in map(tokens, as_bytes(batch)):
                if len(ids):
                    trainer.add(neighbours(ids), ids)
        trainer.step(trainer.waiting)
        if trainer.trained:
            parts = np.array_split(flat(trainer.net) * np.float32(trainer.trained), PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()),
                 pa.array([float(trainer.trained)] * PARTS), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["task", "part", "weight", "total"])

    return docs.mapInArrow(run, "task long, part int, weight double, total binary")


def averaged(copies):
    """The mean of all copies, or None without any."""
    def add(table):
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table.column("total").to_pylist())
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // GROUP]), "part": table.column("part").slice(0, 1),
                         "weight": pa.array([sum(table.column("weight").to_pylist())]),
                         "total": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    copies = cut_lineage(copies)
    last = copies.agg(F.max("task")).first()[0]
    if last is None:
        return None
    while True:
        copies = copies.groupBy("part", F.floor(F.col("task") / GROUP).alias("group")).applyInArrow(
            add, "task long, part int, weight double, total binary")
        last //= GROUP
        if not last:
            break
    rows = sorted(copies.collect(), key=lambda r: r.part)
    return shaped(np.concatenate([np.frombuffer(r.total, np.float32) / np.float32(r.weight) for r in rows]))


def train(docs):
    """The network trained on all documents (``doc_id``, ``text``)."""
    rows = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("round"))
    net = start()
    for i in range(ROUNDS):
        part = rows.filter(F.col("round") == i)
        net = averaged(trained_copies(part, net)) or net
    return net


def score(docs, net):
    """``docs`` with ``n_tokens`` and ``pseudo_log_likelihood`` of the ids of each text."""
    net = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        known = net.value
        keep_memory()

        def of_block(block):
            ids = np.concatenate(block) if block else np.empty(0, np.int32)
            near = np.concatenate([neighbours(b) for b in block]) if block else np.empty((0, 2 * SIDE), np.int32)
            values = [log_probabilities(known, near[at:at + BLOCK], ids[at:at + BLOCK]).astype(np.float64)
                      for at in range(0, len(ids), BLOCK)]
            sums = np.concatenate([[0.0], np.cumsum(np.concatenate(values))]) if values else np.zeros(1)
            ends = np.cumsum([0, *map(len, block)])
            return (sums[ends[1:]] - sums[ends[:-1]]).tolist()

        def run(batch):
            counts, out, block, size = [], [], [], 0
            for text in as_bytes(batch):
                block.append(tokens(text))
                counts.append(len(block[-1]))
                size += counts[-1]
                if size >= BLOCK:
                    out += of_block(block)
                    block, size = [], 0
            out += of_block(block)
            return [pa.array(counts, pa.int64()), pa.array(out, pa.float64())]
        return run

    return add_columns(docs, "n_tokens long, pseudo_log_likelihood double", make)


def by_shard(words, shards):
    """The order of sorted words by shard and hash, and the shard of each word."""
    shard = ids_of(words).astype(np.int64) * shards // PAD
    return np.argsort(shard, kind="stable"), shard


def with_shares(docs):
    """``docs`` with ``within``: the sum of ln P(word | id) over the words of each text, by the counts of all ``docs``."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    shards = min(PAD, chunks)
    rows = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    names = docs.columns

    def ask(table):
        words, n = np.unique(np.concatenate([word_hashes(t.split()) for t in as_bytes(table)]), return_counts=True)
        order, shard = by_shard(words, shards)
        words, shard, n = words[order], shard[order], n[order]
        found, first = np.unique(shard, return_index=True)
        blocks = lambda values: pa.array([v.tobytes() for v in np.split(values, first[1:])][:len(found)], pa.binary())
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(found), pa.int64()), "shard": pa.array(found),
                         "words": blocks(words), "n": blocks(n.astype(np.int64))})

    def answer(table):
        asked = [np.frombuffer(b, np.uint64) for b in table.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(at, np.frombuffer(b"".join(table.column("n").to_pylist()), np.int64))
        ids = ids_of(words)
        logs = np.log(n / np.bincount(ids, n)[ids]).astype(np.float32)[at]
        parts = np.split(logs, np.cumsum([len(a) for a in asked])[:-1])
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"),
                         "logs": pa.array([p.tobytes() for p in parts], pa.binary())})

    def told(table, answers):
        if not table.num_rows:
            return table.select(names).append_column("within", pa.array([], pa.float64()))
        texts = [word_hashes(t.split()) for t in as_bytes(table)]
        words, place = np.unique(np.concatenate(texts), return_inverse=True)
        logs = np.empty(len(words))
        logs[by_shard(words, shards)[0]] = np.frombuffer(b"".join(answers.sort_by("shard").column("logs").to_pylist()), np.float32)
        ends = np.cumsum([0, *map(len, texts)])
        logs = logs[place]
        return table.select(names).append_column("within", pa.array([float(logs[a:b].sum()) for a, b in zip(ends, ends[1:])]))

    asked = rows.groupBy("chunk").applyInArrow(ask, "chunk long, shard long, words binary, n binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "chunk long, shard long, logs binary")
    schema = StructType([*docs.schema.fields, StructField("within", DoubleType())])
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(told, schema)


def score_words(docs, net):
    """``docs`` with ``n_tokens`` and ``pseudo_log_likelihood`` of the words, not only the ids, of each text."""
    kept = docs.drop("n_tokens", "pseudo_log_likelihood", "within", "chunk")
    return score(with_shares(kept), net).withColumn(
        "pseudo_log_likelihood", F.col("pseudo_log_likelihood") + F.col("within")).drop("within")
