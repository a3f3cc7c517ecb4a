import pathlib
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from mailsift.llm import lm
from mailsift.llm.registry import QUERIES


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    net = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in lm.start().items()}
    ids = rng.integers(0, lm.PAD, 12).astype(np.int32)
    near = lm.neighbours(ids)
    found, rows = lm.gradients(net, near, ids)
    loss = lambda: -lm.log_probabilities(net, near, ids).mean()
    for k, g in found.items():
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in g.shape)
            place = (rows[at[0]], *at[1:]) if k == "embedding" else at
            net[k][place] += 1e-5
            up = loss()
            net[k][place] -= 2e-5
            down = loss()
            net[k][place] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, k


def test_digits_make_a_distribution():
    net, near = lm.start(), lm.neighbours(np.array([5, 9, 5], np.int32))
    rng = np.random.default_rng(1)
    net = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in net.items()}
    every = np.arange(lm.PAD, dtype=np.int32)
    p = np.exp(lm.log_probabilities(net, np.repeat(near[1:2], lm.PAD, axis=0), every))
    assert abs(p.sum() - 1) < 1e-3 and near.tolist() == [[lm.PAD, lm.PAD, 9, 5], [lm.PAD, 5, 5, lm.PAD], [5, 9, lm.PAD, lm.PAD]]


def test_scores_and_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "one"), (4, "a b c d e " * 300), (4, "a b c d e " * 300), (None, "a b")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    net = lm.train(docs)
    for block in (7, 10_000):
        monkeypatch.setattr(lm, "BLOCK", block)
        for r in lm.score(docs, net).collect():
            ids = lm.tokens((r.text or "").encode())
            each = [lm.log_probabilities(net, lm.neighbours(ids)[i:i + 1], ids[i:i + 1])[0] for i in range(len(ids))]
            assert r.n_tokens == len(ids) and abs(r.pseudo_log_likelihood - sum(each)) < 1e-3 * max(1, len(ids))
    assert lm.score(docs.limit(0), lm.train(docs.limit(0))).count() == 0


def test_copies_are_averaged_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 2)
    docs = spark.createDataFrame([(i, f"w{i % 5} x y{i % 3} z " * (i + 1)) for i in range(40)], "doc_id long, text string")
    rows = docs.select("text", F.lit(1).alias("offset")).repartition(7, "text")
    copies = lm.trained_copies(rows, lm.start()).collect()
    tasks = {r.task: r.weight for r in copies}
    mean = sum(np.concatenate([np.frombuffer(r.total, np.float32) for r in sorted(copies, key=lambda r: r.part) if r.task == t])
               for t in tasks) / sum(tasks.values())
    assert np.allclose(lm.flat(lm.averaged(lm.trained_copies(rows, lm.start()))), mean, atol=1e-4) and len(tasks) > 3


def test_held_out_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    mean = lambda net: lm.score(rest, net).agg(F.sum("pseudo_log_likelihood") / F.sum("n_tokens")).first()[0]
    ids = np.concatenate([lm.tokens((r.text or "").encode()) for r in train.select("text").collect()])
    held = np.concatenate([lm.tokens((r.text or "").encode()) for r in rest.select("text").collect()])
    counts = np.bincount(ids, minlength=lm.PAD) + 1.0
    unigram = np.log(counts / counts.sum())[held].mean()
    got = mean(lm.train(train))
    assert got > mean(lm.start()) + 0.5 and got > unigram - 0.3, (got, unigram)
    assert QUERIES["op1_pseudo_likelihood"](spark, "/root/testdata/sf0.001").count() == 200


def test_words_of_one_id_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 400)
    known = {}
    pair = next((known[i], w) for w in (f"w{n}" for n in range(10_000))
                for i in [int(lm.tokens(w.encode())[0])] if known.setdefault(i, w) != w)
    rows = [(i, f"see {pair[0]} there") for i in range(60)] + [(100, f"see {pair[1]} there"), (None, None), (101, ""), (101, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, chunk int")
    net = lm.train(docs)
    by_id = {r.text: r.pseudo_log_likelihood for r in lm.score(docs, net).collect()}
    got = lm.score_words(docs, net).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got} == {0, 3}
    found = {r.text: r.pseudo_log_likelihood for r in got}
    for word, n in zip(pair, (60, 1)):
        assert abs(found[f"see {word} there"] - by_id[f"see {word} there"] - np.log(n / 61)) < 1e-4
    assert found[None] == found[""] == 0
    assert lm.score_words(docs.limit(0), net).count() == 0


def test_every_token_of_every_document_is_trained(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), i) for i in range(300)] + [(300, None, 0)], "doc_id long, text string, offset int")
    copies = lm.trained_copies(docs, lm.start()).select("task", "weight").distinct().collect()
    assert sum(r.weight for r in copies) == sum(i % 9 for i in range(300))


FAULTS = """
import resource
import numpy as np
from mailsift.llm import lm
ids = (np.random.default_rng(3).zipf(1.3, 40 * lm.BATCH) % lm.PAD).astype(np.int32)
trainer, near, faults = lm.Trainer(lm.start()), lm.neighbours(ids), []
for at in range(0, len(ids), lm.BATCH):
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
    trainer.add(near[at:at + lm.BATCH], ids[at:at + lm.BATCH])
print((faults[-1] - faults[10]) / (len(faults) - 11))
"""


def test_a_training_step_uses_the_memory_of_the_last_one():
    root = pathlib.Path(__file__).resolve().parents[2]  # a process of its own: what other tests freed has an effect on this
    told = subprocess.run([sys.executable, "-c", FAULTS], cwd=root, capture_output=True, text=True, check=True)
    assert float(told.stdout) < 50, told.stdout
