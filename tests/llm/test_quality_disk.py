import gc
import math
import random
import threading
import time

from mailsift.llm import quality
from mailsift.llm.arrow import written
from tests.llm.test_quality import brute


def on_disk(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.length()))


def test_scoring_leaves_little_on_disk(spark, monkeypatch):
    """The keys of all texts took about 88 bytes a word in shuffles; now a turn's keys and the model lie there at a time."""
    draw = random.Random(1)
    rows = [(i, "en", " ".join(f"w{draw.randrange(20_000)}" for _ in range(800))) for i in range(400)]
    docs = written(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(8))
    monkeypatch.setattr(quality, "TURN_CHARS", 300_000, raising=False)
    model = quality.train(docs.filter("doc_id < 60"))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before, most, over = on_disk(spark), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.05):
            most = max(most, on_disk(spark))

    watching = threading.Thread(target=watch)
    watching.start()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a model that is too large to broadcast
    try:
        assert quality.with_likelihood(docs, model).drop("text").filter("log_likelihood < 0").count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        over.set()
        watching.join()
    assert most - before < 30 * 400 * 800, (most - before) / 320_000


def test_turns_and_shards_change_nothing(spark, monkeypatch):
    texts = ["a b c a b", "b c d", "a b c d e f a", "c c c a", "f a b", "", "a c b d f e"] * 2
    monkeypatch.setattr(quality, "TURN_CHARS", 20)
    monkeypatch.setattr(quality, "LEAST_ROWS", 4)
    model, score = quality.train(spark.createDataFrame([("x", t) for t in texts], "lang string, text string")), brute(texts, 3)
    assert model.n_shards > 4
    asked = ["a b c", "z a b", "c d e e", "a b c", "", None, "q q", "d d d d f e " * 50]
    got = quality.with_likelihood(spark.createDataFrame([("x", t) for t in asked] + [("y", "a b")], "lang string, text string"), model).collect()
    assert len(got) == 9
    for r in got:
        if r.lang == "y":
            assert r.log_likelihood is None
        else:
            assert math.isclose(r.log_likelihood, score(r.text or ""), rel_tol=1e-9, abs_tol=1e-9)
