import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mailsift.llm import quality
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def brute(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries; a function from words to log-likelihood."""
    raw, counts = Counter(), {}
    for t in texts:
        w = ["<s>"] * (order - 1) + t.split()
        raw.update(tuple(w[i - order + 1:i + 1]) for i in range(order - 1, len(w)))
    counts[order], grams = raw, set(raw)
    for size in range(order - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in grams)
        grams = set(counts[size])
    cuts, totals, freed, types = {}, {}, {}, {}
    for size, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cut = {i: max(0.1, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.75 * i))
               for i in (1, 2, 3)}
        cuts[size] = cut
        totals[size], freed[size], types[size] = defaultdict(float), defaultdict(float), Counter()
        for g, v in c.items():
            totals[size][g[:-1]] += v
            freed[size][g[:-1]] += min(cut[min(v, 3)], v)
            types[size][g[:-1]] += 1

    def p(g):
        size = len(g)
        if not size:
            return 1 / (types[1][()] + 1)
        ctx = g[:-1]
        if ctx not in totals[size]:
            return p(g[1:])
        v = counts[size].get(g, 0)
        mine = max(v - cuts[size][min(v, 3)], 0) if v else 0
        return (mine + freed[size][ctx] * p(g[1:])) / totals[size][ctx]

    def score(text):
        w = ["<s>"] * (order - 1) + text.split()
        return sum(math.log(p(tuple(w[i - order + 1:i + 1]))) for i in range(order - 1, len(w)))
    return score


def test_model_equals_brute_force(spark):
    texts = ["a b c a b", "b c d", "a b c d e f a", "c c c a", "f a b", ""] * 2 + ["a c b d f e"]
    train = spark.createDataFrame([("x", t) for t in texts] + [("y", "q q r"), ("y", None)], "lang string, text string")
    asked = ["a b c", "z a b", "c d e e", "", "a", None, "d d d d f e"]
    for order in (1, 2, 3):
        known, score = quality.train(train, order), brute(texts, order)
        got = quality.with_likelihood(spark.createDataFrame([(i, "x", t) for i, t in enumerate(asked)],
                                                            "i int, lang string, text string"), known).collect()
        for r in got:
            assert math.isclose(r.log_likelihood, score(r.text or ""), rel_tol=1e-4, abs_tol=1e-4)
            assert r.n_words == len((r.text or "").split())


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op9_kneser_ney_quality"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    shares = {r.quality: r.kept for r in got.join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.97 and shares[0] < 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (None, "a b", "xx", 1), (2, "a b", None, 1), (2, "a b", None, 1), (3, "", "en", 1)],
                                 "doc_id long, text string, lang string, keep int")
    for labels in ([], [(1, 1, 0), (2, None, 0), (9, 1, 0), (None, 1, 0), (2, 1, 0), (3, 1, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert quality.classify(docs, table).filter("keep").count() == 5
        kept = quality.keep_good(docs, table)
        assert kept.count() == 5 and kept.columns == docs.columns
    assert quality.classify(docs.limit(0), table).count() == 0


def test_training_text_is_dealt_to_languages_and_documents(spark):
    rows = [(i, "en", "word " * 20) for i in range(200)] + [(1000 + i, "xx", "rare " * 4) for i in range(8)] + [(2000 + i, "en", "long " * 40_000) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    first = {r.doc_id for r in labels.filter(quality.fold() == 0).collect()}
    got = {r.doc_id: r for r in quality.trusted_sample(docs, labels, chars=20_000).collect()}
    assert set(got) == first and any(i >= 2000 for i in first) and any(1000 <= i < 2000 for i in first)
    assert sum(len(r.text) for r in got.values()) <= 20_000
    assert all(r.text == text for i, _, text in rows if i < 2000 and (r := got.get(i)))
    few = quality.trusted_sample(docs, labels, most=12).collect()
    assert {r.lang for r in few} == {"en", "xx"} and len(few) < 40


def test_a_language_without_training_text_has_no_model(spark):
    docs = spark.createDataFrame([(i, "en" if i < 40 else "yy", f"a b c{i % 3}") for i in range(80)], "doc_id long, lang string, text string")
    labels = docs.filter((F.col("lang") == "en") | (quality.fold() == 1)).selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = quality.classify(docs, labels).filter("lang = 'yy'").collect()
    assert len(got) == 40 and all(r.keep and r.perplexity is None and r.threshold is None and r.score is None for r in got)


def test_long_documents_are_trained_on_all_over(spark):
    text = "".join(f"{i:05d} " for i in range(20_000))
    df = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "text string")
    got = [r.t for r in df.select(quality.spread_windows(F.col("text"), F.lit(10_000)).alias("t")).collect()]
    parts = [got[0][i:i + 2000] for i in range(0, len(got[0]), 2001)]
    assert got[1:] == ["short", "", None] and len(got[0]) <= 10_000
    assert [text.index(p) for p in parts] == [0, 39_333, 78_666, 118_000] and text.endswith(parts[-1])


def test_thresholds_and_keep_equal_brute_force(spark):
    """The query against the contract, with the model's likelihoods taken as given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {(r.doc_id): r for r in quality.with_likelihood(
        docs.select("doc_id", "lang", "text"), quality.train(quality.trusted_sample(docs, labels))).collect()}
    held = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").filter(quality.fold() == 1).collect()}
    rows = [r for k, r in scored.items() if k in held and r.n_words]
    want = {}
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        mean = -sum(r.log_likelihood for r in own) / sum(r.n_words for r in own)
        scores = sorted((-r.log_likelihood + 20 * mean) / (r.n_words + 20) for r in own)
        want[lang] = mean, scores[math.ceil(0.995 * len(scores)) - 1]
    for r in QUERIES["op9_kneser_ney_quality"](spark, SF).collect():
        mean, top = want[r.lang]
        score = (-scored[r.doc_id].log_likelihood + 20 * mean) / (r.n_words + 20)
        assert math.isclose(r.score, score, rel_tol=1e-6) and math.isclose(r.threshold, top, rel_tol=1e-6)
        assert r.keep == (r.score <= r.threshold or not r.n_words)
