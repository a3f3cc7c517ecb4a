import hashlib
import random

import pytest

from mailsift.llm import repeats
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, window):
    """Kept words per id."""
    words = {k: (t or "").encode().split() for k, t in docs.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i:i + window]), k)
    kept = {}
    for k, w in words.items():
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < k for j in range(window)}
        kept[k] = [x for i, x in enumerate(w) if i not in gone]
    return words, kept


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words, kept = brute(docs, 13)
    got = QUERIES["op5_difference_cover"](spark, SF).collect()
    assert {tuple(r) for r in got} == {
        (k, len(words[k]), len(words[k]) - len(kept[k]), hashlib.sha256(b" ".join(kept[k])).hexdigest()) for k in docs}
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("window", [1, 5, 13, 50])
def test_small_alphabet(spark, monkeypatch, window):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    draw = random.Random(window)
    pool = ["".join(draw.choices("ab", k=2)) for _ in range(3)] + [str(i) for i in range(40)]
    base = draw.choices(pool, k=400)
    docs = {i: " ".join(base[(a := draw.randrange(300)):a + draw.randrange(100)] + draw.choices(pool, k=draw.randrange(60)))
            for i in range(60)}
    docs |= {100: None, 101: "", 102: " \n "}
    df = spark.createDataFrame([(k, t, 7) for k, t in docs.items()], "doc_id long, text string, n_words int").repartition(4)
    words, kept = brute(docs, window)
    for r in repeats.remove_repeats(df, window).collect():
        gone = len(words[r.doc_id]) - len(kept[r.doc_id])
        assert (r.n_words, r.n_removed) == (len(words[r.doc_id]), gone)
        assert r.text == (b" ".join(kept[r.doc_id]).decode() if gone else docs[r.doc_id])


def test_no_rows_no_id_and_equal_ids(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted(str(r.n_removed) for r in repeats.remove_repeats(df).collect()) == ["0", "0", "0", "30"]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("period", list(repeats.COVERS))
def test_covers_meet_every_shift(period):
    cover = repeats.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
