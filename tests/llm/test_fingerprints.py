import hashlib
import random

import numpy as np
import pytest

from mailsift.llm import fingerprints as fp
from mailsift.llm.minhash import shingles
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def expected(docs):
    keys = sorted(docs, reverse=True)
    for key, after in zip(keys, keys[1:] + keys[:1]):
        text, following = docs[key] or "", docs[after] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed, other = (fp.sketch(t.encode()) for t in (text, edited, following))
        yield (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(own), fp.as_text(changed),
               fp.likeness(own, changed), fp.likeness(own, other), fp.containment(own, other))


@pytest.mark.parametrize("run", [7, 4096])
def test_query_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(fp, "RUN", run)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {tuple(r) for r in QUERIES["op2_threshold_sketch"](spark, SF).collect()} == set(expected(docs))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "RUN", 2)
    from mailsift.llm.arrow import whole_texts
    rows = [(5, None), (5, "x y"), (5, "x y"), (9, "a b c d e f g"), (1, ""), (None, "abc"), (7, "é" * 5), (-3, "w " * 4000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, edited string")
    got = fp.edited_neighbours(whole_texts(df)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[None].edited == "ab" and by[9].edited == "a b c d" + "ééééé" and by[-3].edited.endswith(" a b c d e f g")
    one = spark.createDataFrame([(4, "ab")], "doc_id long, text string")
    assert [r.edited for r in fp.edited_neighbours(one).collect()] == ["aa"]
    assert fp.edited_neighbours(one.limit(0)).count() == 0


def test_estimates_follow_the_sets():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(9000)]
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        one = draw.choices(words, k=6000)
        cut = int(6000 * share)
        two = one[:cut] + draw.choices(words, k=6000 - cut)
        a, b = (" ".join(w).encode() for w in (one, two))
        s, t = shingles(a, 5), shingles(b, 5)
        assert abs(fp.likeness(fp.sketch(a), fp.sketch(b)) - len(s & t) / len(s | t)) < 0.06
        small = " ".join(one[:800]).encode()
        assert abs(fp.containment(fp.sketch(small), fp.sketch(b)) - len(shingles(small, 5) & t) / 796) < 0.15


def test_sketches_merge():
    a, b = b"one two three four five six", b" ".join(b"%d" % i for i in range(500))
    whole = np.union1d(*(fp.window_hashes(fp.word_hashes(t.split()), 5) for t in (a, b)))
    assert fp.merge(fp.sketch(a), fp.sketch(b)).tolist() == whole[:max(1, np.searchsorted(whole, fp.BOUND))].tolist()
    assert fp.from_text(fp.as_text(fp.sketch(b))).tolist() == fp.sketch(b).tolist()
