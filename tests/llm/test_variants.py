import random
import re
import zlib
from collections import Counter

import pytest

from mailsift.llm import variants
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(docs):
    """The contract's words, read literally."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(one, two):
    if len(one) > len(two):
        one, two = two, one
    if one == two or len(two) - len(one) > 1:
        return False
    at = next((i for i, (c, d) in enumerate(zip(one, two)) if c != d), len(one))
    return one[at + (len(one) == len(two)):] == two[at + 1:]


def brute(words, factor=10):
    """All pairs of words, one by one."""
    rows = {}
    for w, n in words.items():
        around = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= factor * n else None
        rows[w] = (form, n, len(around), words[form] if form else None)
    out = set()
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, k, m))
    return out


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op11_finite_state_composition"](spark, SF).collect()}
    assert got == brute(words_of(docs))
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


@pytest.mark.parametrize("most, long", [(2000, 64), (3, 64), (2, 2)])
def test_dense_words_at_any_depth(spark, monkeypatch, most, long):
    monkeypatch.setattr(variants, "MOST", most)
    monkeypatch.setattr(variants, "LONG", long)
    draw = random.Random(most)
    words = {"".join(draw.choices("abé", k=draw.randrange(1, 8))): draw.choice([2, 3, 20, 21, 300, 4000, 10**6]) for _ in range(400)}
    words |= {"prefix" + w: n for w, n in list(words.items())[:60]}
    assert {tuple(r) for r in variants.grouped(table(spark, words)).collect()} == brute(words)


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzé": 50}
    rows = {r.word: r for r in variants.grouped(table(spark, words)).collect()}
    assert rows["aaaaaaa"].root == "aaabbbb" and rows["aaaaaaa"].form == "aaaaaab"
    assert (rows["zzzzzzz"].form, rows["zzzzzzz"].n_near) == ("zzzzzzy", 2)


def test_odd_documents(spark):
    long = "q" * 20_000
    docs = [(1, None), (2, ""), (3, "1234 !!"), (None, "Straßennamen Straßennamen ÉCLAIRAGE"), (4, "straßennamen ÀÀÀÀÀÀÀ×ÿ"), (4, "straßennamen"),
            (5, f"{long} {long} {long[1:]} {long[1:]} {long[2:]} {long[2:]}"), (6, "ab " * 50_000 + "Éclairage Éclairagé Āklairage")]
    docs += [(10 + i, "straßennamen strasennamen strassennamen") for i in range(40)]
    df = spark.createDataFrame([(k, t, 3, "x") for k, t in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = {tuple(r) for r in variants.grouped(variants.vocabulary(df, every=31)).collect()}
    assert got == brute(words_of(docs))
    assert variants.grouped(variants.vocabulary(df.limit(0), every=31)).count() == 0


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    docs = [(i, f"wordnumber {'abcdefghij'[i % 10] * 8} wordnumber") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in variants.vocabulary(df, every=31).collect()} == set(words_of(docs).items())
