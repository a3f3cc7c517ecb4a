import random

import pytest

from mailsift.llm import minhash
from mailsift.llm.components import components
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, size=2, percent=80):
    sets = {k: minhash.shingles((t or "").encode(), size) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in docs if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), find(k), find(k) == k) for k in docs}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_signature_join"](spark, SF).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == brute(docs)


def test_chains_copies_and_odd_texts(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    docs, text = {}, [word() for _ in range(60)]
    for i in range(120):  # a chain: every text differs a little from the one before
        docs[i] = " ".join(text)
        text[draw.randrange(60)] = word()
    docs |= {200 + i: docs[3] for i in range(40)} | {300: None, 301: "", 302: "One", 303: "one", 304: " \t", 305: "one two"}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()], "doc_id long, text string, root string")
    assert {tuple(r) for r in minhash.near_duplicates(df, size=2).collect()} == brute(docs)
    empty = minhash.near_duplicates(df.limit(0), size=2)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_rows_of_one_id_and_without_id(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, size=2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_threshold_of_matches(percent):
    least = minhash.needed(percent)
    assert 0 < least < 32 * (percent / 100) ** 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and len(got) == 203
