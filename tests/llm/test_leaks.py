import hashlib
import random
import re

import duckdb
import pytest

from mailsift.llm import leaks
from mailsift.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    """Hit words and ids per text, by comparing every window."""
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for key, item in items:
            v = words(item)
            size = min(len(v), window)
            for part in {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else ():
                for i in range(len(w) - size + 1):
                    if tuple(w[i:i + size]) == part:
                        hit |= set(range(i, i + size))
                        ids |= {key} - {None}
        out.append((text, len(w), sorted(hit), sorted(map(str, ids))))
    return out


def seen(rows):
    return [(r.text, r.n_words, [i for s in r.spans for i in range(s.first, s.last + 1)], list(r.items)) for r in rows]


@pytest.mark.parametrize("window, block", [(4, 1 << 20), (3, 200), (10, 60), (1, 1 << 20)])
def test_small_alphabet(spark, monkeypatch, window, block):
    monkeypatch.setattr(leaks, "BLOCK", block)
    monkeypatch.setattr(leaks, "CHUNK", 12)
    draw = random.Random(window)
    text = lambda n: " ".join(draw.choices(["a", "B", "cé", "3"], k=n))
    items = [(i, text(draw.randrange(1, 30))) for i in range(25)] + [(3, text(7)), (3, text(7)), (None, text(6)), (77, None), (78, " .. ")]
    items.append(items[0])
    texts = [text(draw.randrange(60)) for _ in range(40)] + [items[5][1].upper() + "."] * 2 + [None, "", " - "]
    docs = spark.createDataFrame([(i % 7, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, block int")
    got = leaks.contamination(docs.repartition(3), spark.createDataFrame(items, "item_id long, text string"), window)
    assert sorted(seen(got.collect()), key=str) == sorted(brute(texts, items, window), key=str)
    assert "block" in got.columns


def test_places_and_removal(spark):
    item = "The quick brown fox jumps over the lazy dog again and again"
    docs = [(1, f"Élan: {item}! ok " + "other words here " * 20), (2, item), (3, "nothing here"), (4, None), (5, "")]
    df = spark.createDataFrame([(k, t, "mine") for k, t in docs], "doc_id long, text string, cut string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    span = leaks.contamination(df, items).filter("doc_id = 1").first().spans[0]
    assert (span.first, span.last, docs[0][1][span.start:span.end]) == (1, 12, item)
    kept = {r.doc_id: r for r in leaks.clean(df, items).collect()}
    assert set(kept) == {1, 3, 4, 5} and kept[1].text == "Élan: ! ok " + "other words here " * 20
    assert kept[3] == (3, "nothing here", "mine") and kept[4].text is None
    assert {r.doc_id: r.text for r in leaks.clean(df, items, longest=99, share=1.0).collect()} == dict(docs)


def test_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000 + "a b c"), (2, "x" * 500_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "w " * 5000 + "x")], "item_id long, text string")
    rows = {r.doc_id: r for r in leaks.contamination(docs, items).collect()}
    assert (rows[1].n_words, [tuple(s)[:2] for s in rows[1].spans], rows[1].items) == (300_003, [(0, 300_002)], ["1", "2"])
    assert not rows[2].spans
    assert all(not r.spans and not r.items for r in leaks.contamination(docs, items.limit(0)).collect())
    assert leaks.contamination(docs.limit(0), items).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    cursor = con.execute(ORACLE_SQL["op12_suffix_automaton"])
    names = [d[0] for d in cursor.description]
    got = [tuple(r) for r in QUERIES["op12_suffix_automaton"](spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(cursor.fetchall())
    assert any(r[-1] for r in got) and hashlib.sha256(b"").hexdigest() in {r[4] for r in got}
