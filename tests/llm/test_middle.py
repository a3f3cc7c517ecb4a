import hashlib
import re

import duckdb
import pytest

from mailsift.llm import middle
from mailsift.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a<P>b\nc"), (7, "ü\né\nend"), (8, "ü\né\nend"),
       (8, "ü\né\nend"), (None, "x\ny\n"), (9, "<S\n>\n<\nM>\n<"), (10, "tail \n <M> "), (-3, "x\r\n\x0by\n")]
ODD += [(100 + i, "".join(f"row {j}\n" for j in range(i))) for i in range(40)]


def plainly(key, text):
    """The contract, read literally over code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        form, out = "plain", text
    elif h[3] % 100 < 50:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    plain = form == "plain"
    return (key, n, form, None if plain else len(p), None if plain else len(m), out, text)


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(k, t, "mine", 1.5) for k, t in ODD],
                               "doc_id long, text string, form string, output_sha256 double").repartition(3)
    got = middle.restore(middle.transform(df)).collect()
    mine = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got]
    assert sorted(mine, key=str) == sorted((plainly(k, t) for k, t in ODD), key=str)
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transform(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "é line\n" * 200_000 + "x" * 1_000_000
    row = middle.restore(middle.transform(spark.createDataFrame([(4, text)], "doc_id long, text string"))).first()
    assert (row.output, row.restored) == plainly(4, text)[5:]


def test_rate_leaves_documents_plain(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'a\nb\nc\n' AS text")
    assert 700 < middle.transform(df, rate=40).filter("form <> 'plain'").count() < 900


@pytest.mark.parametrize("at", range(8))
def test_cut_splits_any_table(at):
    table = [(0, 2, 4), (1, 0, 3), (0, 0, 1)]
    left, right = middle.cut(table, at)
    text = b"abcd"
    assert b"".join(middle.slices(left, text)) == b"cd<P>a"[:at]
    assert b"".join(middle.slices(right, text)) == b"cd<P>a"[at:]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(ORACLE_SQL["op13_piece_table"])
    names = [d[0] for d in cursor.description]
    assert set(map(tuple, QUERIES["op13_piece_table"](spark, SF).select(*names).collect())) == set(cursor.fetchall())
