import hashlib
import random
import re

from pyspark.sql import functions as F

from mailsift.llm import pii
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return total % 10 == 0


def holds(kind, match):
    d = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(KINDS.items())
             for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_information_sanitisation"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [spans.count(k + ":") for k in KINDS]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_odd_texts(spark):
    draw = random.Random(3)
    parts = ["a", "@", ".", "b-c", "1", "22", "255", "256", "+1", "+", "(", ")", " ", "-", "4242424242424242", "\n", "é", "x@y.z",
             "10.0.0.1", "+1 (988) 555-2485", "%"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(1500)]
    texts += ["a@b.cd+e@f.g", "x@" + "a." * 60000, "a" * 9000, "1" * 9000, "1." * 50000, "a@b.c " * 3000,
              "0000000255.1.1.1", "1.2.3.4.5.6.7.8", "😀 a@b.cc 😀 9.9.9.9", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = df.select("doc_id", pii.as_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("spans")).collect()
    for r in got:
        assert r.spans == brute(texts[r.doc_id]), texts[r.doc_id][:200]


def test_revealing_terms_are_replaced(spark):
    rows = [(i, f"wrote Tel +1 (988) 555-{1000 + i}, sometimes call word{'abcdefghij'[i % 10] * 3}") for i in range(10)]
    rows += [(100 + i, "wrote nothing of the kind" if i % 2 else "sometimes") for i in range(60)]
    rows += [(200, None), (200, None), (None, "call +1 (988) 555-7777"), (201, "call them")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    terms = {(r.kind, r.term): r.action for r in pii.revealing_terms(
        df.withColumn("base", pii.base_spans(F.coalesce("text", F.lit(""))))).collect()}
    assert terms == {("phone", "tel"): "remove", ("phone", "call"): "remove"}
    got = {r.doc_id: r for r in pii.sanitise(df).collect() if r.doc_id is not None}
    assert got[0].sanitised == "wrote  [PHONE], sometimes  wordaaa"
    assert got[201].sanitised == "call them" and got[200].sanitised is None and got[200].spans == []
    empty = pii.sanitise(df.limit(0))
    assert empty.count() == 0


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([("aXXYYb",)], "t string").select(pii.replaced(F.col("t"), F.expr(
        f"cast(array(named_struct('s', 1, 'r', 0, 'e', 4, 'k', 'email', 't', ''), "
        f"named_struct('s', 3, 'r', 1, 'e', 5, 'k', 'ip', 't', '')) as array<{pii.SPAN}>)")).alias("t"))
    assert df.first().t == "a[EMAIL]b"


def test_a_name_beside_one_address_is_revealing(spark):
    rows = [(i, f"from Kowalski k@x.org about topic {'abcdefghij'[i] * 4}") for i in range(10)]
    rows += [(20 + i, "seldom copied Nowak n@x.org") for i in range(10)]
    rows += [(100 + i, f"about topic from {'klmnopqrst'[i % 10] * 4}") for i in range(60)] + [(200, "ask Kowalski"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.revealing_terms(df.withColumn("base", pii.base_spans(F.coalesce("text", F.lit(""))))).collect()
    assert {(r.kind, r.term, r.action) for r in found if r.entity is not None} == {("email", "kowalski", "remove")}
    assert {(r.term, r.action) for r in found if r.entity is None} == {("kowalski", "generalise")}
    got = {r.doc_id: r.sanitised for r in pii.sanitise(df).collect()}
    assert got[0] == "from  [EMAIL] about topic aaaa" and got[200] == "ask " and got[201] is None and len(got) == len(rows)
    assert got[20] == "seldom copied Nowak [EMAIL]" and got[100] == rows[20][1]


def test_no_mark_is_missed(spark):
    hashes = spark.range(3000).select("id", F.xxhash64("id").alias("hash"))
    for top, most in ((1500, 1560), (0, 0)):
        known, passes = pii.marks(hashes.filter(F.col("id") < top))
        passed = {r.id for r in hashes.filter(passes(known, F.col("hash"))).collect()}
        assert passed >= set(range(top)) and len(passed) <= most
