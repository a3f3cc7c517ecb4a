import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mailsift.llm import bpe
from mailsift.llm.registry import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_tree_equals_one_pass(monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    known, draw = bpe.Codec(PATH), random.Random(leaf)
    parts = ["a", "b", "'s", "'", "r", "e", " ", "  ", "\n", "\t", "1", "23", "!", "é", "'ll", "日", "\x1c", "'r"]
    for _ in range(1500):
        text = "".join(draw.choices(parts, k=draw.randint(0, 40)))
        ids = known.encode(text)
        assert ids == np.array(known.encoding.encode_ordinary(text), "<u4").tobytes()
        assert known.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "ab " * 5000, None), (3, "ab " * 5000, None), (None, "é!", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert [r.n_tokens for r in got if not r.text] == [0, 0]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def expected_of(rows):
    """What the query has to return, by the library alone."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (
        line.split() for line in open(PATH, "rb").read().splitlines() if line)}
    library = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        yield (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256((text or "").encode()).hexdigest())


def test_query_equals_the_library(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "x" * 50_000), (-4, "日本語 é\u0301 🙂" * 3000), (-5, " \n\t " * 4000), (-6, "a<|endoftext|> b"),
           (-7, "\x00\x1c\u2028"), (-8, "repeated"), (-8, "repeated"), (None, "no id")]
    docs = given.union(spark.createDataFrame(odd, given.schema)).withColumn("ids", F.lit("own")).withColumn("decoded", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_bpe_tree"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = expected_of([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
