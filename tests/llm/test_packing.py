import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mailsift.llm import packing
from mailsift.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference_ids(texts):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    return [[*e.ids, 2] for e in known.encode_batch(texts, add_special_tokens=False)]


def gapless(rows):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    return len(at)


def test_query(spark):
    rows = QUERIES["op10_sum_of_squares_packing"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = dict(zip(docs, reference_ids(list(docs.values()))))
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
        got[r.doc_id].append((r.piece, r.start, r.length))
    for key, places in got.items():
        assert [p for p, _, _ in places] == list(range(len(places)))
        assert sum(n for _, _, n in places) == len(ids[key]) and all(n == 1024 for _, _, n in places[1:])
        assert [s for _, s, _ in places] == np.cumsum([0, *[n for _, _, n in places[:-1]]]).tolist()
    assert set(got) == set(docs)
    assert gapless(rows) <= 1.03 * -(-sum(map(len, ids.values())) // 1024)


def test_odd_texts_and_tables(spark):
    texts = [None, "", " ", "  a  b", "a \n b\n\nc ", "<|endoftext|> x", "x" * 3000, "a " * 1023 + "a", "é'll ’s x"] * 2
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    cut = packing.pieces(docs, PATH)
    rows = packing.pack(cut).collect()
    assert gapless(rows) >= 1
    assert sum(r.length for r in rows) == sum(map(len, reference_ids([t or "" for t in texts])))
    known = packing.Words(PATH)
    assert [known.encode([t or ""])[0] + b"\2\0\0\0" for t in texts] == [
        np.array(i, "<u4").tobytes() for i in reference_ids([t or "" for t in texts])]
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0


def test_best_fit_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 1024, 4000)
    sequences, _ = packing.sum_of_squares(lengths, 1024)
    assert sequences.max() + 1 <= 1.02 * lengths.sum() / 1024


def test_added_token_as_the_json_tokenizer_reads_it():
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|> b  c <|endoftext|>\n", "none <|endof", ""]
    expected = [np.array(e.ids, "<u4").tobytes() for e in known.encode_batch(texts, add_special_tokens=False)]
    assert packing.with_added(packing.Words(PATH), texts, packing.ADDED) == expected
