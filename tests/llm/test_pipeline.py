import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailsift.llm import quality
from tests.llm import test_minhash, test_pii, test_repeats
from tests.llm.test_packing import gapless, reference_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input of every stage and the result of the last one."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_return_documents(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes
        assert df.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_quality_keeps_what_its_operator_keeps(spark, steps):
    kept = quality.classify(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("keep")
    assert {r.doc_id for r in kept.collect()} == set(by_id(steps[1])) != set(by_id(steps[0]))


def test_one_of_each_group_stays(steps):
    kept = {k for k, _, _, first in test_minhash.brute(by_id(steps[1]), 5, 80) if first}
    assert set(by_id(steps[2])) == kept and by_id(steps[2]).items() <= by_id(steps[1]).items()


def test_repeated_passages_go(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    words, kept = test_repeats.brute(before, corpus_pipeline.PASSAGE)
    assert set(after) == set(before)
    for k in before:
        same = len(kept[k]) == len(words[k])
        assert after[k] == (before[k] if same else b" ".join(kept[k]).decode())


def test_no_personal_data_is_left(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert set(after) == set(before) and not any(map(test_pii.brute, after.values()))
    assert any(map(test_pii.brute, before.values()))


def test_every_token_is_packed(steps):
    rows, ids = steps[5].collect(), reference_ids([t or "" for t in by_id(steps[4]).values()])
    assert sum(r.length for r in rows) == sum(map(len, ids)) and gapless(rows)


def test_run_equals_the_stages(spark, steps):
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(place).collect())) == sorted(map(tuple, steps[5].select(place).collect()))


TAKEN = ["keep", "Score", "n_words", "threshold", "perplexity", "log_likelihood", "packed_text", "repeated_windows", "anchors",
         "hash", "known", "text_hash", "reveals", "base", "spans", "sanitised", "names", "term", "kept", "component_id", "aside0",
         "a.b"]
COPIED, OWN = (" ".join(f"{w}{i}" for i in range(60)) for w in ("copied", "own"))
ODD = [(1_000_001, " ".join(f"w{i}" for i in range(150_000)) + " write to me@x.org"), (1_000_002, COPIED), (1_000_002, COPIED),
       (None, COPIED), (1_000_003, None), (1_000_004, ""), (1_000_005, COPIED + " "), (1_000_006, f"{OWN} {COPIED}")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_odd_rows_and_all_columns(spark, name, stage):
    rows = [(doc, text, None, None, None if text is None else len(text), *(f"{c} {i}" for c in TAKEN))
            for i, (doc, text) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in TAKEN))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = {int(r[-1].split()[1]): tuple(r) for r in out.collect()}
    for i, r in got.items():
        assert r[5:] == rows[i][5:] and r[0] == rows[i][0] and r[4] == (None if r[1] is None else len(r[1]))
    changed = {i: r[1] for i, r in got.items() if r[1] != ODD[i][1]}
    assert set(got) == set(range(len(ODD))) - ({6} if name == "MinHash near-dedup" else set())
    if name == "PII":
        assert set(changed) == {0} and changed[0] == ODD[0][1].replace("me@x.org", "[EMAIL]")
    elif name == "substring dedup":
        assert changed == {6: "", 7: OWN}
    else:
        assert not changed


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
