"""The queries of this subpackage: each applies an operator to its whole table."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from mailsift.llm import (bpe, fingerprints, leaks, lm, middle, minhash, neighbours, packing, pii, quality, repeats,
                          reputation, variants)
from mailsift.llm.arrow import table, whole_texts

QUERIES, ORACLE_SQL = {}, {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op6_bpe_tree(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(whole_texts(table(spark, sf_dir, "documents")), path)
    return bpe.decode(ids, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_sum_of_squares_packing(spark, sf_dir):
    # the ranks file holds the same vocabulary and merges as byte_bpe_50k.json
    cut = packing.pieces(whole_texts(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=packing.ADDED)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op3_signature_join(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op5_difference_cover(spark, sf_dir):
    kept = repeats.remove_repeats(whole_texts(table(spark, sf_dir, "documents")), window=13)
    words = F.btrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query
def op8_information_sanitisation(spark, sf_dir):
    found = pii.sanitise(whole_texts(table(spark, sf_dir, "documents")))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
                        pii.as_text(F.col("spans")).alias("spans"))


@query
def op2_threshold_sketch(spark, sf_dir):
    rows = fingerprints.edited_neighbours(whole_texts(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_held")


@query
def op4_host_reputation(spark, sf_dir):
    # the label of a page is that of the document of the same number
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), reputation.outcome().alias("bad"))
    return reputation.judge(table(spark, sf_dir, "pages"), labels).select(
        "page_id", "host", "path", "rule", "verdict", "labelled", "bad")


ORACLE_SQL["op4_host_reputation"] = reputation.oracle_sql()


@query
def op7_multi_index(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op9_kneser_ney_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_pseudo_likelihood(spark, sf_dir):
    docs = whole_texts(table(spark, sf_dir, "documents"))
    return lm.score_words(docs, lm.train(docs)).select(
        "doc_id", "n_tokens", "pseudo_log_likelihood",
        F.try_divide("pseudo_log_likelihood", "n_tokens").alias("mean_log_probability"))


@query
def op11_finite_state_composition(spark, sf_dir):
    return variants.grouped(variants.vocabulary(table(spark, sf_dir, "documents"), shortest=7, least=2, every=31), factor=10)


@query
def op12_suffix_automaton(spark, sf_dir):
    docs, items = whole_texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return leaks.contamination(docs, items, window=10).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL["op12_suffix_automaton"] = leaks.oracle_sql()


@query
def op13_piece_table(spark, sf_dir):
    rows = middle.restore(middle.transform(whole_texts(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL["op13_piece_table"] = middle.oracle_sql()


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
