from pyspark.sql import functions as F

from mailsift.llm import quality


def test_every_trusted_document_of_the_fold_is_trained_on(spark):
    """Each document has a word of its own, so one left out of the training would be less likely than the others."""
    docs = spark.range(11_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
                                      F.expr("concat('w', id, ' w', id)").alias("text"))
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = quality.classify(docs, labels).withColumn("fold", quality.fold()).groupBy("fold").agg(
        F.count("*").alias("n"), F.min("perplexity").alias("low"), F.max("perplexity").alias("high")).collect()
    of = {r.fold: r for r in got}
    assert of[0].n > 5_000 and of[0].n + of[1].n == 11_000
    assert of[0].high < of[0].low * 1.0001 and of[0].high < of[1].low


def test_long_trusted_documents_are_trained_on_whole(spark):
    docs = spark.createDataFrame([(i, "en", f"word{i} " * 30_000) for i in range(12)], "doc_id long, lang string, text string")
    got = quality.trusted_documents(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic")).withColumn("fold", quality.fold())
    assert {(r.fold, r.n) for r in got.select("fold", F.length("text").alias("n"), "doc_id").collect() if r.doc_id < 10} == {(0, 180_000)}
