"""The stages of the pipeline that run Python send a thousand texts at a time to a worker, whoever starts the job."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexisieve.llm import packing, toxicity

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_send_small_batches(spark, monkeypatch):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    sizes = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    monkeypatch.setattr(toxicity, "fit", lambda *given: None)
    monkeypatch.setattr(toxicity, "score", lambda held, model: held.withColumn("score", sizes("row.doc_id").cast("double")))
    kept = toxicity.drop_toxic(docs.coalesce(1), None, threshold=1000.5)
    monkeypatch.setattr(packing, "pack_documents", lambda docs: docs.select("doc_id", sizes("doc_id").alias("n")))
    packed = corpus_pipeline.pack(spark, docs.coalesce(1), "")
    assert kept.count() == 2500 and kept.columns == ["doc_id", "text"]
    assert packed.agg(F.max("n")).first()[0] <= 1000
    assert spark.conf.get(NAME) == "10000"
