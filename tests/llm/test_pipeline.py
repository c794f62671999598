"""The stages one after another, each held against its operator's own result."""

import corpus_pipeline
import rows
from pyspark.sql import functions as F

from colloquy.llm import cotraining, decontaminate, jaccard, line_labels
from colloquy.llm.support import settle


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("labels", "benchmark"))

    def verdicts(name, docs):
        if name == "quality rules":
            judged, lines = line_labels.judge_lines(docs, line_labels.train(docs, labels))
            return judged.where(line_labels.kept(lines))
        if name == "quality classifier":
            scored, quality = cotraining.score(docs, cotraining.train(docs, labels))
            return scored.where(cotraining.accepted(quality))
        if name == "near copies":
            return jaccard.link_documents(docs, corpus_pipeline.COPY_WORDS, corpus_pipeline.COPY_THRESHOLD).where("doc_id = component_id")
        found, hits = decontaminate.find_windows(docs, bench)
        return found.where(~decontaminate.contaminated(hits))

    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = settle(stage(spark, docs, folder), "stage")
        assert kept.columns == docs.columns
        assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted(x.doc_id for x in verdicts(name, docs).select("doc_id").collect())
        assert 0 < kept.count() <= docs.count()
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    covered = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert covered.where("n != all").count() == 0 and covered.count() == docs.count()
    whole = corpus_pipeline.run(spark, folder)
    assert {x.doc_id for x in whole.select("doc_id").distinct().collect()} == {x.doc_id for x in docs.collect()}


def test_stages_on_awkward_rows(spark, tmp_path):
    rows.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (rows.documents(spark, 20), rows.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, str(tmp_path)), "stage")
        assert "sequence_id" in docs.columns
