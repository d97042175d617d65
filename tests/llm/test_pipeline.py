"""The pipeline's stages, each judged on its own input."""

import brute
import corpus_pipeline
from siltworks.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.join(before, columns, "left_anti").count() == 0
        if k == 2:
            items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            bad = {x[0] for x in brute.contamination([tuple(r) for r in before.select("doc_id", "text").collect()], items) if x[-1]}
            left = {r[0] for r in docs.select("doc_id").collect()}
            assert bad and left == {r[0] for r in before.select("doc_id").collect()} - bad
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5]
    assert docs.groupBy("shard").agg({"slot": "max", "*": "count"}).filter("`max(slot)` + 1 <> `count(1)`").count() == 0


def test_quality_stage_agrees_with_the_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = corpus_pipeline.quality_filter(spark, docs, SF).select("doc_id")
    assert labels.filter("quality = 1").join(kept, "doc_id", "left_anti").count() <= 3
    assert labels.filter("quality = 0").join(kept, "doc_id", "left_semi").count() <= 5
