"""The pipeline's stages: columns, effects, and what stays."""

import corpus_pipeline
from schemagate.llm import queries
from schemagate.llm.common import keep


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = keep(stage(spark, docs, sf_dir), "test-stage")
        counts.append(after.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if k == 0:
            bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0")
            assert docs.join(bad, "doc_id").count() > after.join(bad, "doc_id").count()
        if k == 1:
            assert after.groupBy("text").count().where("count > 1 and trim(text) != ''").count() == 0
        docs = after
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0 and docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
