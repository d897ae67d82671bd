"""What Python workers hold while stages follow each other."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpus_pipeline import quality
from meritlake.llm.quality import score, train

FOLDER = "/root/testdata/sf0.001"


def test_a_step_forgets_the_tables_of_others(spark):
    """One worker runs three steps in turn; each ends with its own tables alone."""
    def steps(batches):
        from meritlake.llm import near_dedup, tokenizing
        from meritlake.llm import quality as scoring

        near_dedup._begin()
        near_dedup.hashed_words("a b c")
        near_dedup._worker_sampler()
        held = [(len(near_dedup._hashes), len(near_dedup._sampler))]
        scoring._begin()
        scoring.features("d e f g")
        held.append((len(near_dedup._hashes), len(near_dedup._sampler), len(scoring._hashes)))
        tokenizing.remember_only("tokens", tokenizing._encoders.clear)
        held.append((len(scoring._hashes),))
        yield from (pa.RecordBatch.from_pydict({"held": [str(held)]}) for _ in batches)

    rows = spark.range(0, 1, 1, 1).mapInArrow(steps, "held string").collect()
    assert [r.held for r in rows] == [str([(3, 1), (0, 0, 4), (0,)])]


def test_a_kept_text_goes_to_the_workers_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = train(docs, labels, label="quality")
    kept = score(docs.select("doc_id", "text"), model)
    assert kept.columns == ["doc_id", "text", "score"]
    beside = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    assert {(r.doc_id, r.score) for r in kept.collect()} == {(r.doc_id, r.score) for r in beside.collect()}
    assert kept.exceptAll(docs.join(beside, "doc_id").select(*kept.columns)).count() == 0
    filtered = quality(spark, docs, FOLDER)
    assert filtered.schema.names == docs.columns and filtered.exceptAll(docs).count() == 0
    first = docs.withColumn("score", F.lit("own"))
    assert quality(spark, first, FOLDER).filter("score <> 'own'").count() == 0
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    scoring = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert scoring.split(")")[0].count("text#") == 1 and "text, text#" not in plan
