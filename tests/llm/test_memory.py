"""What the pipeline's stages hold in Python workers."""

import pyarrow as pa
import pytest

import corpus_pipeline as P
from wardline.llm.mixing import Mix, given_weights


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_batches_of_a_stage(spark, name, stage):
    """Also when a stage has just been planned, no batch that reaches Python is much over half a megabyte, whatever the texts' lengths."""
    held = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    docs = spark.createDataFrame([(i, f"Some plain text of number {i} that is long enough to be kept here.", "en", "src-1") for i in range(30)], "doc_id long, text string, lang string, source string")
    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('some words ', cast(100 + id % 200 as int)) AS text")
    try:
        stage(spark, docs, "")
        sizes = [r.n for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert sum(sizes) > 4_000_000 and max(sizes) < 1 << 20


def test_weights_need_no_python_on_executors(spark):
    mix = Mix({("d0",): 3, ("d1",): 1.5, ("d0", "en"): 2})
    for path, want in ((["domain"], [("d0", 3.0), ("d1", 1.5)]), (["domain", "lang"], [("d0", "en", 2.0)]), (["domain", "lang", "source"], [])):
        got = given_weights(spark, mix, path)
        assert got.columns == [*path, "weight"] and sorted(map(tuple, got.collect())) == want
        assert "ExistingRDD" not in got._jdf.queryExecution().toString()
