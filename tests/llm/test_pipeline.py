import time
from pathlib import Path

import corpus_pipeline


def test_no_shuffle_of_an_earlier_stage_stays(spark, tmp_path, monkeypatch):
    """A stage's shuffle is gone when the next one begins, though its plan is still referred to."""
    rows = spark.createDataFrame([(k, f"text {k} " * 200, "en", "a", 9) for k in range(2000)], "doc_id long, text string, lang string, source string, n_chars int")
    rows.selectExpr("doc_id", "text || uuid() text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    held, left = [], []

    def shuffled():
        folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return sum(p.stat().st_size for p in folder.rglob("shuffle_*.data"))

    def spread(spark, docs, sf_dir):
        held.append(docs.repartition(3, "text"))
        return held[-1]

    def look(spark, docs, sf_dir):
        for _ in range(50):
            left.append(shuffled() - before)
            if left[-1] <= 0:
                break
            time.sleep(0.1)
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("spread", spread), ("look", look)])
    before = shuffled()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2000
    assert left[-1] <= 0
