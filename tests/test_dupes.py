"""Repeated transcripts: the documents are read and cut once."""

from collections import Counter

from scribespark.plans import fixtures


def test_repeated_rows_read_documents_once(spark, tmp_path):
    docs = [(i, "a b c") for i in (*range(1, 20), 34)] + [(None, "d e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dupes = fixtures.asr_dupes(spark, str(tmp_path))
    assert dupes._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    found = Counter((r.doc_id, r.model, r.ordinal_in) for r in dupes.collect())
    ids = [i for i, _ in docs]
    assert found == Counter((i, m, k) for i in ids for m in fixtures.MODELS for k in ((1, 2) if i in (17, 34) else (1,)))
