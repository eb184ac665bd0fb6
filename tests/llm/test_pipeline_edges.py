"""The whole pipeline over empty tables, null ids and texts, repeated rows and extra columns."""

import zlib
from collections import defaultdict

import corpus_pipeline
from scribespark.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, size string, comp string, place string"
DATA = "/root/testdata/sf0.001/documents.parquet"


def write(spark, folder, rows):
    spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0


def test_odd_rows(spark, tmp_path):
    """Null ids and texts go through as the stages say; every kept document is packed whole, as often as the mixture takes it."""
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(DATA), "").orderBy("doc_id").collect()
    texts = [r.text for r in docs]
    rows = [(k, t, "en", "s" if k % 2 else "t", 0) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 0), (1000, texts[4].lower(), None, None, None), (None, texts[5] + " one more word", "en", "s", 0), (None, None, None, "s", 0), (1001, "", "en", None, 0), (1002, "short", "en", "s", 0)]
    out = corpus_pipeline.run(spark, write(spark, tmp_path, rows)).collect()
    known = {r.doc_id for r in out}
    assert known <= {*range(len(texts)), 1000, None} and len(known) > 0.3 * len(texts)
    assert 4 not in known  # of equal texts the largest id stays
    whole = defaultdict(int)
    for r in out:
        whole[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
    tokens = {r.doc_id: r.doc_tokens for r in out}
    assert all(whole[k] % tokens[k] == 0 and whole[k] // tokens[k] <= 3 for k in whole)
    ends = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 and n <= 2048 for n in ends.values())


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(write(spark, tmp_path, [(k, f"a few words {k} and then more", "en", "s", 0) for k in range(8)]) + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_matches_of_removed_lines(spark):
    """Every removed line names an earlier line that it equals or is similar to."""
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"{line}\nalone here with some other words"), (2, f"{line} eleven\n{line}"), (3, f"zero {line} eleven\nalone here with some other words")]
    found = {r.doc_id: r for r in line_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {k: t.split("\n") for k, t in rows}
    for k, r in found.items():
        assert [m.line for m in r.matches] == r.removed
        for m in r.matches:
            a, b = set(texts[k][m.line].split()), set(texts[m.match_doc][m.match_line].split())
            assert (m.match_doc, m.match_line) < (k, m.line) and len(a & b) >= 0.8 * len(a | b)
    assert found[1].removed == [] and found[2].removed == [0, 1] and found[3].removed == [0, 1]
