"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from scribespark.llm import dart_minhash, exact_dedup, html_text, licenses, line_dedup, mixing, packing, pii, quality, token_file

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, digest string, row string, size string, comp string, copies string, doc string, units string, x string, kept string, part string, votes string, first string, draw string, f string"
LONG = " ".join(f"w{i % 5000}" for i in range(20_000))


def _row(doc_id, text, source="s"):
    return (doc_id, text, source, "en", 0) + ("clash",) * 15


ROWS = [
    _row(1, "one two three four five six"),
    _row(1, "one two three four five six"),
    _row(2, "ONE two three four five six", None),
    _row(None, None),
    _row(None, ""),
    _row(3, "", None),
    _row(4, LONG),
    _row(5, LONG + " tail"),
    _row(6, "é" * 3000 + "\n\n\t\n a@b.cd", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def tokens(docs, tmp_path, name):
    token_file.write_tokens(docs, f"file://{tmp_path}/{name}", WORD, "word", 2)
    return token_file.read_tokens(docs.sparkSession, f"file://{tmp_path}/{name}")


def test_tokens(odd, empty, tmp_path):
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens(odd, tmp_path, "a").collect())
    assert [r[1] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6]
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:])) and rows[0][2] == 1
    assert tokens(empty, tmp_path, "b").count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd, BYTE, "byte", 1).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r.length)
    assert sum(by_doc[None]) == 2 and sum(by_doc[3]) == 1 and set(by_doc) == {1, 2, 3, 4, 5, 6, None}
    assert packing.pack(empty, BYTE, "byte", 1).count() == 0


def test_exact(odd, empty):
    got = sorted(((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.decide(odd).collect()))
    assert got == [(-1, 3, 3, False), (-1, 3, 3, False), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 3, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True)]
    kept = exact_dedup.drop_duplicates(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6] and kept.columns == odd.columns
    twice = odd.where("doc_id = 1")
    assert [r.kept for r in exact_dedup.decide(twice).orderBy("kept").collect()] == [False, True]
    assert exact_dedup.drop_duplicates(twice).count() == 1
    assert exact_dedup.decide(empty).count() == exact_dedup.drop_duplicates(empty).count() == 0


def test_quality(odd, empty):
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert got[4].n_words == 20_000 and got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[4].n_repeat_words == 20_000 and got[4].base_failed
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality.judge(odd).collect())
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0


def test_pii(odd, empty):
    got = {r.doc_id: pii_spans(r.spans) for r in pii.find(odd).collect()}
    assert got[6] == [("email", 3005, 3011)] and got[3] == [] and got[None] == []
    assert pii.find(empty).count() == 0


def pii_spans(spans):
    return [(s.kind, s.s, s.e) for s in spans]


def test_mixing(odd, empty):
    got = mixing.decide(odd).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    sources = {r.source: r.source_size for r in got}
    assert sources == {"s": 6 + 6 + 20_000 + 20_001, "t": 2, None: 6}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.decide(empty).count() == mixing.mix(empty).count() == 0
    blank = odd.where("text is null or text = ''")
    assert {r.taken for r in mixing.decide(blank).collect()} == {0}


def test_near(odd, empty):
    got = {(r.doc_id, r.class_id, r.class_size) for r in dart_minhash.near_duplicates(odd).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (None, 3, 3), (3, 3, 3), (4, 4, 2), (5, 4, 2), (6, 6, 1)}
    kept = dart_minhash.keep_one(odd)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3, 4, 6] and kept.columns == odd.columns
    assert dart_minhash.near_duplicates(empty).count() == dart_minhash.keep_one(empty).count() == 0


def test_lines(odd, empty):
    got = sorted((r.doc_id or 0, r.n_lines, r.removed) for r in line_dedup.find(odd).collect())
    assert got == [(0, 1, []), (0, 1, []), (1, 1, []), (1, 1, [0]), (2, 1, [0]), (3, 1, []), (4, 1, []), (5, 1, [0]), (6, 4, [])]
    cleaned = line_dedup.remove_lines(odd)
    assert cleaned.columns == odd.columns and {r.text for r in cleaned.where("doc_id = 2").collect()} == {""}
    assert line_dedup.find(empty).count() == line_dedup.remove_lines(empty).count() == 0


def test_licences(odd, empty):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert {r.origin for r in licenses.scan(odd, path).collect()} == {None} and licenses.scan(odd, F.lit(None)).count() == len(ROWS)
    assert licenses.scan(empty, path).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a &lt; b<p>c" * 2000, "x"), (2, "u", "<!-- x", "x"), (3, "u", "<a" * 500, "x")], schema)
    got = [(r.page_id, r.text) for r in html_text.extract(pages).collect()]
    assert got[0] == (1, "") and got[1] == (None, "") and got[2][1].startswith("a < b\nc\na < b\n") and got[3] == (2, "")
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
