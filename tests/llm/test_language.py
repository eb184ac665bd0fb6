"""Language labels: held-out accuracy, and models, words and paths against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribespark.llm import language, queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.QUERIES["op11_language"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (r in held) for r in got) and len(held) > 250
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_learns_from_all_documents_that_are_not_held_out(spark, model):
    """Trigram counts and scores against plain loops; held-out rows, ids and sources have no part in them."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("lang in ('de', 'fr')").collect()
    counts = {"de": Counter(), "fr": Counter()}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            low = "".join(c.lower() if c.isalpha() else " " for c in f" {r.text} ")
            counts[r.lang].update(low[k - 1 : k + 2] for k in range(1, len(low) - 1) if low[k] != " ")
    changed = spark.createDataFrame([(r.doc_id, r.text if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 else "x", r.lang, "y") for r in rows], "doc_id long, text string, lang string, source string")
    for docs in (changed, spark.createDataFrame(rows).select("doc_id", "text", "lang")):
        fitted = language.fit(docs)
        assert fitted.langs == ["de", "fr"]
        for gram in [g for g, _ in (counts["de"] + counts["fr"]).most_common(300)]:
            share = [counts[x][gram] / sum(counts[x].values()) for x in ("de", "fr")]
            want = [language.WEIGHT * math.log((1 - language.SHARED) * s / (sum(share) / 2) + language.SHARED) for s in share]
            words = language.words_of([gram.strip()]) if " " in gram else None
            if words is not None and len(gram.strip()) == 2 and gram[0] == " ":
                assert fitted.scores[:, words.trigrams[0]] == pytest.approx(want, abs=0.02)


def plain_words(text):
    return [(m, n) for m, n in _runs(text)]


def _runs(text):
    at = None
    for k, c in enumerate(text + " "):
        if c.isalpha() and at is None:
            at = k
        elif not c.isalpha() and at is not None:
            yield at, k
            at = None


def test_words():
    texts = ["Ab c-d é9ü", "", "  ", "x"]
    words = language.words_of(texts)
    assert [(t, a, b) for t, a, b in zip(words.text.tolist(), words.start.tolist(), words.end.tolist())] == [(k, a, b) for k, t in enumerate(texts) for a, b in plain_words(t)]
    mixed = language.words_of(["словоword καιword", "漢字漢字漢字かなかな", "áb", "́"])
    assert [(a, b) for t, a, b in zip(mixed.text, mixed.start, mixed.end) if t == 0] == [(0, 5), (5, 9), (10, 13), (13, 17)]
    assert [(a, b) for t, a, b in zip(mixed.text, mixed.start, mixed.end) if t == 1] == [(0, 4), (4, 6), (6, 10)]
    assert mixed.letters.tolist()[-2:] == [2, 0]
    assert len(language.words_of([]).start) == len(language.words_of([""]).start) == 0


def plain_path(scores, cost):
    """Viterbi's recursion, a word at a time."""
    value, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(value)), key=lambda k: value[k])
        back.append([k if value[k] >= value[top] - cost else top for k in range(len(value))])
        value = [row[k] + max(value[k], value[top] - cost) for k in range(len(value))]
    path = [max(range(len(value)), key=lambda k: value[k])]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], max(value)


def total(scores, path, cost):
    return sum(scores[t][k] for t, k in enumerate(path)) - cost * sum(a != b for a, b in zip(path, path[1:]))


def test_paths_are_best():
    rng = np.random.default_rng(4)
    for langs in (1, 2, 5):
        docs = [np.repeat(rng.normal(0, s, (n, langs)), 3, axis=0) for n in (1, 1, 2, 7, 40) for s in (0.3, 2, 6)]
        for scores, path in zip(docs, language.best_paths(docs, 4.0)):
            want, value = plain_path(scores.tolist(), 4.0)
            assert total(scores, path.tolist(), 4.0) == pytest.approx(value) and total(scores, want, 4.0) == pytest.approx(value)
            best = int(scores.sum(axis=0).argmax())
            if langs > 1 and not language._switches_pay(scores, best, 4.0):
                assert total(scores, [best] * len(scores), 4.0) == pytest.approx(value)


def test_spans_of_mixed_texts(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 600 and 3000 and lang = 'de'").orderBy("doc_id").limit(3).collect()]
    other = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 600 and 3000 and lang = 'es'").orderBy("doc_id").limit(3).collect()]
    mixed = [f"{a}\n{b[:400]}" for a, b in zip(texts, other)]
    for text, whole, (lang, score, spans) in zip(mixed, texts, language.label(model, mixed)):
        assert lang == "de" and 0.4 < score < 1 and spans[0][2] == "de" and spans[-1][2] == "es"
        assert abs(spans[-1][0] - len(whole)) < 40 and spans[-1][1] <= len(text)
        assert all(a[1] <= b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))


def test_long_texts_in_pieces(model, monkeypatch):
    texts = ["Der und die das, " * 300, "", "ab" * 4000, "one the and " * 10]
    want = language.label(model, texts)
    monkeypatch.setattr(language, "ROUND_CHARS", 700)
    got = language.label(model, texts)
    assert [g[0] for g in got] == [w[0] for w in want] and got[0][2] == want[0][2] and got[3] == want[3]


SCHEMA = "doc_id long, text string, lang string, spans string, score string, held_out string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)


def test_odd_rows(spark):
    data = [(k, "hello there my friend", "en") for k in range(6)] + [(k, "привет мой друг", "ru") for k in range(6, 12)]
    data += [(20, None, "en"), (21, "", None), (22, "123 ... !!", "en"), (None, "hello", None), (23, "привет", "en"), (23, "привет", "en"), (24, "καλημέρα", None), (25, "hello there my friend мой друг привет мой друг привет", None)]
    got = language.identify(rows(spark, data)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(data) and [by[k][0].lang_pred for k in (0, 6, 20, 21, 22, None, 23)] == ["en", "ru", "und", "und", "und", "en", "ru"]
    assert by[20][0].score == 0 and by[20][0].spans == [] and by[23][0] == by[23][1]
    # no language uses the script: the first in the alphabet, without confidence
    assert by[24][0].lang_pred == "en" and by[24][0].score == pytest.approx(0.5)
    assert [(s.start, s.end, s.lang) for s in by[25][0].spans] == [(0, 21, "en"), (22, 53, "ru")]


def test_nothing_to_learn(spark):
    assert language.identify(rows(spark, [])).count() == 0
    got = language.identify(rows(spark, [(1, "hello", None), (2, None, "en"), (3, "...", "en")])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    alone = language.identify(rows(spark, [(k, "hello", "en") for k in range(4)] + [(9, "abc", None)])).collect()
    assert {r.lang_pred for r in alone} == {"en"} and all(r.score == 1 for r in alone)


def test_tasks_hand_on_their_tables(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" abc")).alias("text"), (F.col("id") % 7).cast("string").alias("lang"))
    want = language.fit(docs)
    monkeypatch.setattr(language, "COUNTED", 1)
    got = language.fit(docs)
    assert got.langs == want.langs and np.array_equal(got.scores, want.scores)
