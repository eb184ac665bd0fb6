"""Transcripts of whole documents and of all their utterances, against plain Python."""

import difflib
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scribespark.functions import hallucination as hall
from scribespark.functions import long_text, text, wer
from scribespark.operators import align
from scribespark.plans.fixtures import asr_documents, asr_long
from scribespark.queries import QUERIES
from scribespark.queries.flags import flags
from tests.test_wer import distance, edit_table, find_repetition


def _write(folder, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def long_docs(tmp_path_factory):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["The", "end."]
    texts = [" ".join(rng.choices(words, k=n)) for n in (21, 65, 130, 400, 900, 20)]
    # a phrase, a stutter and a block of characters that come back only after word 20
    texts.append(" ".join(f"u{i}" for i in range(60)) + " a b c a b c a b c so so so xyxyzxyxyz end")
    return texts, _write(tmp_path_factory.mktemp("long"), texts)


def _expected(i, words):
    heard = {
        "tiny": [w for k, w in enumerate(words, 1) if k % 3],
        "base": [w for k, w in enumerate(words, 1) if k % 5],
        "small": [w.lower() for w in words],
        "medium": words[:4] + words,
        "large": words,
        "turbo": words[:1] + words[:1] + words,
    }
    return {m: None if m == "tiny" and i % 11 == 0 else "" if m == "base" and i % 13 == 0 else " ".join(h) for m, h in heard.items()}


def test_transcripts_are_whole(spark, long_docs):
    texts, folder = long_docs
    got = {(r.doc_id, r.model): (r.reference, r.hypothesis) for r in asr_documents(spark, folder).collect()}
    assert got == {(i, m): (t, h) for i, t in enumerate(texts) for m, h in _expected(i, t.split()).items()}
    got = {(r.doc_id, r.utterance, r.model): (r.reference, r.hypothesis) for r in asr_long(spark, folder).collect()}
    cut = {(i, k // 20): t.split()[k : k + 20] for i, t in enumerate(texts) for k in range(0, len(t.split()), 20)}
    assert got == {(i, k, m): (" ".join(w), h) for (i, k), w in cut.items() for m, h in _expected(i, w).items()}


def test_rates_and_detectors_of_whole_texts(spark, long_docs):
    texts, folder = long_docs
    rates = {(r.doc_id, r.model): r for r in QUERIES["wer_documents"](spark, folder).collect()}
    found = {(r.doc_id, r.model): r.info for r in asr_documents(spark, folder).select("doc_id", "model", hall.repetition(F.col("hypothesis"))["info"].alias("info")).collect()}
    for i, t in enumerate(texts):
        ref = t.split()
        for m, h in _expected(i, ref).items():
            hyp, r = (h or "").split(), rates[i, m]
            d = distance(ref, hyp)
            assert r.wer == (pytest.approx(d / len(ref), abs=1e-6) if hyp else None)
            assert (r.substitutions, r.deletions, r.insertions) == (edit_table(ref, hyp) if hyp else (None, None, None))
            assert found[i, m] == find_repetition(hyp)


def plain_flags(ref, hyp):
    """The five detectors and their text in plain Python."""
    said, words, n = (hyp or "").strip(), (hyp or "").split(), len(ref.split())
    info = []
    repeated = find_repetition(words)
    if repeated:
        info.append(f"Repetition: {repeated}")
    ratio = len(words) / n if words and n else None
    odd = ratio is not None and not 0.5 <= ratio <= 2.0
    if odd:
        info.append(f"Length: Too {'short' if ratio < 0.5 else 'long'}: {len(words)} words vs {n} words (ratio: {ratio:.2f})")
    block = next((said[i : i + 5] for i in range(len(said) - 10) if said[i : i + 5] == said[i + 5 : i + 10]), "")
    if block:
        info.append(f"Char rep: Character repetition: '{block}' repeated")
    rate = distance(ref.split(), words) / n if words and n else None
    inserted = rate is not None and rate > 0.8 and ratio > 1.5
    if inserted:
        info.append(f"Insertions: High WER ({rate:.2f}) with {ratio:.1f}x word count suggests insertions")
    again = next((w for w, x, y in zip(words, words[1:], words[2:]) if w == x == y), None)
    if again is not None:
        info.append(f"Stuttering: Word stuttering: '{again}' repeated 3 times")
    each = (bool(repeated), odd, bool(block), inserted, again is not None)
    return any(each), *each, "; ".join(info)


def test_all_flags_of_whole_texts(spark, long_docs, tmp_path):
    texts, folder = long_docs
    names = ("has_hallucination", "repetition", "length_anomaly", "char_repetition", "insertions", "stuttering", "info")
    got = {(r.doc_id, r.model): tuple(r[c] for c in names) for r in QUERIES["hallucination_documents"](spark, folder).collect()}
    want = {(i, m): plain_flags(t, h) for i, t in enumerate(texts) for m, h in _expected(i, t.split()).items()}
    assert got == want and {w[k] for w in want.values() for k in (1, 3, 5)} == {True, False}
    # pairs that the models don't make: far too long or short, and inserted words
    rng = random.Random(11)
    pairs = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 120))), " ".join(rng.choices(["a", "b", "zz", "abcdeabcde"], k=rng.randint(0, 300)))) for k in range(120)]
    df = spark.createDataFrame([(k, "s", "m", r, h) for k, r, h in pairs], "doc_id long, split string, model string, reference string, hypothesis string")
    got = {r.doc_id: tuple(r[c] for c in names) for r in flags(df, "doc_id").collect()}
    want = {k: plain_flags(r, h) for k, r, h in pairs}
    assert got == want and all(any(w[k] for w in want.values()) for k in range(1, 6))


def lag_repetition(w, min_length, min_repeats):
    """A lag at a time: the least with a run long enough, the leftmost such run, and how often its phrase stands there."""
    for lag in range(max(1, min_length), len(w) // min_repeats + 1):
        run, found = 0, None
        for k in range(len(w) - lag - 1, -2, -1):
            if k >= 0 and w[k] == w[k + lag]:
                run += 1
                continue
            if run >= lag * (min_repeats - 1):
                found = lag, k + 1, 1 + run // lag
            run = 0
        if found:
            return found
    return None


def test_repetitions_by_anchors(monkeypatch):
    rng = random.Random(4)
    for anchors in (7, 500_000):
        monkeypatch.setattr(long_text, "ANCHORS", anchors)
        for _ in range(300):
            w = rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(0, 60))
            if rng.random() < 0.5:
                w += rng.choices("xyzuvw", k=rng.randint(3, 20)) * rng.randint(1, 4) + list("pq")
            for least, times in ((1, 2), (3, 2), (2, 3), (5, 4)):
                assert long_text.repetition(w, least, times) == lag_repetition(w, least, times)


def test_long_texts_take_seconds():
    """200,000 words: none repeated, one long phrase twice, two words only; and the edits of a pair of 20,000."""
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 20_000)}" for _ in range(200_000)]
    began = time.monotonic()
    assert long_text.repetition(words, 3, 2) is None
    phrase = [f"p{i}" for i in range(70_000)]
    assert long_text.repetition(words[:50_000] + phrase * 2 + words[50_000:60_000], 3, 2) == (70_000, 50_000, 2)
    assert time.monotonic() - began < 20
    began = time.monotonic()
    ref = words[:20_000]
    hyp = [w for k, w in enumerate(ref) if k % 3] + ["x"] * 500
    s, d, i = long_text.edit_counts(ref, hyp)
    assert time.monotonic() - began < 5
    assert s + d + i == long_text.distance(ref, hyp) and d - i == len(ref) - len(hyp)


def test_edit_counts_in_parts(monkeypatch):
    rng = random.Random(12)
    for kept in (1, 300, 64_000_000):
        monkeypatch.setattr(long_text, "KEPT_BYTES", kept)
        for _ in range(60):
            a, b = (rng.choices("abcd", k=rng.randint(0, 40)) for _ in range(2))
            assert long_text.edit_counts(a, b) == edit_table(a, b)


def test_long_forms_equal_short_forms(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, *(" ".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, reference string, hypothesis string").cache()

    def results():
        r, h = text.tokens("reference"), text.tokens("hypothesis")
        out = df.select("id", wer.word_distance(r, h).alias("d"), wer.edits(r, h).alias("e"), hall.repetition(F.col("hypothesis"), 1, 3).alias("p"))
        return sorted(out.collect())

    short = results()
    monkeypatch.setattr(wer, "SHORT_WORDS", 0)
    monkeypatch.setattr(hall, "SHORT_WORDS", 0)
    assert results() == short


def test_more_words_than_characters(spark):
    """36,000 different words: more than there are characters for words below the surrogates."""
    words = [f"w{i}" for i in range(36_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:-3] + ["x", "y"]))], "reference string, hypothesis string")
    assert df.select(wer.wer("reference", "hypothesis").alias("w")).first().w == pytest.approx(3 / 36_000)


def test_opcodes_are_those_of_difflib():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 60)) for _ in range(2))
        assert align._matcher(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
