"""Many pairs at a time against a pair at a time, and transcripts that no interpreted expression works out."""

import difflib
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scribespark.functions import batches, hallucination, long_text, wer
from scribespark.operators import align
from scribespark.plans.fixtures import asr_long, asr_wide
from tests.test_wer import distance, edit_table
from tests.test_whole_text import lag_repetition


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    blank = lambda words: rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", " "])
    some = [tuple(blank(rng.choices("abcdef", k=rng.randint(0, most))) for most in (40, 70)) for _ in range(1500)]
    return some + [(a, a) for a, _ in some[:50]] + [(None, "a"), ("a", None), ("é e f a", "e f a"), ("", "")]


def test_pairs_of_a_batch(texts):
    ref, hyp = (pa.array(x, pa.string()) for x in zip(*texts))
    codes, ((of_a, n), (of_b, m)), _ = batches.of_texts(ref, hyp)
    words = [tuple(long_text.batches.words_of(pa.array([x], pa.string()))[0].to_pylist() for x in pair) for pair in texts]
    seen = 0
    for k in batches.parts(n, 64, m):
        a, b = batches.table(codes, of_a, k, n[k], -1), batches.table(codes, of_b, k, m[k], -2)
        costs, counts, found = batches.distances(a, n[k], b, m[k]), batches.edits(a, n[k], b, m[k]), batches.repetitions(b, m[k], 2, 3)
        for at, i in enumerate(k.tolist()):
            r, h = words[i]
            assert costs[at] == distance(r, h) and tuple(counts[:, at]) == edit_table(r, h)
            assert (tuple(found[:, at]) if found[0, at] >= 0 else None) == lag_repetition(h, 2, 3)
            seen += 1
    assert 1000 < seen < len(texts)


def test_opcodes_of_a_batch(spark, texts):
    rows = [(i, a, b) for i, (a, b) in enumerate(texts)]
    got = align.opcodes(spark.createDataFrame(rows, "id int, reference string, hypothesis string"), "id").collect()
    of = {i: [] for i, _, _ in rows}
    for r in got:
        of[r.id].append((r.tag, r.i1, r.i2, r.j1, r.j2))
    for i, a, b in rows:
        assert of[i] == difflib.SequenceMatcher(None, (a or "").split(), (b or "").split(), autojunk=False).get_opcodes()


def test_blocks_of_characters():
    cases = ["xabcdeabcdey", "abcdeabcde", " abcdeabcde ", "aaaaa", "aaaaabbbbb", None, "", "éàüößéàüößx", "12345", "6789a12345x", "\U0001f600bcde\U0001f600bcde.", "abcde\nabcde\nz"]
    want = [next((s[k : k + 5] for k in range(len(s) - 10) if s[k : k + 5] == s[k + 5 : k + 10]), "") for s in ((x or "").strip() for x in cases)]
    assert batches.block_repeats(pa.array(cases), 5) == want and "abcde" in want


def test_stutters():
    rng = random.Random(5)
    cases = [" ".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(500)] + [None, "", "go go go", "a\tgo go\ngo go b", "x x", "x"]
    for least in (2, 3):
        words, runs = batches.stutters(pa.array(cases), least)
        for case, word, run in zip(cases, words, runs.tolist()):
            groups = [(w, len(list(g))) for w, g in itertools.groupby((case or "").split())]
            assert (word, run) == next(((w, n) for w, n in groups if n >= least), ("", 0))


def test_nothing_is_interpreted_a_pair(spark):
    """The plans before had lambdas over words, and a shuffle for the wide table."""
    rows = asr_long(spark, "/root/testdata/sf0.001")
    scored = rows.select(wer.wer("reference", "hypothesis"), hallucination.repetition(F.col("hypothesis")), hallucination.length_anomaly(F.col("hypothesis"), F.col("reference")))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "aggregate(" not in plan
    wide = asr_wide(spark, "/root/testdata/sf0.001").drop("split")
    assert "Aggregate" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_plain_pairs_take_no_table(monkeypatch):
    """Words left out, added or replaced, short and long: counted without a table of costs, with the same counts."""

    def forbidden(*_):
        raise AssertionError("a table of costs")

    rng = random.Random(9)
    pairs = []
    for size in (5, 30, 200):
        words = [rng.choice("abcdefgh") for _ in range(size)]
        fewer = [w for k, w in enumerate(words) if k % 3]
        pairs += [(words, fewer), (fewer, words), (words, words[:4] + words), (words, [w.upper() if w in "ab" else w for w in words]), (words, []), ([], words), (words, words)]
    texts = [pa.array([" ".join(pair[k]) for pair in pairs]) for k in (0, 1)]
    codes, (a, b), _ = batches.of_texts(*texts)
    got = long_text._in_tables(codes, a, b, 64, a[1] >= 0, forbidden, forbidden)
    assert [tuple(x) for x in got.T.tolist()] == [edit_table(*pair) for pair in pairs]


def test_pairs_of_all_kinds():
    """Common ends, words left out, added and replaced mixed, around the limit of tables, against the whole table."""
    rng = random.Random(10)
    pairs = []
    for _ in range(400):
        ref = rng.choices("abcd" if rng.random() < 0.5 else "abcdefghijklmnop", k=rng.randint(0, 24))
        hyp = [x.upper() if rng.random() < 0.1 else x for x in ref if rng.random() > rng.choice([0, 0.3])]
        if rng.random() < 0.5:
            hyp.insert(rng.randint(0, len(hyp)), "x")
            hyp = rng.choices("ab", k=rng.randint(0, 2)) + hyp
        pairs.append((ref, hyp))
    codes, (a, b), _ = batches.of_texts(*(pa.array([" ".join(pair[k]) for pair in pairs]) for k in (0, 1)))
    want = [edit_table(*pair) for pair in pairs]
    for limit in (0, 10, 64):
        counts = long_text._in_tables(codes, a, b, limit, a[1] >= 0, batches.edits, long_text.edit_counts)
        assert [tuple(x) for x in counts.T.tolist()] == want
        costs = long_text._in_tables(codes, a, b, limit, a[1] >= 0, batches.distances, long_text.distance).sum(axis=0)
        assert costs.tolist() == [sum(x) for x in want]


def test_repetitions_of_many_long_texts(monkeypatch):
    """Lags of many texts at a time against a lag at a time, whatever fits in a part."""
    rng = random.Random(13)
    cases = []
    for _ in range(150):
        w = rng.choices("abc"[: rng.randint(1, 3)] if rng.random() < 0.5 else "abcdefghijklm", k=rng.randint(0, 90))
        if rng.random() < 0.5:
            w += rng.choices("xyzuvw", k=rng.randint(3, 20)) * rng.randint(1, 4) + list("pq")
        cases.append(w)
    found = batches.read(pa.array([" ".join(w) for w in cases]))
    starts, sizes = found.of(0)
    for anchors in (7, 500_000):
        monkeypatch.setattr(long_text, "ANCHORS", anchors)
        for least, times in ((1, 2), (3, 2), (2, 3), (5, 4)):
            got = long_text.repetitions(found.codes, starts, sizes, least, times)
            assert [tuple(x) if x[0] >= 0 else None for x in got.T.tolist()] == [lag_repetition(w, least, times) for w in cases]


def test_words_are_cleaned_once(spark):
    """Rates by all methods come from one step that reads both texts once, and no expression cleans a text."""
    rows = [("Don't STOP, now.", "dont stop now"), ("... a", "b"), ("É Σας! $5", "é σας 5"), ("a - b", "a b"), ("...", "a")]
    df = spark.createDataFrame(rows, "reference string, hypothesis string")
    scored = df.select(wer.wers("reference", "hypothesis").alias("w")).select("w.*")
    assert [tuple(r) for r in scored.collect()] == [(1.0, pytest.approx(2 / 3), 0.0), (1.0, 1.0, 1.0), (1.0, pytest.approx(2 / 3), pytest.approx(1 / 3)), (pytest.approx(1 / 3), 0.0, 0.0), (1.0, None, None)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("run(reference") == 1


def test_flags_read_texts_once(spark):
    df = spark.createDataFrame([("a b c", "a b c a b c")], "reference string, hypothesis string")
    plan = df.select(hallucination.hallucinations(F.col("hypothesis"), F.col("reference")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "word_count" not in plan


def test_blocks_of_wide_characters():
    rng = random.Random(14)
    cases = ["".join(rng.choices("aé€\U0001f600", k=rng.randint(0, 40))) for _ in range(600)]
    want = [next((s[k : k + 2] for k in range(len(s) - 4) if s[k : k + 2] == s[k + 2 : k + 4]), "") for s in cases]
    assert batches.block_repeats(pa.array(cases), 2) == want and batches.block_repeats(pa.array(cases)[3:], 2) == want[3:]
