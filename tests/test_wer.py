"""Word error rates and detectors against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scribespark.functions import hallucination as hall
from scribespark.functions import long_text, text, wer
from scribespark.operators import align, report


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edit_table(a, b):
    """s, d, i along one cheapest path, found backwards: a hit or substitution before a deletion before an insertion."""
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        table.append([i])
        for j, y in enumerate(b, 1):
            table[i].append(min(table[i - 1][j - 1] + (x != y), table[i - 1][j] + 1, table[i][j - 1] + 1))
    s = d = k = 0
    i, j = len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            s += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d + i, k + j


@pytest.fixture(scope="module")
def pairs(spark):
    random.seed(3)
    words = ["a", "b", "c", "d.", "E,", "go"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 9))), " ".join(random.choices(words, k=random.randint(0, 14)))) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id int, reference string, hypothesis string").cache()


def test_wer_and_edits(pairs):
    rows, df = pairs
    e = wer.edits(text.tokens("reference"), text.tokens("hypothesis"))
    got = {r.id: r for r in df.select("id", wer.wer("reference", "hypothesis").alias("w"), e.alias("e")).collect()}
    for i, ref, hyp in rows:
        d = distance(ref.split(), hyp.split())
        assert got[i].w == (pytest.approx(d / len(ref.split())) if hyp.strip() else None)
        assert got[i].e.cost == d == got[i].e.s + got[i].e.d + got[i].e.i
        assert long_text.edit_counts(ref.split(), hyp.split()) == (got[i].e.s, got[i].e.d, got[i].e.i) == edit_table(ref.split(), hyp.split())


def test_missing_texts(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("", "a"), ("nan", "a"), ("...", "a b"), ("a", "..."), ("a b", "a b c d e f")], "reference string, hypothesis string")
    got = [tuple(r) for r in df.select(*(wer.wer("reference", "hypothesis", m) for m in wer.METHODS)).collect()]
    assert got[:4] == [(None, None, None)] * 4
    assert got[4][1:] == (None, None) and got[5] == (1.0, 1.0, 1.0) and got[6][0] == 2.0


def find_repetition(w):
    for n in range(3, len(w) // 2 + 1):
        for i in range(len(w) - 2 * n + 1):
            k = 1
            while w[i + n * k : i + n * k + n] == w[i : i + n]:
                k += 1
            if k >= 2:
                return f"Repeated phrase '{' '.join(w[i : i + n])}' {k} times"
    return ""


def test_detectors(pairs):
    rows, df = pairs
    h = hall.hallucinations(F.col("hypothesis"), F.col("reference"))
    got = {r.id: r.h for r in df.select("id", h.alias("h")).collect()}
    for i, ref, hyp in rows:
        w, s = hyp.split(), hyp.strip()
        assert got[i].repetition.info == find_repetition(w)
        assert got[i].stuttering.detected == any(w[k] == w[k + 1] == w[k + 2] for k in range(len(w) - 2))
        assert got[i].char_repetition.detected == any(s[k : k + 5] == s[k + 5 : k + 10] for k in range(len(s) - 10))
        ratio = len(w) / len(ref.split())
        assert got[i].length_anomaly.type == (None if not w or 0.5 <= ratio <= 2 else "too_short" if ratio < 0.5 else "too_long")


def test_detector_edges(spark):
    cases = ["a b c a b c", "go go go", "abcdeabcde", "abcdeabcdeX", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, hypothesis string")
    x = F.col("hypothesis")
    got = df.select("i", hall.repetition(x).alias("r"), hall.stuttering(x).alias("s"), hall.character_repetition(x).alias("c")).orderBy("i").collect()
    assert [(r.r.detected, r.s.detected, r.c.detected) for r in got] == [(True, False, False), (False, True, False), (False, False, False), (False, False, True), (False, False, False), (False, False, False)]
    assert got[0].r["count"] == 2 and got[1].s.run == 3


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("m", 2.0)] * 4, "model string, wer double")
    row = report.histogram(df).collect()
    assert len(row) == 1 and row[0].in_bin == 4 and row[0].density == pytest.approx(15.0)


def test_diff(spark):
    df = spark.createDataFrame([(1, "the cat sat down", "the bat sat"), (2, "a , b", "a c")], "id int, reference string, hypothesis string")
    tags = [(r.tag, r.i1, r.i2) for r in align.opcodes(df.where("id = 1"), "id").collect()]
    assert tags == [("equal", 0, 1), ("replace", 1, 2), ("equal", 2, 3), ("delete", 3, 4)]
    # a token of punctuation only keeps its place among the original words
    cleaned = [(r.tag, r.i1, r.i2) for r in align.opcodes(df.where("id = 2"), "id", ignore_punctuation=True).collect()]
    assert cleaned[0] == ("equal", 0, 2) and cleaned[1] == ("replace", 2, 3)


def test_percentages_as_text(spark):
    """As a format of the binary number writes them: 9.1%, halves to the even digit, N/A for none."""
    rates = [k / n for n in (1, 3, 7, 8, 16, 20, 400, 2000, 20_000) for k in range(0, 3 * n, max(1, n // 37))]
    df = spark.createDataFrame([(r,) for r in [*rates, None]], "r double")
    assert [r.x for r in df.select(wer.percent_label(F.col("r")).alias("x")).collect()] == [f"{r * 100:.1f}%" for r in rates] + ["N/A"]
