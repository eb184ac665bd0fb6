"""Operator 7: quality rules as voters that may abstain, weighed by expectation-maximisation.

Each document's figures and votes come from one pass over its whole text. How often each pattern of
votes occurs is counted over all documents (at most 3 ** len(RULES) rows); from that histogram EM
estimates the rules' accuracies, and a document stays if its posterior probability of being good is
at least ``least``, instead of having to pass every rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribespark.llm import weak
from scribespark.llm.shared import written

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_letters")
#: Fewer words fail, as do texts of which more than half repeats.
MIN_WORDS, MAX_REPEAT = 50, 0.5


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more; distinct words."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    n, v = len(ids), len(index)
    if n < 4:
        return 0, v
    if v < 2_000_000:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum()), v


def figures_of(text: bytes) -> tuple[int, ...]:
    """The FIGURES of a text in UTF-8. Words are split as bytes.split does: at blanks and \\t to \\r."""
    words = text.split()
    count = lambda chars: len(text) - len(text.translate(None, chars))
    points = len(text.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    n_lines = n_dup = n_ended = 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
            n_ended += bare[-1] in b".!?:;\"')"
    repeat, distinct = repeated_words(words)
    others = count(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    chars = points - count(b" \t\n\v\f\r")
    return len(words), chars, count(b"#*$%&|<>"), n_dup, repeat, n_lines, n_ended, distinct, chars - others


def with_figures(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of docs as c0, c1 ... and FIGURES, each whole text read once."""
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [figures_of((x.as_py() or "").encode("utf-8", "replace")) for x in batch.column(at)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *FIGURES])

    text = [F.col(c).cast("string") if i == at else F.col(c) for i, c in enumerate(_names(docs))]
    rows = docs.toDF(*_names(docs)).select(*(x.alias(c) for x, c in zip(text, _names(docs))))
    return rows.mapInArrow(add, T.StructType([*rows.schema, *(T.StructField(x, T.LongType()) for x in FIGURES)]))


def _names(docs: DataFrame) -> list[str]:
    return [f"c{i}" for i in range(len(docs.columns))]


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def _of(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """The voters by name, over FIGURES; most can only object. Ratios of an empty text are 0."""
    few, no = F.col("n_words") < MIN_WORDS, F.lit(False)
    symbols, dup, repeat = _of("n_symbols", "n_words"), _of("n_dup_lines", "n_lines"), _of("n_repeat_words", "n_words")
    length, ended = _of("word_chars", "n_words"), _of("n_ended_lines", "n_lines")
    distinct, letters = _of("n_distinct_words", "n_words"), _of("n_letters", "word_chars")
    return {
        "length": _vote(few, F.col("n_words") >= 100),
        "word_length": _vote((length < 2.5) | (length > 12), no),
        "symbols": _vote(symbols > 0.2, symbols < 0.02),
        "dup_lines": _vote(dup > 0.3, no),
        "repeats": _vote(repeat > 0.3, no),
        "line_ends": _vote(ended < 0.3, (ended > 0.8) & (F.col("n_lines") > 2)),
        "variety": _vote((distinct < 0.08) & ~few, no),
        "letters": _vote(letters < 0.8, letters > 0.93),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT * F.col("n_words"))


def _pattern() -> Column:
    return F.array(*rules().values())


def posteriors(rows: DataFrame) -> DataFrame:
    """votes, posterior: a row for each pattern in ``rows.votes``; at most 3 ** len(rules())."""
    counts = {tuple(r[0]): r[1] for r in rows.groupBy("votes").count().collect()}
    model = weak.estimate(counts, len(rules()))
    found = [(list(v), model.posterior(v)) for v in counts]
    return rows.sparkSession.createDataFrame(found, "votes array<int>, posterior double")


def judge(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, FIGURES, votes, posterior, base_failed and kept of each document.

    Null texts have no words; repeated rows are judged each; extra columns are left out; an empty
    table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = with_figures(narrow, "text").withColumnRenamed("c0", "doc_id").drop("c1")
    rows = written(rows.withColumn("votes", _pattern()), "votes")
    judged = rows.join(F.broadcast(posteriors(rows)), "votes")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep_good(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; the rules are those of ``judge``.

    The documents are written once with their votes, so that each text is read by the rules once.
    """
    figured = with_figures(docs, text_col)
    rows = written(figured.select(*_names(docs), _pattern().alias("votes"), base_failed().alias("failed")), "voted")
    good = rows.where("not failed").join(F.broadcast(posteriors(rows)), "votes").where(F.col("posterior") >= least)
    return good.select(*(F.col(c).cast(docs.schema[i].dataType).alias(docs.columns[i]) for i, c in enumerate(_names(docs))))
