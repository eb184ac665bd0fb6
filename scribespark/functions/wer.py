"""Word error rates and edit counts, in Arrow batches.

Pairs of at most SHORT_WORDS words a text are counted many at a time (``batches``), longer ones each by itself (``long_text``), with equal results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribespark.functions.batches import BLANKS, TABLE_WORDS
from scribespark.functions.long_text import beyond_in_arrow, distance_in_arrow, edits_in_arrow, rates_in_arrow

#: Most words of a text that is counted with others.
SHORT_WORDS = TABLE_WORDS
#: Label of each method.
METHODS = {"basic": "Basic WER", "ignore_punctuation": "Ignore punctuation", "normalized": "Lower case, no punctuation"}


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two arrays of words. Not inside lambdas, as it leaves the JVM."""
    return distance_in_arrow(SHORT_WORDS)(reference, hypothesis)


def missing(text: Column | str) -> Column:
    """Null, blank or the literal nan."""
    return F.coalesce(F.btrim(text, F.lit(BLANKS)).isin("", "nan"), F.lit(True))


def wer(reference: Column | str, hypothesis: Column | str, method: str = "basic", beyond: float | None = None) -> Column:
    """Distance in words over reference words; may exceed 1. With ``beyond``, null too unless the hypothesis has more than that many times the words.

    Null if either text is missing, or if cleaning leaves no word of the reference; a hypothesis
    that cleaning empties is all deletions.
    """
    reference, hypothesis = (F.col(x) if isinstance(x, str) else x for x in (reference, hypothesis))
    rate = rates_in_arrow(SHORT_WORDS, (method,))(reference, hypothesis)[method] if beyond is None else beyond_in_arrow(SHORT_WORDS, method, beyond)(reference, hypothesis)
    return F.when(~missing(reference) & ~missing(hypothesis), rate)


def wers(reference: Column | str, hypothesis: Column | str, methods: tuple[str, ...] = tuple(METHODS)) -> Column:
    """struct of ``wer`` by each method, texts read once; null if either text is missing."""
    reference, hypothesis = (F.col(x) if isinstance(x, str) else x for x in (reference, hypothesis))
    return F.when(~missing(reference) & ~missing(hypothesis), rates_in_arrow(SHORT_WORDS, methods)(reference, hypothesis))


def edits(reference: Column, hypothesis: Column, texts: bool = False) -> Column:
    """struct(cost, s, d, i, n) of two arrays of words, or of the words of two texts; n: words of the reference.

    Of equal costs a hit or substitution is preferred to a deletion, a deletion to an insertion.
    """
    return edits_in_arrow(SHORT_WORDS, texts)(reference, hypothesis)


def percent_label(share: Column) -> Column:
    """9.1% or N/A; halves of the binary number go to the even digit, as in most languages' own formats."""
    return F.coalesce(F.concat(F.call_function("format_number", share * 100, F.lit("0.0")), F.lit("%")), F.lit("N/A"))


def quality_band(percent: Column, bands: tuple[int, int, int] = (15, 25, 35)) -> Column:
    good, fair, poor = bands
    return F.when(percent < good, "excellent").when(percent < fair, "good").when(percent < poor, "fair").otherwise("poor")
