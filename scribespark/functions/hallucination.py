"""Hallucination detectors on transcripts, as column expressions.

Texts that are null or blank are never flagged. Each detector gives a struct with ``detected``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribespark.functions.batches import TABLE_WORDS
from scribespark.functions.long_text import block_in_arrow, detected_in_arrow, repetition_in_arrow, stutter_in_arrow, word_count
from scribespark.functions.wer import missing, wer


#: Most words of a text whose repetitions are looked for together with those of others.
SHORT_WORDS = TABLE_WORDS


def repetition(hypothesis: Column, min_length: int = 3, min_repeats: int = 2) -> Column:
    """A phrase of min_length words or more, min_repeats times back to back.

    The text names the shortest such phrase, there the leftmost; ``count``: how often it stands there in a row.
    """
    return _repetition(repetition_in_arrow(SHORT_WORDS, min_length, min_repeats)(hypothesis))


def _repetition(x: Column) -> Column:
    hit = x["start"].isNotNull()
    return F.struct(hit.alias("detected"), F.when(hit, F.concat(F.lit("Repeated phrase '"), x["phrase"], F.lit("' "), x["count"].cast("string"), F.lit(" times"))).otherwise("").alias("info"), F.when(hit, x["count"]).alias("count"))


def _ratio(h: Column, r: Column) -> Column:
    return F.when((h > 0) & (r > 0), h / r)


def length_anomaly(hypothesis: Column, reference: Column, min_ratio: float = 0.5, max_ratio: float = 2.0) -> Column:
    """Too few or too many words against the reference; the bounds themselves are fine."""
    return _length_anomaly(word_count(hypothesis), word_count(reference), min_ratio, max_ratio)


def _length_anomaly(h: Column, r: Column, min_ratio: float, max_ratio: float) -> Column:
    ratio = _ratio(h, r)
    kind = F.when(ratio < min_ratio, "too_short").when(ratio > max_ratio, "too_long")
    name = F.when(ratio < min_ratio, "Too short: ").otherwise("Too long: ")
    info = F.concat(name, h.cast("string"), F.lit(" words vs "), r.cast("string"), F.lit(" words (ratio: "), F.format_string("%.2f", F.bround(ratio, 2)), F.lit(")"))
    return F.struct(kind.isNotNull().alias("detected"), kind.alias("type"), F.when(kind.isNotNull(), info).otherwise("").alias("info"))


def character_repetition(hypothesis: Column, size: int = 5) -> Column:
    """A block of ``size`` characters right after itself; a block that ends the text doesn't count."""
    return _character_repetition(block_in_arrow(size)(hypothesis))


def _character_repetition(block: Column) -> Column:
    info = F.when(block != "", F.concat(F.lit("Character repetition: '"), block, F.lit("' repeated"))).otherwise("")
    return F.struct((block != "").alias("detected"), info.alias("info"))


def insertions(hypothesis: Column, reference: Column, wer_threshold: float = 0.8, word_ratio: float = 1.5, method: str = "basic") -> Column:
    """A high word error rate together with many more words than the reference; only with those the rate is worked out."""
    rate = wer(reference, hypothesis, method, beyond=word_ratio)
    return _insertions(rate, word_count(hypothesis), word_count(reference), wer_threshold, word_ratio)


def _insertions(rate: Column, h: Column, r: Column, wer_threshold: float, word_ratio: float) -> Column:
    ratio = _ratio(h, r)
    hit = F.coalesce((rate > wer_threshold) & (ratio > word_ratio), F.lit(False))
    info = F.concat(F.lit("High WER ("), F.format_string("%.2f", F.bround(rate, 2)), F.lit(") with "), F.format_string("%.1f", F.bround(ratio, 1)), F.lit("x word count suggests insertions"))
    return F.struct(hit.alias("detected"), F.when(hit, info).otherwise("").alias("info"))


def stuttering(hypothesis: Column, min_stutter: int = 3) -> Column:
    """A word min_stutter times in a row; the text names the threshold, ``run`` the true length."""
    return _stuttering(stutter_in_arrow(min_stutter)(hypothesis), min_stutter)


def _stuttering(x: Column, min_stutter: int) -> Column:
    hit = x["word"] != ""
    info = F.concat(F.lit("Word stuttering: '"), x["word"], F.lit(f"' repeated {min_stutter} times"))
    return F.struct(hit.alias("detected"), F.when(hit, info).otherwise("").alias("info"), F.when(hit, x["run"]).alias("run"))


#: Detectors by flag name, in the order of the summary text, with the word that introduces each.
DETECTORS = {"repetition": "Repetition", "length_anomaly": "Length", "char_repetition": "Char rep", "insertions": "Insertions", "stuttering": "Stuttering"}


def hallucinations(hypothesis: Column, reference: Column, check: tuple[str, ...] = tuple(DETECTORS), min_ratio: float = 0.5, max_ratio: float = 2.0, wer_threshold: float = 0.8, min_length: int = 3, min_repeats: int = 2) -> Column:
    """struct of the detectors' structs, both texts read once; those that are not asked for say no."""
    word_ratio, min_stutter = 1.5, 3
    off = F.struct(F.lit(False).alias("detected"), F.lit("").alias("info"))
    x = detected_in_arrow(SHORT_WORDS, tuple(check), min_length, min_repeats, 5, word_ratio, min_stutter)(reference, hypothesis)
    rate = F.when(~missing(reference) & ~missing(hypothesis), x["rate"])
    found = {
        "repetition": _repetition(x),
        "length_anomaly": _length_anomaly(x["said"], x["words"], min_ratio, max_ratio),
        "char_repetition": _character_repetition(x["block"]),
        "insertions": _insertions(rate, x["said"], x["words"], wer_threshold, word_ratio),
        "stuttering": _stuttering(x, min_stutter),
    }
    return F.struct(*((found[k] if k in check else off).alias(k) for k in DETECTORS))


def flagged(flags: str) -> Column:
    """Whether any detector of a ``hallucinations`` struct column says yes."""
    out = F.lit(False)
    for k in DETECTORS:
        out = out | F.col(f"{flags}.{k}.detected")
    return out


def summary_text(flags: str) -> Column:
    """"Repetition: ...; Length: ..." of the detectors that say yes, in fixed order."""
    return F.concat_ws("; ", *(F.when(F.col(f"{flags}.{k}.detected"), F.concat(F.lit(f"{name}: "), F.col(f"{flags}.{k}.info"))) for k, name in DETECTORS.items()))
