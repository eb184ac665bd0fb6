"""Paths, languages, model names and samples of sound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names and their codes; model columns and the models behind them.
LANGUAGES = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt", "chinese": "zh", "japanese": "ja", "korean": "ko", "russian": "ru", "arabic": "ar", "hindi": "hi"}
MODEL_NAMES = {"whisper_tiny": "tiny", "whisper_base": "base", "whisper_small": "small", "whisper_medium": "medium", "whisper_large": "large", "whisper_turbo": "large-v3", "tiny_rep1": "tiny", "tiny_rep2": "tiny", "tiny_rep3": "tiny", "tiny_rep4": "tiny", "tiny_rep5": "tiny"}
AUDIO_EXTENSIONS = (".wav", ".mp3", ".m4a", ".flac", ".ogg")


def _looked_up(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


def language_code(language: Column) -> Column:
    """Two letters stay, known names are coded, others are lower-cased; null for null and empty."""
    low = F.trim(F.lower(language))
    return F.when(language != "", F.when(F.length(low) == 2, low).otherwise(F.coalesce(_looked_up(LANGUAGES, low), low)))


def model_name(column: Column, default: str = "base") -> Column:
    return F.coalesce(_looked_up(MODEL_NAMES, column), F.lit(default))


def id_from_path(split: Column, path: Column, skip: int = 13) -> Column:
    """split_rest: the path without its first ``skip`` characters."""
    return F.concat(split, F.lit("_"), F.substring(path, F.lit(skip + 1), F.length(path)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolved(path: Column, base: str) -> Column:
    """A relative path below ``base``; an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def pcm16(samples: Column) -> Column:
    """Samples clipped to -1..1 as 16-bit integers, cut towards zero."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def interleaved(channels: list[Column]) -> Column:
    """One array of frames from an array a channel."""
    names = [f"c{i}" for i in range(len(channels))]
    frames = F.arrays_zip(*(c.alias(n) for c, n in zip(channels, names)))
    return F.flatten(F.transform(frames, lambda x: F.array(*(x[n] for n in names))))


