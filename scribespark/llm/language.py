"""Operator 11: the language of a text, and the spans of a text in several languages.

Words are runs of letters of one script. A word's script narrows the languages it may be in to those that
use the script; each of them scores the word by its letter trigrams, against the mean of all languages. A
document's labels are the best path through its words, where going from one language to another costs
``SWITCH``. Where no stretch of words gains that much over the best single language, that is the best
path; the other documents' paths are found by Viterbi's recursion, a word of all of them at a time.

The model counts all labelled documents: a task counts into a table of fixed size for each language, Spark adds
the tables up. It has ``BUCKETS`` numbers a language, however large the corpus is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of trigrams.
BUCKETS = 1 << 17
#: Cost of a change of language between two words, in units of the words' scores.
SWITCH = 8.0
#: Weight of a trigram's log-probability: neighbouring trigrams share letters.
WEIGHT = 0.5
#: Share of the mean of all languages in each language's probabilities.
SHARED = 0.02
#: A language uses a script if it has at least this share of its letters.
LEAST_SHARE = 0.002
#: What a word costs a language that does not use its script.
FOREIGN = -50.0
#: Letters of a word in scripts that are written without blanks.
UNSPACED = 4
#: Characters of text worked on at a time.
ROUND_CHARS = 1_000_000
#: Languages counted in a task before it hands its tables on.
COUNTED = 64

#: Unicode blocks by script, each with the first and last code point of its blocks.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Odia": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F), (0xAA60, 0xAA7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_WITHOUT_BLANKS = ("Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Kana", "Han")
#: Numbers of scripts: 0 is outside words, 1 any other script, LAST a mark that goes with any.
_NUMBER = {name: k for k, name in enumerate(SCRIPTS, 2)}
_OTHER, _MARK = 1, len(SCRIPTS) + 2
_ENDS = re.compile(r"\s")

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower case (0 outside words), the number of its script, whether it is a letter."""
    if not _tables:
        folded, script, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
        for k in range(0x110000):
            kind = unicodedata.category(chr(k))[0]
            if kind in "LM":
                low = chr(k).lower()
                folded[k], letter[k] = ord(low) if len(low) == 1 else k, kind == "L"
                script[k] = _OTHER if kind == "L" else _MARK
        for name, blocks in SCRIPTS.items():
            for first, last in blocks:
                script[first : last + 1][script[first : last + 1] > 0] = _NUMBER[name]
        _tables.extend((folded, script, letter))
    return tuple(_tables)


@dataclass
class Words:
    """Words of some texts, in order: the text, first and last code point (exclusive), letters, script; trigrams and where words' trigrams start."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    folded, scripts, is_letter = tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace") + b"\n\0\0\0", np.uint32)
    low, script = folded[codes], scripts[codes]
    before, after = np.concatenate([[np.uint32(0)], low[:-1]]), np.concatenate([low[1:], [np.uint32(0)]])
    last = np.concatenate([[np.uint8(0)], script[:-1]])
    begins = (script != last) & (script != _MARK) & (last != _MARK) | (last == 0)
    at = np.flatnonzero(low)
    begins = begins[at]
    unspaced = np.isin(script[at], [_NUMBER[x] for x in _WITHOUT_BLANKS])
    if unspaced.any():
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        begins |= unspaced & (place % UNSPACED == 0)
    first = np.flatnonzero(begins)
    hashed = low * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 17)
    text_start = np.cumsum([0] + [len(t) + 1 for t in texts])
    start = at[first]
    end = at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else start
    text = np.searchsorted(text_start, start, side="right") - 1
    base = text_start[text]
    letters = np.add.reduceat(is_letter[codes[at]].astype(np.int64), first) if len(first) else first
    return Words(text, start - base, end - base, letters, np.minimum(script[start], _MARK), hashed[at].astype(np.int64), first)


class Counts:
    """Trigrams and letters by script of each language in a task."""

    def __init__(self):
        self.of: dict[str, np.ndarray] = {}

    def add(self, lang: str, texts: list[str]) -> None:
        words = words_of(texts)
        total = self.of.setdefault(lang, np.zeros(BUCKETS + _MARK + 1, np.int64))
        total[:BUCKETS] += np.bincount(words.trigrams, minlength=BUCKETS)
        total[BUCKETS:] += np.bincount(words.script, words.letters, _MARK + 1).astype(np.int64)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, total in self.of.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "feature", "n"])
        self.of.clear()


class Model:
    """Scores of trigrams by language and which languages use a script; languages in alphabetical order."""

    def __init__(self, counts: dict[str, np.ndarray]):
        # a language without any letter has nothing to be known by
        self.langs = sorted(k for k, v in counts.items() if v[:BUCKETS].any())
        n = len(self.langs)
        share = np.zeros((n, BUCKETS))
        uses = np.zeros((n, _MARK + 1), bool)
        for k, lang in enumerate(self.langs):
            grams, letters = counts[lang][:BUCKETS], counts[lang][BUCKETS:]
            share[k] = grams / grams.sum()
            uses[k] = letters >= max(1, LEAST_SHARE * letters.sum())
        mean = share.mean(axis=0) if n else np.zeros(BUCKETS)
        seen = mean > 0
        self.scores = np.zeros((n, BUCKETS), np.float32)
        self.scores[:, seen] = WEIGHT * np.log((1 - SHARED) * share[:, seen] / mean[seen] + SHARED)
        self.known = uses.any(axis=0)
        self.foreign = np.where(uses, 0.0, FOREIGN)

    def score(self, words: Words) -> np.ndarray:
        """Words by languages; all alike where no language uses a word's script."""
        out = np.empty((len(words.start), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.scores[k][words.trigrams], words.first) if len(words.first) else 0
            out[:, k] += self.foreign[k][words.script]
        out[~self.known[words.script]] = 0
        return out


def _switches_pay(scores: np.ndarray, best: int, cost: float) -> bool:
    """Whether some stretch of words may gain more than one switch costs over the language ``best``."""
    gain = np.cumsum(scores.max(axis=1) - scores[:, best])
    if gain[-1] <= cost - 1e-6:
        return False  # no word gains less than nothing
    others = np.delete(scores, best, axis=1)
    gain = np.concatenate([[0.0], np.cumsum(others.max(axis=1) - scores[:, best])])
    return bool((gain - np.minimum.accumulate(gain)).max() > cost - 1e-6)


def best_paths(scores: list[np.ndarray], cost: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each document (words by languages): highest sum of scores less ``cost`` for each change.

    A step takes one word of every document that has one, longest documents first.
    """
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    size = np.array([len(scores[d]) for d in order])
    base = np.cumsum(size) - size
    flat = np.concatenate([scores[d] for d in order])
    stay = np.zeros(flat.shape, bool)
    source = np.zeros(len(flat), np.int64)
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(size[0])]  # documents of more than t words
    value = flat[base]
    for t in range(1, size[0]):
        n = active[t]
        rows, now = base[:n] + t, value[:n]
        top = now.max(axis=1, keepdims=True)
        source[rows] = now.argmax(axis=1)
        stay[rows] = now >= top - cost
        value[:n] = flat[rows] + np.maximum(now - top, -cost)
    labels = np.zeros(len(flat), np.int64)
    state = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        rows = base[:n] + t
        labels[rows] = state[:n]
        if t:
            state[:n] = np.where(stay[rows, state[:n]], state[:n], source[rows])
    out: list = [None] * len(scores)
    for place, d in enumerate(order):
        out[d] = labels[base[place] : base[place] + size[place]]
    return out


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Rounds of (text, first code point, piece): long texts are cut at white space, where there is some."""
    round_: list[tuple[int, int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        lo = 0
        while lo < len(text) or not lo:
            hi = lo + ROUND_CHARS
            gap = _ENDS.search(text, hi, hi + 10_000) if hi < len(text) else None
            hi = gap.start() if gap else hi
            round_.append((k, lo, text[lo:hi]))
            size += min(hi, len(text)) - lo
            lo = max(hi, 1)
            if size >= ROUND_CHARS:
                yield round_
                round_, size = [], 0
    if round_:
        yield round_


def label(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text its language, the score and the spans (first code point, last exclusive, language)."""
    found: list[list[tuple]] = [[] for _ in texts]
    for round_ in _pieces(texts):
        words = words_of([p[2] for p in round_])
        scores = model.score(words) if model.langs else np.zeros((len(words.start), 0))
        stop = np.searchsorted(words.text, np.arange(len(round_) + 1))
        for (k, lo, _), a, b in zip(round_, stop[:-1], stop[1:]):
            found[k].append((words.start[a:b] + lo, words.end[a:b] + lo, words.letters[a:b], scores[a:b]))
    whole = [tuple(np.concatenate(x) for x in zip(*f)) if len(f) > 1 else f[0] for f in found]
    paths: list = [None] * len(texts)
    open_ = []
    for k, (_, _, letters, scores) in enumerate(whole):
        if model.langs and letters.sum():
            best = int(scores.sum(axis=0).argmax())
            if len(model.langs) > 1 and _switches_pay(scores, best, SWITCH):
                open_.append(k)
            else:
                paths[k] = best
    if open_:
        for k, path in zip(open_, best_paths([whole[k][3] for k in open_])):
            paths[k] = path
    return [_verdict(model, path, *w) for path, w in zip(paths, whole)]


def _verdict(model: Model, path, start, end, letters, scores) -> tuple[str, float, list[tuple[int, int, str]]]:
    if path is None:
        return "und", 0.0, []
    if isinstance(path, int):
        lang, share, sums = path, 1.0, scores.sum(axis=0)
        spans = [(int(start[0]), int(end[-1]), model.langs[path])]
    else:
        weight = np.bincount(path, letters, len(model.langs))
        lang = int(weight.argmax())
        share, sums = weight[lang] / letters.sum(), scores[path == lang].sum(axis=0)
        new = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        spans = [(int(start[a]), int(end[b - 1]), model.langs[path[a]]) for a, b in zip(new, [*new[1:], len(path)])]
    return model.langs[lang], float(share / np.exp(np.minimum(sums - sums[lang], 700)).sum()), spans


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learned from; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all documents with a text and a language that are not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for round_ in _pieces(texts):
                    counts.add(lang, [p[2] for p in round_])
                if len(counts.of) >= COUNTED:
                    yield from counts.batches()
        yield from counts.batches()

    chosen = docs.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang string, feature int, n long")
    table = rows.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    langs = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else None
    for chunk in ([langs] if table.num_rows else []):
        feature, n, code = (x.to_numpy() for x in (table.column("feature"), table.column("n"), chunk.indices))
        for k, lang in enumerate(chunk.dictionary.to_pylist()):
            counts[lang] = np.zeros(BUCKETS + _MARK + 1, np.int64)
            counts[lang][feature[code == k]] = n[code == k]
    return Model(counts)


_OUT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of each row: the language that most letters of a text are labelled with.

    Learned from ``docs`` unless a model is given. ``lang_pred`` is ``und``, score 0, spans empty where a text is null or has no
    letter, or nothing could be learned. ``score`` is the share of letters labelled so, times the probability of the
    language on them. Spans are code points, end exclusive. Of equally good languages the first in alphabetical order is taken.
    Rows with one id are labelled each, null ids stay null, extra columns are left out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(docs, id_col, text_col, lang_col))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(2).to_pylist()]
            found = label(shared.value, texts)
            spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found], _SPANS)
            cells = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    doc_id = F.col(id_col).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(rows, _OUT)
