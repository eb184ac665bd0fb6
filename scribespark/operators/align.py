"""Word alignments: opcodes of a sequence matcher, and edit counts of long texts, in Arrow batches."""

from __future__ import annotations

import difflib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribespark.functions import batches

OPCODES = "tag string, i1 int, i2 int, j1 int, j2 int"
#: Most pairs of equal words of two texts that are listed at once.
MOST_EQUAL_WORDS = 10_000_000
_PUNCTUATION = str.maketrans("", "", string.punctuation)
#: What a reader sees for each opcode.
CLASSES = {"equal": "Correct", "delete": "Missing", "insert": "Different", "replace": "Different"}


def _cleaned(words: list[str], clean: bool) -> tuple[list[str], list[int]]:
    """Words as they are compared, and where each stands among the original words."""
    if not clean:
        return words, list(range(len(words)))
    kept = [(w.translate(_PUNCTUATION), i) for i, w in enumerate(words)]
    kept = [(w, i) for w, i in kept if w]
    return [w for w, _ in kept], [i for _, i in kept]


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]] | None:
    """The blocks that ``difflib.SequenceMatcher`` finds without its junk rules, in far less time for long texts.

    All runs of equal words are listed once; each part of the texts has those that reach into it, cut to it.
    None if there are too many to list.
    """
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in t], np.int64) for t in (a, b))
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = high - low
    if n.sum() > MOST_EQUAL_WORDS:
        return None
    i = np.repeat(np.arange(len(x)), n)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else np.array([], np.int64)
    i, j, size = i[starts], j[starts], np.diff(np.append(starts, len(i)))
    todo, found = [(i, j, size)], []
    while todo:
        i, j, size = todo.pop()
        if not len(i):
            continue
        best = np.flatnonzero(size == size.max())
        best = best[np.lexsort((j[best], i[best]))[0]]
        p, q, k = int(i[best]), int(j[best]), int(size[best])
        found.append((p, q, k))
        left = np.minimum(size, np.minimum(p - i, q - j))
        late = np.maximum(0, np.maximum(p + k - i, q + k - j))
        todo += [(i[left > 0], j[left > 0], left[left > 0])]
        right = size - late
        todo += [((i + late)[right > 0], (j + late)[right > 0], right[right > 0])]
    out = []
    for p, q, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == p and out[-1][1] + out[-1][2] == q:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((p, q, k))
    return [*out, (len(a), len(b), 0)]


def _matcher(a: list[str], b: list[str]) -> difflib.SequenceMatcher:
    matcher = difflib.SequenceMatcher(None, autojunk=False)
    blocks = matching_blocks(a, b)
    matcher.set_seqs(a, b) if blocks is None else setattr(matcher, "a", a) or setattr(matcher, "b", b)
    matcher.matching_blocks = blocks and [difflib.Match(*x) for x in blocks]
    return matcher


#: Opcodes that are handed on at once.
OPCODES_AT_ONCE = 100_000
_TAGS = pa.array(["equal", "replace", "delete", "insert"])
#: White space of ``str.split`` besides ``batches.BLANKS``.
_OTHER_BLANKS = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _gaps(text: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Opcodes (text, place in _TAGS, i1, i2, j1, j2) of texts of n and m words from their blocks, all texts in order."""
    # a block without words ends each text
    ends = np.arange(len(n))
    text, p, q, size = (np.concatenate(x) for x in ((text, ends), (p, n), (q, m), (size, np.zeros(len(n), np.int64))))
    order = np.argsort(text, kind="stable")
    text, p, q, size = text[order], p[order], q[order], size[order]
    first = np.concatenate([[True], text[1:] != text[:-1]])
    i1, j1 = (np.where(first, 0, np.concatenate([[0], (x + size)[:-1]])) for x in (p, q))
    # neighbours are one block
    joined = ~first & (i1 == p) & (j1 == q) & (size > 0)
    whole = np.cumsum(~joined) - 1
    sizes = np.bincount(whole, size).astype(np.int64)
    text, p, q, i1, j1, size = (*(x[~joined] for x in (text, p, q, i1, j1)), sizes)
    between = np.where((i1 < p) & (j1 < q), 1, np.where(i1 < p, 2, np.where(j1 < q, 3, -1)))
    pairs = [np.stack(x, axis=1).ravel() for x in ((text, text), (between, np.where(size > 0, 0, -1)), (i1, p), (p, p + size), (j1, q), (q, q + size))]
    some = pairs[1] >= 0
    return [x[some] for x in pairs]


def _of_batch(reference: pa.Array, hypothesis: pa.Array, ignore_punctuation: bool) -> list[np.ndarray]:
    """Opcodes as in ``_gaps`` of all pairs of a batch; texts with few words many at a time, others and those that are cleaned each by itself."""
    codes, ((of_a, n), (of_b, m)), (text, other) = batches.of_texts(reference, hypothesis)
    odd = pc.or_(*(pc.fill_null(pc.match_substring_regex(x, _OTHER_BLANKS), False) for x in (reference, hypothesis))).to_numpy(zero_copy_only=False)
    short = (n <= batches.TABLE_WORDS) & (m <= batches.TABLE_WORDS) & ~odd & (not ignore_punctuation)
    same = short & (text == other) & (n > 0)
    found = [[np.flatnonzero(same), np.zeros(same.sum(), np.int64), np.zeros(same.sum(), np.int64), n[same], np.zeros(same.sum(), np.int64), n[same]]]
    for k in batches.parts(np.where(short & ~same, n, batches.TABLE_WORDS + 1), batches.TABLE_WORDS, m):
        blocks = batches.matches(batches.table(codes, of_a, k, n[k], -1), n[k], batches.table(codes, of_b, k, m[k], -2), m[k])
        place, *ops = _gaps(*blocks, n[k], m[k])
        found.append([k[place], *ops])
    rows = []
    for k in np.flatnonzero(~short).tolist():
        ref, hyp = ((x[k].as_py() or "").split() for x in (reference, hypothesis))
        (a, at_a), (b, at_b) = (_cleaned(x, ignore_punctuation) for x in (ref, hyp))
        at_a, at_b = at_a + [len(ref)], at_b + [len(hyp)]
        rows += [(k, _TAGS.index(tag).as_py(), at_a[i1], at_a[i2], at_b[j1], at_b[j2]) for tag, i1, i2, j1, j2 in _matcher(a, b).get_opcodes()]
    if rows:
        found.append(list(np.array(rows, np.int64).T))
    return [np.concatenate(x).astype(np.int64) for x in zip(*found)]


def opcodes(pairs: DataFrame, *keys: str, ignore_punctuation: bool = False) -> DataFrame:
    """A row for each run of equal, replaced, deleted or inserted words: ``keys`` and OPCODES.

    Spans index the original words also when punctuation is ignored. Null texts have no words.
    """
    names = [*keys, "tag", "i1", "i2", "j1", "j2"]
    types = dict(pairs.dtypes)

    def match(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ops = _of_batch(batch.column("reference"), batch.column("hypothesis"), ignore_punctuation)
            for k in range(0, len(ops[0]), OPCODES_AT_ONCE):
                place, tag, *spans = (x[k : k + OPCODES_AT_ONCE] for x in ops)
                taken = [batch.column(c).take(pa.array(place)) for c in keys]
                yield pa.RecordBatch.from_arrays([*taken, _TAGS.take(pa.array(tag)), *(pa.array(x, pa.int32()) for x in spans)], names=names)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + OPCODES
    return pairs.select(*keys, "reference", "hypothesis").mapInArrow(match, schema)


def diff_counts(ops: DataFrame, *by: str) -> DataFrame:
    """Words by class of difference: of the reference, or of the hypothesis where it inserts."""
    size = F.when(F.col("tag") == "insert", F.col("j2") - F.col("j1")).otherwise(F.col("i2") - F.col("i1"))
    kind = F.when(F.col("tag") == "equal", CLASSES["equal"]).when(F.col("tag") == "delete", CLASSES["delete"]).otherwise("Different")
    return ops.groupBy(*by, kind.alias("kind")).agg(F.sum(size).alias("words"))
