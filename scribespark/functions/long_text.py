"""Word by word work on long texts, a pair at a time, and the functions on Arrow batches that choose between these and ``batches``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribespark.functions import batches


def _common(a: list[str], b: list[str]) -> int:
    """How many words both begin with."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def distance(ref: list[str], hyp: list[str]) -> int:
    """Edit distance in words: a row of the table of costs is one integer of a bit a word."""
    # what both begin or end with costs nothing
    end = _common(ref[::-1], hyp[::-1])
    ref, hyp = ref[: len(ref) - end], hyp[: len(hyp) - end]
    start = _common(ref, hyp)
    ref, hyp = ref[start:], hyp[start:]
    if len(ref) < len(hyp):
        ref, hyp = hyp, ref
    m = len(hyp)
    if not m:
        return len(ref)
    at: dict[str, int] = {}
    for j, w in enumerate(hyp):
        at[w] = at.get(w, 0) | 1 << j
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, cost = every, 0, m
    for w in ref:
        same = at.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        cost += (right & last > 0) - (left & last > 0)
        right, left = right << 1 & every | 1, left << 1 & every
        up, down = left | (every & ~(diagonal | right)), right & diagonal
    return cost


#: Bytes of bit rows that are kept for a way back through the table of costs.
KEPT_BYTES = 64_000_000


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions; of equal costs a hit or substitution before a deletion before an insertion.

    A row of the table is two integers of a bit a word of ``hyp``: where the cost is that of the cell before it in
    the diagonal, and where it is one more than that of the cell above. The way back needs no more. Of long pairs only rows in
    distances are kept and the ones between worked out again, so memory is bounded by ``KEPT_BYTES`` and the texts.
    """
    n, m = len(ref), len(hyp)
    at: dict[str, int] = {}
    for j, w in enumerate(hyp):
        at[w] = at.get(w, 0) | 1 << j
    every = (1 << m) - 1

    def rows(first: int, end: int, up: int, down: int) -> tuple[list[tuple[int, int]], int, int]:
        out = []
        for w in ref[first:end]:
            same = at.get(w, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            right, left = down | (every & ~(diagonal | up)), up & diagonal
            out.append((diagonal, right))
            right, left = right << 1 & every | 1, left << 1 & every
            up, down = left | (every & ~(diagonal | right)), right & diagonal
        return out, up, down

    size = max(1, KEPT_BYTES // (m // 4 + 64))
    starts, held = [], []
    up, down = every, 0
    for first in range(0, n, size):
        starts.append((first, up, down))
        held, up, down = rows(first, min(n, first + size), up, down)
    s = d = k = 0
    i, j = n, m
    for first, up, down in reversed(starts):
        held = held if first + size >= n else rows(first, first + size, up, down)[0]
        while i > first and j:
            diagonal, right = held[i - 1 - first]
            if ref[i - 1] == hyp[j - 1] or not diagonal >> (j - 1) & 1:
                s += ref[i - 1] != hyp[j - 1]
                i, j = i - 1, j - 1
            elif right >> (j - 1) & 1:
                d, i = d + 1, i - 1
            else:
                k, j = k + 1, j - 1
        if not j:
            break
    return s, d + i, k + j


def _at_lag(w: np.ndarray, lag: int, min_repeats: int) -> tuple[int, int, int] | None:
    """The leftmost run of words equal to those a lag later that is long enough."""
    differs = np.flatnonzero(w[lag:] != w[:-lag])
    first = np.concatenate([[0], differs + 1])
    run = np.append(differs, len(w) - lag) - first
    enough = np.flatnonzero(run >= lag * (min_repeats - 1))
    return (lag, int(first[enough[0]]), 1 + int(run[enough[0]]) // lag) if len(enough) else None


#: Anchors looked at together.
ANCHORS = 500_000
#: Most words of a text whose anchors are looked at together with those of others.
SHARED_WORDS = 20_000


class _Hashes:
    """Hashes of runs of words: how far words agree with those a lag later is found by bisecting."""

    def __init__(self, w: np.ndarray):
        base = np.uint64(0x9E3779B97F4A7C15)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(w), base))])
        letters = np.random.default_rng(len(w)).integers(1, 1 << 63, int(w.max(initial=0)) + 2, np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(letters[w] * self.power[:-1])])

    def agree(self, a: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a on (or before it) equal those a lag later, at most ``most``."""
        prefix, power = self.prefix, self.power
        low, high = np.zeros_like(a), most.copy()
        while (open_ := low < high).any():
            size = (low + high + 1) // 2
            x = a - size if back else a
            same = (prefix[x + size] - prefix[x]) * power[lag] == prefix[x + size + lag] - prefix[x + lag]
            low, high = np.where(open_ & same, size, low), np.where(open_ & ~same, size - 1, high)
        return low


def repetition(words: list[str], min_length: int, min_repeats: int) -> tuple[int, int, int] | None:
    """Length, start and count as in ``hallucination.repetition``: of the least lag with a run of words equal to those a lag later.

    A run of a lag's length or more covers a multiple of the lag, so only those anchors are looked at: n / lag of them for
    each lag, n log n in all. How far words agree on either side of an anchor and the place a lag later is found by
    bisecting on hashes; what hashes promise is checked word by word.
    """
    codes: dict[str, int] = {}
    w = np.array([codes.setdefault(x, len(codes)) for x in words], np.int32)
    n = len(w)
    longest = n // max(1, min_repeats)
    if min_repeats < 2:
        return next((found for lag in range(min_length, longest + 1) if (found := _at_lag(w, lag, min_repeats))), None)
    hashes = _Hashes(w)
    lag = max(1, min_length)
    while lag <= longest:
        lags, total = [], 0
        while lag <= longest and total < ANCHORS:
            lags.append(lag)
            total += n // lag
            lag += 1
        number = [(n - 1 - x) // x + 1 for x in lags]  # anchors a with a + lag < n
        of = np.repeat(np.array(lags), number)
        a = (np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)) * of
        hit = w[a] == w[a + of]
        a, of = a[hit], of[hit]
        need = of * (min_repeats - 1)
        after = hashes.agree(a, of, np.minimum(n - a - of, need), False)
        before = hashes.agree(a, of, np.minimum(a, need), True)
        for x in np.unique(of[after + before >= need]).tolist():
            if found := _at_lag(w, x, min_repeats):
                return found
    return None


def repetitions(w: np.ndarray, starts: np.ndarray, n: np.ndarray, min_length: int, min_repeats: int) -> np.ndarray:
    """``repetition`` of many texts (3 rows, -1 without any), twice at least: lags from one to its double at a time, of the texts in which nothing was found before."""
    out = np.full((3, len(n)), -1, np.int32)
    low, longest = max(1, min_length), n // min_repeats
    hashes = _Hashes(w)
    left = np.flatnonzero(longest >= low)
    while len(left):
        # a text has at most n anchors for these lags
        ends, first = np.cumsum(n[left]), 0
        while first < len(left):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[left[first]] + ANCHORS, "right")))
            some = left[first:last]
            first = last
            lags = np.minimum(2 * low, longest[some] + 1) - low
            text = np.repeat(some, lags)
            lag = low + np.arange(len(text)) - np.repeat(np.cumsum(lags) - lags, lags)
            number = (n[text] - 1 - lag) // lag + 1  # anchors a with a + lag < n
            of = np.repeat(np.arange(len(text)), number)
            step = lag[of]
            a = np.repeat(starts[text] - (np.cumsum(number) - number) * lag, number) + np.arange(len(of)) * step
            hit = np.flatnonzero(w[a] == w[a + step])
            a, step, of = a[hit], step[hit], of[hit]
            begin, need = starts[text[of]], step * (min_repeats - 1)
            end = begin + n[text[of]]
            # where two words or more must agree, one beside the anchor does
            beside = np.minimum(a + step + 1, len(w) - 1)
            near = (need < 2) | (a + step + 1 < end) & (w[beside] == w[beside - step]) | (a > begin) & (w[a - 1] == w[a + step - 1])
            a, step, of, begin, end, need = (x[near] for x in (a, step, of, begin, end, need))
            after = hashes.agree(a, step, np.minimum(end - a - step, need), False)
            before = hashes.agree(a, step, np.minimum(a - begin, need), True)
            for p in np.unique(of[after + before >= need]).tolist():
                t = text[p]
                if out[0, t] < 0 and (found := _at_lag(w[starts[t] : starts[t] + n[t]], int(lag[p]), min_repeats)):
                    out[:, t] = found
        low *= 2
        left = left[(out[0, left] < 0) & (longest[left] >= low)]
    return out


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in types.items()])


_INT, _TEXT = T.IntegerType(), T.StringType()
_EDITS = _struct(cost=_INT, s=_INT, d=_INT, i=_INT, n=_INT)
_FOUND = _struct(length=_INT, start=_INT, count=_INT, phrase=_TEXT)
_DETECTED = _struct(length=_INT, start=_INT, count=_INT, phrase=_TEXT, said=_INT, words=_INT, block=_TEXT, rate=T.DoubleType(), word=_TEXT, run=_INT)


def plain_counts(ref: list, hyp: list) -> tuple[int, int, int] | None:
    """``edit_counts`` where nobody needs a table: words were only left out, only added, or only replaced by others (``batches.replaced``)."""
    n, m = len(ref), len(hyp)
    if n == m:
        words = set(hyp)
        differ = [x for x, y in zip(ref, hyp) if x != y]
        return (len(differ), 0, 0) if words.isdisjoint(differ) else None
    rest = iter(ref if n > m else hyp)
    return (0, max(0, n - m), max(0, m - n)) if all(w in rest for w in (hyp if n > m else ref)) else None


def _in_tables(codes: np.ndarray, a: batches.Texts, b: batches.Texts, limit: int, known: np.ndarray, count: Callable, one: Callable) -> np.ndarray:
    """Substitutions, deletions and insertions (3 rows) of each known pair of texts: what both begin or end with is left aside; then pairs
    of which one has all words of the other, or has others in the place of some, are counted in one walk. For the rest ``count`` of tables of those of
    at most ``limit`` words, ``one`` of each other pair; a total only may stand in the first row.
    """
    out = np.zeros((3, len(known)), np.int32)
    which = np.flatnonzero(known)
    (of_a, n), (of_b, m) = batches.trimmed(codes, *((x[which], size[which]) for x, size in (a, b)))
    out[1, which], out[2, which] = np.where(m == 0, n, 0), np.where(n == 0, m, 0)
    left = (n > 0) & (m > 0)
    table = lambda of, size, k, blank: batches.table(codes, of, k, size[k], blank)
    for row, of_x, x, of_y, y in ((1, of_a, n, of_b, m), (2, of_b, m, of_a, n)):
        for k in batches.parts(np.where(left & (x > y), x, limit + 1), limit):
            inside = k[batches.within(table(of_x, x, k, -1), x[k], table(of_y, y, k, -2), y[k])]
            out[row, which[inside]], left[inside] = x[inside] - y[inside], False
    for k in batches.parts(np.where(left & (n == m), n, limit + 1), limit):
        differ = batches.replaced(table(of_a, n, k, -1), n[k], table(of_b, m, k, -2))
        out[0, which[k]], left[k] = np.maximum(differ, 0), differ < 0
    for k in batches.parts(np.where(left, n, limit + 1), limit, m):
        found = count(table(of_a, n, k, -1), n[k], table(of_b, m, k, -2), m[k])
        out[: 3 if found.ndim > 1 else 1, which[k]] = found
    for k in np.flatnonzero(left & ((n > limit) | (m > limit))).tolist():
        r, h = (codes[x[k] : x[k] + size[k]].tolist() for x, size in ((of_a, n), (of_b, m)))
        found = plain_counts(r, h) or one(r, h)
        out[: 1 if isinstance(found, int) else 3, which[k]] = found
    return out


def _both(a: pa.Array, b: pa.Array) -> np.ndarray:
    return pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)


def distance_in_arrow(limit: int) -> Callable:
    """Of two lists of words; those of at most ``limit`` words are counted together."""

    @F.arrow_udf(T.IntegerType())
    def run(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        known = _both(reference, hypothesis)
        codes, (r, h) = batches.of_lists(reference, hypothesis)
        return pa.array(_in_tables(codes, r, h, limit, known, batches.distances, distance).sum(axis=0), mask=~known)

    return run


def _rates(found: batches.Read, limit: int, known: np.ndarray) -> np.ndarray:
    """Distances of the texts in the first two columns over the words of the first; 0 where unknown."""
    r, h = found.of(0), found.of(1)
    known = known & (r[1] > 0) & (found.which[0] != found.which[1])
    return _in_tables(found.codes, r, h, limit, known, batches.distances, distance).sum(axis=0) / np.maximum(r[1], 1)


def rates_in_arrow(limit: int, methods: tuple[str, ...]) -> Callable:
    """Distance of two texts in words over words of the first, cleaned by each of ``methods``, in a struct of the methods' names; null where the first has none."""

    @F.arrow_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in methods]))
    def run(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        found, known = batches.read(reference, hypothesis), _both(reference, hypothesis)
        cleaned = [found.cleaned(m) for m in methods]
        return pa.StructArray.from_arrays([pa.array(_rates(x, limit, known), mask=~(known & (x.of(0)[1] > 0))) for x in cleaned], names=list(methods))

    return run


def _beyond(found: batches.Read, beyond: float, method: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rates of the pairs whose second text has more than ``beyond`` times the words of the first, and whether that is known."""
    (_, n), (_, m) = found.of(0), found.of(1)
    many = (n > 0) & (m / np.maximum(n, 1) > beyond)
    some = replace(found, which=[x[many] for x in found.which]).cleaned(method)
    out, known = np.zeros(len(n)), np.zeros(len(n), bool)
    out[many], known[many] = _rates(some, limit, np.ones(int(many.sum()), bool)), some.of(0)[1] > 0
    return out, known


def beyond_in_arrow(limit: int, method: str, beyond: float) -> Callable:
    """As ``rates_in_arrow`` by one method, null too unless the second text has more than ``beyond`` times the words of the first."""

    @F.arrow_udf(T.DoubleType())
    def run(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        out, known = _beyond(batches.read(reference, hypothesis), beyond, method, limit)
        return pa.array(out, mask=~known)

    return run


def edits_in_arrow(limit: int, texts: bool = False) -> Callable:
    """Of two lists of words, or of two texts: cost, substitutions, deletions, insertions, words of the first."""

    @F.arrow_udf(_EDITS)
    def run(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        known = differ = _both(reference, hypothesis)
        if texts:
            codes, (r, h), (text, other) = batches.of_texts(reference, hypothesis)
            differ = known & (text != other)
        else:
            codes, (r, h) = batches.of_lists(reference, hypothesis)
        counts = _in_tables(codes, r, h, limit, differ, batches.edits, edit_counts)
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (counts.sum(axis=0), *counts, r[1])], names=_EDITS.fieldNames(), mask=pa.array(~known))

    return run


def _repeated(found: batches.Read, said: np.ndarray, limit: int, min_length: int, min_repeats: int) -> list[pa.Array]:
    """Length, start, count and phrase of the texts ``said``: see ``repetition``; null without any."""
    starts, n = found.starts[said], found.sizes[said]
    out = np.full((3, len(n)), -1, np.int32)
    # tables and shared anchors know phrases that stand there twice at least
    limit, shared = (limit, SHARED_WORDS) if min_repeats > 1 else (-1, -1)
    for k in batches.parts(n, limit):
        out[:, k] = batches.repetitions(batches.table(found.codes, starts, k, n[k], -1), n[k], min_length, min_repeats)
    some = np.flatnonzero((n > limit) & (n <= shared))
    if len(some):
        out[:, some] = repetitions(found.codes, starts[some], n[some], min_length, min_repeats)
    for k in np.flatnonzero((n > limit) & (n > shared)).tolist():
        one = repetition(found.codes[starts[k] : starts[k] + n[k]].tolist(), min_length, min_repeats)
        if one:
            out[:, k] = one
    size, at = np.maximum(out[0], 0), starts + np.maximum(out[1], 0)
    return [*(pa.array(x, mask=out[0] < 0) for x in out), batches.phrases(found, at, size).cast(pa.string())]


def repetition_in_arrow(limit: int, min_length: int, min_repeats: int) -> Callable:
    """Of a text: see ``repetition``, with the phrase; null without any."""

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        found = batches.read(texts)
        columns = _repeated(found, np.arange(len(found.sizes)), limit, min_length, min_repeats)
        return pa.StructArray.from_arrays([x.take(pa.array(found.which[0])) for x in columns], names=_FOUND.fieldNames())

    return run


def detected_in_arrow(limit: int, check: tuple[str, ...], min_length: int, min_repeats: int, size: int, beyond: float, least: int) -> Callable:
    """Of a reference and a hypothesis, read once, what the detectors in ``check`` go by: the repetition, words of both, the block, the rate, the stutter."""

    @F.arrow_udf(_DETECTED)
    def run(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        found = batches.read(reference, hypothesis)
        r, h = found.which
        said, of = np.unique(h, return_inverse=True)
        each = pa.array(of)
        nothing = pa.nulls(len(of))
        repeated = [x.take(each) for x in _repeated(found, said, limit, min_length, min_repeats)] if "repetition" in check else [nothing] * 4
        block = pa.array(batches.block_repeats(found.texts.take(pa.array(said)), size), pa.string()).take(each) if "char_repetition" in check else nothing
        rate, known = _beyond(found, beyond, "basic", limit) if "insertions" in check else (np.zeros(len(of)), np.zeros(len(of), bool))
        word, run = (x[h] for x in batches.stutters_of(found, least)) if "stuttering" in check else (nothing, nothing)
        columns = [*repeated, found.sizes[h], found.sizes[r], block, pa.array(rate, mask=~known), word, run]
        arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns]
        return pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(arrays, to_arrow_schema(_DETECTED))], names=_DETECTED.fieldNames())

    return run


@F.arrow_udf(T.IntegerType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words of a text; none of null."""
    return pa.array(batches.words_of(texts)[1], pa.int32())


def block_in_arrow(size: int) -> Callable:
    """See ``batches.block_repeats``."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(batches.block_repeats(texts, size), pa.string())

    return run


_STUTTER = T.StructType([T.StructField("word", T.StringType()), T.StructField("run", T.IntegerType())])


def stutter_in_arrow(least: int) -> Callable:
    """See ``batches.stutters``."""

    @F.arrow_udf(_STUTTER)
    def run(texts: pa.Array) -> pa.Array:
        word, count = batches.stutters(texts, least)
        return pa.StructArray.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int32())], names=["word", "run"])

    return run
