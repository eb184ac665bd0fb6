"""Words of many texts at once, in Arrow batches: what a step costs is shared by all pairs of a part of a batch.

The words of a part are numbered and laid out in a table of codes, a column a text; a step works on whole rows of it. Each function gives
what its form for one pair in ``long_text`` or ``operators.align`` gives; texts of more than ``TABLE_WORDS`` words go there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words of a text in a table: a word has a bit of an integer.
TABLE_WORDS = 64
#: Texts of a part.
PART = 4096
#: ASCII white space, as in ``\s`` of Java.
BLANKS = " \t\n\x0b\f\r"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, and how many each has; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if some.all():
        return words, n
    return words.filter(pa.array(some)), np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))


def _codes(words: pa.DictionaryArray) -> np.ndarray:
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int16 if len(words.dictionary) < 32_000 else np.int32)


def numbered(words: pa.Array) -> np.ndarray:
    """The words as numbers: equal words have equal ones."""
    return _codes(words.dictionary_encode())


#: Texts of a batch: where each begins among the codes, and how many words it has.
Texts = tuple[np.ndarray, np.ndarray]


@dataclass
class Read:
    """Texts read: the different texts, the different words, the codes of all texts' words in a row, where each text's are, and which text stands in each row of each column."""

    texts: pa.Array
    words: pa.Array
    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    which: list[np.ndarray]

    def of(self, column: int) -> Texts:
        return self.starts[self.which[column]], self.sizes[self.which[column]]

    def cleaned(self, method: str) -> Read:
        """The same with each word cleaned; those that are empty then are gone. As white space stays, these are the words of the cleaned texts."""
        clean = CLEANED[method](self.words).dictionary_encode()
        new = _codes(clean)
        empty = pc.index(clean.dictionary, pa.scalar("", clean.dictionary.type)).as_py()
        codes = new[self.codes]
        if empty < 0:
            return replace(self, words=clean.dictionary, codes=codes)
        stays = codes != empty
        before = _starts(stays)
        starts = before[self.starts]
        return replace(self, words=clean.dictionary, codes=codes[stays], starts=starts, sizes=before[self.starts + self.sizes] - starts)


def _lower(words: pa.Array) -> pa.Array:
    plain = pc.string_is_ascii(words)
    if pc.all(plain, min_count=0).as_py():
        return pc.ascii_lower(words)
    # full case mapping, as in Java
    other = words.filter(pc.invert(plain)).cast(pa.large_binary()).to_pylist()
    return pc.replace_with_mask(pc.ascii_lower(words), pc.invert(plain), pa.array([w.decode("utf-8", "replace").lower() for w in other], pa.large_string()))


#: ``text.STRIPPED`` of words.
CLEANED = {
    "basic": lambda x: x,
    "ignore_punctuation": lambda x: pc.replace_substring_regex(x, r"[!-/:-@\[-`{-~]", ""),
    "normalized": lambda x: pc.replace_substring_regex(_lower(x), r"\p{P}", ""),
}


def read(*columns: pa.Array) -> Read:
    """All texts of some columns, a text that comes again read once."""
    texts = pa.concat_arrays([pc.fill_null(c.cast(pa.large_string()), "") for c in columns]).dictionary_encode()
    words, n = words_of(texts.dictionary)
    words = words.dictionary_encode()
    return Read(texts.dictionary, words.dictionary, _codes(words), _starts(n)[:-1], n, np.split(texts.indices.to_numpy(zero_copy_only=False), len(columns)))


def of_texts(*columns: pa.Array) -> tuple[np.ndarray, list[Texts], list[np.ndarray]]:
    """The codes of the words of all texts, a text that comes again read once; where each column's texts are; equal texts have equal numbers."""
    found = read(*columns)
    return found.codes, [found.of(k) for k in range(len(columns))], found.which


def of_lists(*columns: pa.Array) -> tuple[np.ndarray, list[Texts]]:
    """As ``of_texts``, of lists of words."""
    words = [c.flatten().cast(pa.large_string()) for c in columns]
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    before = _starts(np.array([len(w) for w in words]))
    return numbered(pa.concat_arrays(words)), [(_starts(n)[:-1] + b, n) for n, b in zip(sizes, before)]


def table(codes: np.ndarray, starts: np.ndarray, texts: np.ndarray, sizes: np.ndarray, blank: int) -> np.ndarray:
    """The codes of some texts, a column a text, ``blank`` below its last word."""
    row = np.arange(int(sizes.max(initial=0)))[:, None]
    inside = row < sizes
    return np.where(inside, codes[np.where(inside, starts[texts] + row, 0)], blank) if len(codes) else np.full((len(row), len(texts)), blank, codes.dtype)


#: Words compared at a time.
WORDS_AT_ONCE = 1_000_000


def _ends(codes: np.ndarray, a: Texts, b: Texts, back: bool) -> np.ndarray:
    """How many words each pair begins with (or ends with) in common."""
    (of_a, n), (of_b, m) = a, b
    least = np.minimum(n, m)
    out, ends, first = least.copy(), np.cumsum(least), 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - least[first] + WORDS_AT_ONCE, "right")))
        part = slice(first, last)
        size = least[part]
        starts = _starts(size)
        x, y = ((of + count - 1)[part] if back else of[part] for of, count in ((of_a, n), (of_b, m)))
        step = np.arange(starts[-1]) * (-1 if back else 1)
        shift = starts[:-1] * (1 if back else -1)
        differs = np.flatnonzero(codes[np.repeat(x + shift, size) + step] != codes[np.repeat(y + shift, size) + step])
        at = np.append(differs, starts[-1])[np.searchsorted(differs, starts[:-1])]
        out[part] = np.minimum(at - starts[:-1], size)
        first = last
    return out


def trimmed(codes: np.ndarray, a: Texts, b: Texts) -> tuple[Texts, Texts]:
    """Pairs of texts without the words that both begin or end with."""
    end = _ends(codes, a, b, True)
    (of_a, n), (of_b, m) = (a[0], a[1] - end), (b[0], b[1] - end)
    start = _ends(codes, (of_a, n), (of_b, m), False)
    return (of_a + start, n - start), (of_b + start, m - start)


def parts(sizes: np.ndarray, limit: int, *others: np.ndarray) -> Iterator[np.ndarray]:
    """The texts of at most ``limit`` words, and so the texts beside them, in parts, those with many words first."""
    short = np.flatnonzero(np.logical_and.reduce([x <= limit for x in (sizes, *others)]))
    short = short[np.argsort(-sizes[short], kind="stable")]
    for k in range(0, len(short), PART):
        yield short[k : k + PART]


def distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances of the texts in two tables, their sizes ``n`` falling: rows of costs are integers of a bit a word of ``b``."""
    cost = m.astype(np.int32)
    width = 8 * -(-len(b) // 8)
    columns = np.full((len(m), width), -2, b.dtype)
    columns[:, : len(b)] = b.T
    one = np.uint64(1)
    every = np.where(m > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(m, 1).astype(np.uint64)), np.uint64(0))
    last = np.where(m > 0, one << (np.maximum(m, 1) - 1).astype(np.uint64), np.uint64(0))
    up, down = every.copy(), np.zeros(len(m), np.uint64)
    bits = np.zeros((len(m), 8), np.uint8)
    for i in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -i, "left"))  # those of more than i words
        if width:
            bits[:k, : width // 8] = np.packbits(columns[:k] == a[i, :k, None], axis=1, bitorder="little")
        same = bits[:k].view(np.uint64)[:, 0]
        u, d, full = up[:k], down[:k], every[:k]
        diagonal = (((same & u) + u) ^ u) | same | d
        right, left = d | (full & ~(diagonal | u)), u & diagonal
        cost[:k] += ((right & last[:k]) > 0).astype(np.int32) - ((left & last[:k]) > 0)
        right, left = (right << one) & full | (one & full), (left << one) & full
        up[:k], down[:k] = left | (full & ~(diagonal | right)), right & diagonal
    return np.where(m > 0, cost, n).astype(np.int32)


def within(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the words of each text of ``b`` stand in that of ``a`` in their order; ``n`` falling."""
    width = len(b) + 1
    words = np.full((len(m), width), -2, b.dtype)
    words[:, : len(b)] = b.T
    words, at = words.ravel(), np.arange(len(m)) * width
    ends = at + m
    for i in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -i, "left"))
        at[:k] += words[at[:k]] == a[i, :k]
    return at == ends


def replaced(a: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of texts of equal sizes ``n``, falling: how many words differ in their place if none of these of ``a`` is anywhere in ``b``, else -1.

    Each of them costs one wherever it goes, so no other way from text to text is as cheap as to replace them, nor is it for any part that they begin with.
    """
    out, elsewhere = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    for i in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -i, "left"))
        differs = a[i, :k] != b[i, :k]
        out[:k] += differs
        elsewhere[:k] |= differs & (b[:, :k] == a[i, :k]).any(axis=0)
    return np.where(elsewhere, -1, out)


_COST, _SUBSTITUTION, _DELETION, _INSERTION = 1 << 50, 1 << 32, 1 << 16, 1
_RANK = 1 << 48


def edits(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Substitutions, deletions and insertions (3 rows) of the texts in two tables, ``n`` falling; ties as in ``long_text.edit_counts``.

    A cell is one integer: its cost, then the rank of the step that led there, then the three counts, so the least is the one to take.
    """
    add = np.array([_COST + _SUBSTITUTION, _COST + _RANK + _DELETION, _COST + 2 * _RANK + _INSERTION], np.int64)
    row = np.arange(len(b) + 1, dtype=np.int64)[:, None] * (_COST + _INSERTION) + np.zeros(len(m), np.int64)
    out = np.zeros(len(m), np.int64)
    unranked = np.int64(~(3 * _RANK))
    each = np.arange(len(m))
    for i in range(int(n.max(initial=0)) + 1):
        k = int(np.searchsorted(-n, -i, "left"))
        ends = each[k:][n[k:] == i]
        out[ends] = row[m[ends], ends]
        if not k:
            break
        deleted = row[:, :k] + add[1]
        best = np.minimum(row[:-1, :k] + (b[:, :k] != a[i, :k]) * add[0], deleted[1:])
        row[0, :k] = deleted[0] & unranked
        for j in range(len(b)):
            np.minimum(best[j], row[j, :k] + add[2], out=best[j])
            np.bitwise_and(best[j], unranked, out=row[j + 1, :k])
    return np.array([out >> 32 & 0xFFFF, out >> 16 & 0xFFFF, out & 0xFFFF])


def repetitions(w: np.ndarray, n: np.ndarray, min_length: int, min_repeats: int) -> np.ndarray:
    """Length, start and count (3 rows) as in ``long_text.repetition``, of the texts in a table, at least twice; -1 without any."""
    out = np.full((3, w.shape[1]), -1, np.int32)
    for lag in range(max(1, min_length), len(w) // min_repeats + 1):
        # blanks below a text meet each other only: the later word must be one
        same = (w[lag:] == w[:-lag]) & (np.arange(lag, len(w))[:, None] < n)
        run = same.astype(np.uint8)
        for i in range(len(run) - 2, -1, -1):
            run[i] += run[i + 1] * run[i]
        enough = run >= lag * (min_repeats - 1)
        hit = np.flatnonzero(enough.any(axis=0) & (out[0] < 0))
        if len(hit):
            first = enough[:, hit].argmax(axis=0)
            out[0, hit], out[1, hit], out[2, hit] = lag, first, 1 + run[first, hit] // lag
    return out


def matches(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts' places, starts in ``a`` and in ``b`` and sizes of the blocks that ``align.matching_blocks`` finds before it joins neighbours, in their order.

    All texts at once: of each part that is left of each, the longest block, of these the first.
    """
    rows, columns = len(a), len(b)
    found: list[tuple[np.ndarray, ...]] = []
    if rows and columns:
        run = np.zeros((len(n), rows, columns), np.int8)
        at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        run[:, -1] = at[:, -1:] == bt
        for i in range(rows - 2, -1, -1):
            run[:, i] = at[:, i, None] == bt
            run[:, i, :-1] += run[:, i + 1, 1:] * run[:, i, :-1]
        i, j = np.arange(rows, dtype=np.int8)[:, None], np.arange(columns, dtype=np.int8)
        text = np.flatnonzero((n > 0) & (m > 0))
        low_a, high_a, low_b, high_b = np.zeros(len(text), np.int8), n[text].astype(np.int8), np.zeros(len(text), np.int8), m[text].astype(np.int8)
        while len(text):
            next_ = []
            for k in range(0, len(text), 1024):
                part = slice(k, k + 1024)
                t, la, ha, lb, hb = text[part], low_a[part], high_a[part], low_b[part], high_b[part]
                size = np.minimum(run[t], np.minimum((ha[:, None] - i[:, 0])[:, :, None], (hb[:, None] - j)[:, None, :]))
                size *= (i[:, 0] >= la[:, None])[:, :, None]
                size *= (j >= lb[:, None])[:, None, :]
                flat = size.reshape(len(t), -1)
                best = flat.argmax(axis=1)
                most = flat[np.arange(len(t)), best]
                hit = most > 0
                t, la, ha, lb, hb, best, most = t[hit], la[hit], ha[hit], lb[hit], hb[hit], best[hit], most[hit]
                p, q = (best // columns).astype(np.int8), (best % columns).astype(np.int8)
                found.append((t, p, q, most))
                next_ += [(t, la, p, lb, q), (t, p + most, ha, q + most, hb)]
            text, low_a, high_a, low_b, high_b = (np.concatenate(x) for x in zip(*next_))
            left = (low_a < high_a) & (low_b < high_b)
            text, low_a, high_a, low_b, high_b = (x[left] for x in (text, low_a, high_a, low_b, high_b))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    t, p, q, size = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((p, t))
    return t[order], p[order], q[order], size[order]


def block_repeats(texts: pa.Array, size: int) -> list[str]:
    """The first block of ``size`` characters right after itself in each text, one that ends the text aside; empty without any."""
    texts = pc.ascii_trim(pc.fill_null(texts.cast(pa.large_string()), ""), characters=BLANKS)
    n = pc.binary_length(texts).to_numpy().astype(np.int64)
    joined = texts.buffers()[2]
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset] if len(texts) else 0
    x = np.frombuffer(joined, np.uint8)[first : first + n.sum()] if joined else np.zeros(0, np.uint8)
    starts = _starts(n)
    # a character is its first byte, one of several bytes a number of them; ``more``: bytes beyond the first, up to there
    wide = np.flatnonzero(x >= 0xC0)
    bytes_, sizes = x, 1 + (x[wide] >= 0xE0) + (x[wide] >= 0xF0)
    more = _starts(sizes)
    if len(wide):
        starts = starts - more[np.searchsorted(wide, starts)]
        x = x[(x & 0xC0) != 0x80].astype(np.uint32)
        for k in (1, 2, 3):
            some = sizes >= k
            x[(wide - more[:-1])[some]] |= bytes_[wide[some] + k].astype(np.uint32) << np.uint32(8 * k)
    out = [""] * len(n)
    if len(x) > 2 * size:
        same = x[size:] == x[:-size]
        run = same[: len(same) - size + 1].copy()
        for k in range(1, size):
            run &= same[k : len(same) - size + 1 + k]
        hit = np.flatnonzero(run)
        of = np.searchsorted(starts, hit, "right") - 1
        inside = hit + 2 * size < starts[of + 1]
        of, first = np.unique(of[inside], return_index=True)
        begin, end = (at + more[np.searchsorted(wide - more[:-1], at)] for at in (hit[inside][first], hit[inside][first] + size))
        for k, i, j in zip(of.tolist(), begin.tolist(), end.tolist()):
            out[k] = bytes_[i:j].tobytes().decode()
    return out


def stutters(texts: pa.Array, least: int) -> tuple[list[str], np.ndarray]:
    """The first word that stands ``least`` times in a row in each text, and how often it does there; empty and 0 without any."""
    found = read(texts)
    word, run = stutters_of(found, least)
    return word[found.which[0]].tolist(), run[found.which[0]]


def stutters_of(found: Read, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``stutters`` of each different text."""
    codes, starts = found.codes, np.append(found.starts, len(found.codes))
    word, run = np.full(len(found.sizes), "", object), np.zeros(len(found.sizes), np.int32)
    if len(codes) >= least:
        differs = _starts(codes[1:] != codes[:-1])
        hit = np.flatnonzero(differs[least - 1 :] == differs[: len(differs) - least + 1])
        of = np.searchsorted(starts, hit, "right") - 1
        inside = hit + least <= starts[of + 1]
        of, first = np.unique(of[inside], return_index=True)
        at = hit[inside][first]
        word[of] = found.words.take(pa.array(codes[at])).to_numpy(zero_copy_only=False)
        # to the next other word, or to the text's end
        run[of] = np.minimum(np.searchsorted(differs, differs[at], "right") - at, starts[of + 1] - at)
    return word, run


def phrases(found: Read, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The words from some places on, joined by blanks."""
    ends = _starts(sizes)
    at = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.words.take(pa.array(found.codes[at])).cast(pa.string())), " ")
