"""Operator 13: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers cut a text into byte ranges. Divide and conquer finds where they cut alike: in an interval
between two shared cuts a shared end near the middle is looked for, by bisecting the other vocabulary's
ends, and both halves are treated alike; an interval without a shared cut is a group. All intervals of many
documents take a step together, so a step is a few operations on whole arrays.

Counts of linked ids over the corpus: each document has a pair of ids once, tasks add up before the shuffle.
Pairs that hold more than one in ``HEAVY`` of all (document, pair) rows, which are fewer than ``HEAVY`` pairs,
go to every task; rows of other pairs meet their counts by a shuffle, where none of them is frequent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribespark.llm.shared import text_of, written

#: Bound of the number of pairs that every task is told of.
HEAVY = 100_000
#: UTF-8 bytes of text whose tokens are aligned together; longer documents are cut at shared cuts.
ROUND_BYTES = 4_000_000
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1_000_000
#: Single ends tried around the middle before all ends of an interval are.
TRIES = 8

_SHIFT = 24
#: Both vocabularies cut before these where something else than white space precedes: no entry of either goes on there.
_CUT = re.compile(r"(?<=\S)[ \t\n]")
#: Fixed value: the pattern by which the byte-level vocabulary cuts a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The piece vocabulary's mark of a blank.
_MARK = "▁"

_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


class Vocabulary:
    """Bytes of each id, and which bytes a row of ids stands for."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0)
        return self.bytes[at + np.repeat(self.start[ids] - end + size, size)]


def byte_level(tokens: list[str]) -> list[bytes]:
    """Bytes of byte-level entries: visible Latin-1 characters stand for themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}
    return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]


class Encoders:
    """Both vocabularies: ids of a text, their bytes, and names of ids for the listing of groups.

    A's file is the tokenizers library's; its entries are ranks of merges too, so tiktoken, which keeps no offsets, gives the
    same ids in a fifth of the time.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(a_path) as f:
            model = json.load(f)["model"]
        ids, first = model["vocab"], len(model["vocab"]) - len(model["merges"])
        merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        if any(ids[m] != k for k, m in enumerate(merged, first)):
            raise ValueError(f"{a_path}: ids aren't ranks of merges")
        a = byte_level(sorted(ids, key=ids.get))
        b = SentencePieceProcessor(model_file=b_path)
        entries = [b.id_to_piece(i) for i in range(b.vocab_size())]
        self.a = Vocabulary(a)
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(entries)])
        self._a = Encoding("own", pat_str=_PATTERN, mergeable_ranks={t: k for k, t in enumerate(a)}, special_tokens={})
        self._b, self._blank = b, entries.index(_MARK)
        # decimal names with what follows them, as rows of bytes: A inside and at the end of a group, then B
        n = max(len(self.a.size), len(self.b.size))
        names = np.array([f"{i}{mark}".encode() for mark in ",|,;" for i in range(n)])
        self.names, self.n = names.view(np.uint8).reshape(4 * n, -1), n
        self.name_size = (self.names != 0).sum(1)

    def segments(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        """ids of A, ids of B and the bytes of a blank and the text; long texts in parts that end at shared cuts."""
        text, lo = " " + text, 0
        while lo < len(text):
            gap = _CUT.search(text, lo + ROUND_BYTES // 4) if len(text) > lo + ROUND_BYTES // 4 else None
            hi = gap.start() if gap else len(text)
            part = text[lo:hi]
            yield np.array(self._a.encode_ordinary(part)), np.array(self._pieces(part)), part.encode()
            lo = hi

    def _pieces(self, part: str) -> list[int]:
        """The library puts a blank before what it is given."""
        if part[0] != " ":
            return self._b.encode(part)[1:]
        return self._b.encode(part[1:]) if len(part) > 1 else [self._blank]

    def same(self, a: np.ndarray, b: np.ndarray, text: bytes) -> bool:
        """Whether both rows of ids stand for just these bytes."""
        whole = np.frombuffer(text, np.uint8)
        return np.array_equal(self.a.joined(a), whole) and np.array_equal(self.b.joined(b), whole)


_encoders: dict[tuple, Encoders] = {}


def _encoder(a_path: str, b_path: str) -> Encoders:
    if (a_path, b_path) not in _encoders:
        _encoders.clear()
        _encoders[a_path, b_path] = Encoders(a_path, b_path)
    return _encoders[a_path, b_path]


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many A and B tokens both cut alike, in order, the ends of the texts included.

    ``a_end`` and ``b_end`` are rising byte offsets of token ends over texts put one after another;
    ``a_stop`` and ``b_stop`` how many tokens there are up to the end of each text.
    """
    lo, hi, b_lo, b_hi = (np.concatenate([[0], x[:-1]]) if first else x for x, first in ((a_stop, 1), (a_stop, 0), (b_stop, 1), (b_stop, 0)))
    found = [(a_stop, b_stop)]
    tried = np.zeros(len(lo), np.int64)
    while True:
        # a group, if all inner ends have been tried or one side has a single token
        some = (hi - lo - 1 > tried) & (b_hi - b_lo > 1)
        lo, hi, b_lo, b_hi, tried = (x[some] for x in (lo, hi, b_lo, b_hi, tried))
        if not len(lo):
            break
        # inner ends of A are those of tokens lo .. hi - 2; try the middle one, then the next after and before it
        probe = (lo + hi - 2) // 2 + np.where(tried % 2 == 1, (tried + 1) // 2, -(tried // 2))
        rare = tried >= TRIES
        if rare.any():
            probe[rare], cutless = _nearest(a_end, b_end, lo[rare], hi[rare])
            keep = np.ones(len(lo), bool)
            keep[np.flatnonzero(rare)[cutless]] = False
            lo, hi, b_lo, b_hi, tried, probe = (x[keep] for x in (lo, hi, b_lo, b_hi, tried, probe))
        at = np.searchsorted(b_end, a_end[probe])
        hit = b_end[at] == a_end[probe]
        miss = ~hit
        a_cut, b_cut = probe[hit] + 1, at[hit] + 1
        found.append((a_cut, b_cut))
        lo, hi = np.concatenate([lo[miss], lo[hit], a_cut]), np.concatenate([hi[miss], a_cut, hi[hit]])
        b_lo, b_hi = np.concatenate([b_lo[miss], b_lo[hit], b_cut]), np.concatenate([b_hi[miss], b_cut, b_hi[hit]])
        tried = np.concatenate([tried[miss] + 1, np.zeros(2 * len(a_cut), np.int64)])
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.sort(a), np.sort(b)


def _nearest(a_end: np.ndarray, b_end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the shared inner end next to its middle, and whether there is none."""
    size = hi - 1 - lo
    of = np.repeat(np.arange(len(lo)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of]
    common = b_end[np.searchsorted(b_end, a_end[at])] == a_end[at]
    of, at = of[common], at[common]
    best = np.full(len(lo), np.iinfo(np.int64).max)
    np.minimum.at(best, of, 2 * abs(2 * at - (lo + hi - 2)[of]) + (2 * at > (lo + hi - 2)[of]))
    far, after = best // 2, best % 2 == 1
    cutless = best == np.iinfo(np.int64).max
    return np.where(cutless, lo, (lo + hi - 2 + np.where(after, far, -far)) // 2), cutless


def _aligned(enc: Encoders, round_: list[tuple]) -> Iterator[tuple]:
    """For each (a, b) of a round: its number of groups, their listing, pairs of linked ids and how often each is linked."""
    a, b = (np.concatenate([x[k] for x in round_]) for k in (0, 1))
    a_stop, b_stop = (np.cumsum([len(x[k]) for x in round_]) for k in (0, 1))
    a_end, b_end = np.cumsum(enc.a.size[a]), np.cumsum(enc.b.size[b])
    a_cut, b_cut = shared_cuts(a_end, b_end, a_stop, b_stop)
    # listing: a group's A tokens, then its B tokens
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[a_cut - 1] = b_last[b_cut - 1] = 1
    codes = np.empty(len(a) + len(b), np.int64)
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    codes[np.arange(len(a)) + np.concatenate([[0], b_cut])[a_group]] = a + enc.n * a_last
    codes[np.arange(len(b)) + a_cut[b_group]] = b + enc.n * (2 + b_last)
    listing = enc.names[codes].ravel()
    listing = listing[listing != 0].tobytes()
    text_stop = np.cumsum(enc.name_size[codes])[a_stop + b_stop - 1]
    # links: between two neighbouring ends of either side lies one overlapping pair
    ends = np.concatenate([a_end, b_end])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    i, j = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    doc = np.searchsorted(a_stop, i, side="right")
    pair, times = np.unique((doc << 2 * _SHIFT) | (a[i] << _SHIFT) | b[j], return_counts=True)
    pair_stop = np.searchsorted(pair, np.arange(1, len(round_) + 1) << 2 * _SHIFT)
    pair &= (1 << 2 * _SHIFT) - 1
    groups = np.searchsorted(a_cut, a_stop) + 1
    at = [0, 0, 0]
    for stop in zip(groups.tolist(), text_stop.tolist(), pair_stop.tolist()):
        yield stop[0] - at[0], listing[at[1] : stop[1] - 1], pair[at[2] : stop[2]], times[at[2] : stop[2]]
        at = stop


def _rows(enc: Encoders, docs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of _ROWS for documents (id, text), a round of bounded size at a time."""
    waiting: list[list] = []  # [id, a, b, groups, hash, pairs, times, segments in the round, whether it is complete]
    round_: list[tuple] = []
    size = 0

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, round_, size
        out = _aligned(enc, round_) if round_ else iter(())
        for doc in waiting:
            for _ in range(doc[7]):
                groups, listing, pairs, times = next(out)
                doc[4].update(b";" + listing if doc[3] else listing)
                doc[3] += groups
                if len(doc[5]):
                    pairs, at = np.unique(np.concatenate([doc[5], pairs]), return_inverse=True)
                    times = np.bincount(at, np.concatenate([doc[6], times])).astype(np.int64)
                doc[5], doc[6] = pairs, times
            doc[7] = 0
        done, waiting = ([d for d in waiting if d[8]], [d for d in waiting if not d[8]])
        round_, size = [], 0
        if done:
            none = np.zeros(0, np.int64)
            cells = [(d[0], d[1], d[2], d[3], d[1] + d[2] - d[3], d[4].hexdigest() if d[3] else "", d[5], d[6]) if d[8] == 1 else (d[0], 0, 0, 0, 0, "", none, none) for d in done]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), _SCHEMA.types)], schema=_SCHEMA)

    for doc_id, text in docs:
        doc = [doc_id, 0, 0, 0, hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0]
        waiting.append(doc)
        for a, b, whole in enc.segments(text) if text else ():
            if not enc.same(a, b, whole):
                if doc[7]:
                    del round_[-doc[7] :]
                doc[7], doc[8] = 0, 2
                break
            round_.append((a, b))
            doc[1], doc[2], doc[7] = doc[1] + len(a), doc[2] + len(b), doc[7] + 1
            size += len(whole)
            if size >= ROUND_BYTES:
                yield from settle(False)
        doc[8] = doc[8] or (1 if text else 2)
        if len(waiting) >= 1000:
            yield from settle(False)
    yield from settle(True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each pair is."""
    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        pairs, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        held, at = np.unique(np.concatenate([held, pairs]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(held)).astype(np.int64)
        if len(held) >= COUNTED:
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])
            held, counts = held[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A is a byte-level vocabulary in the tokenizers library's format that is given a blank and the text, B a sentencepiece
    model that puts a blank before it. Null and empty texts, and those that one side does not give back byte
    by byte (a text with U+2581), have zeros and an empty string. Rows with one id are counted each; null ids stay null;
    an empty table gives no rows; extra columns are left out. ``n_links``: token pairs whose bytes overlap;
    ``count_sum``: the sum over them of the number of rows that link their ids; ``n_best``: links whose number is the
    highest of their A id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(a_path, b_path)
        yield from _rows(enc, ((k.as_py(), t.as_py()) for batch in batches for k, t in zip(*batch.columns)))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    table = written(texts.mapInArrow(rows, _ROWS).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = table.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", _SHIFT)), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most as many rows as A has ids
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = sorted(tuple(r) for r in counts.where(F.col("n") * heavy > total).collect())
    return _looked_up(table, counts.where(F.col("n") * heavy <= total), told)


def _looked_up(table: DataFrame, rest: DataFrame, told: list[tuple]) -> DataFrame:
    known = np.array([t[0] for t in told], np.int64)
    number, best = np.array([t[1] for t in told] + [0], np.int64), np.array([t[2] for t in told] + [False], np.int64)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "known_sum", "known_best", "pairs", "times"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            size = np.diff(batch.column("pairs").offsets.to_numpy())
            of = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(known, pairs)
            at = np.where((at < len(known)) & (np.append(known, 0)[np.minimum(at, len(known))] == pairs), at, len(known))
            sums = []
            for x in (number, best):
                s = np.concatenate([[0], np.cumsum(x[at] * times)])
                stop = np.concatenate([[0], np.cumsum(size)])
                sums.append(s[stop[1:]] - s[stop[:-1]])
            open_ = at == len(known)
            left = np.concatenate([[0], np.cumsum(np.bincount(of[open_], minlength=len(size)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[open_])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:7]), *map(pa.array, sums), *lists], names=names)

    types = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, known_sum long, known_best long, pairs array<long>, times array<long>"
    found = table.mapInArrow(split, types)
    open_ = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = open_.join(rest, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("open_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("open_best"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return found.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("known_best", "open_best").alias("n_best"), plus("known_sum", "open_sum").alias("count_sum"), "groups_sha256")
