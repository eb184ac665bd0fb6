"""Operator 9: hierarchical packing into windows of several lengths.

Full windows of the longest tier are cut from long documents at once. What is left of a document is
routed to the smallest tier that holds it. Each tier, longest first, is packed: a piece opens a window
and the gap behind it is filled with whole pieces of the same or shorter tiers, the last one cut where
nothing fits. What one task has left in the end is cut into windows of powers of two. So nothing but
the tokens themselves takes space. Windows of one tier are dealt to step groups of equal tokens, and
part-filled groups of a task are merged, largest first, into the emptiest.

Packing is local to a task: no shuffle, a task's memory is bounded by ``ROUND_TOKENS`` and its longest
document, and a task that runs again packs its own rows again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribespark.llm.shared import text_of
from scribespark.llm.tokens import encoder

#: Window lengths, shortest first: powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens gathered before the tiers are packed.
ROUND_TOKENS = 500_000
#: Tokens of a step group.
STEP_TOKENS = 16 * 2048

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]


class Packer:
    """Packs documents given one by one; ``add``, ``pack`` and ``finish`` return rows of PIECES."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.next_window = self.next_group = part << 33
        #: by tier: pieces (doc_id, start, length, tokens of the document, own ids): no more of a document is kept than its piece
        self.pools: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.held = 0
        #: by tier: windows of the step group that is being filled
        self.open: dict[int, tuple[list, int]] = {}

    def _route(self, piece: tuple) -> None:
        self.pools[next(t for t in self.tiers if piece[2] <= t)].append(piece)
        self.held += piece[2]

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        out, top, n = [], self.tiers[-1], len(ids) // 4
        at = 0
        while n - at >= top:
            out += self._window([(doc_id, at, top, n, ids[4 * at : 4 * (at + top)])], top)
            at += top
        if at < n:
            self._route((doc_id, at, n - at, n, ids[4 * at :]))
        return out

    @staticmethod
    def _split(piece: tuple, first: int) -> tuple[tuple, tuple]:
        doc_id, start, length, n, ids = piece
        return (doc_id, start, first, n, ids[: 4 * first]), (doc_id, start + first, length - first, n, ids[4 * first :])

    def _take(self, tier: int, whole: int) -> tuple | None:
        """A piece of at most that many tokens from the tier or a shorter one, the longest tier first."""
        for t in reversed(self.tiers):
            if t <= tier and self.pools[t] and self.pools[t][-1][2] <= whole:
                self.held -= self.pools[t][-1][2]
                return self.pools[t].pop()
        return None

    def _cut(self, tier: int, gap: int) -> tuple | None:
        """The first ``gap`` tokens of a piece of the shortest tier that has one; its rest is routed anew."""
        for t in self.tiers:
            if t <= tier and self.pools[t]:
                piece = self.pools[t].pop()
                self.held -= piece[2]
                piece, rest = self._split(piece, gap)
                self._route(rest)
                return piece
        return None

    def pack(self) -> list[tuple]:
        """Packs every tier, longest first; a window that can't be filled goes back to the pools."""
        out: list[tuple] = []
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window, gap = [], tier
                while gap and (piece := self._take(tier, gap) or self._cut(tier, gap)):
                    window.append(piece)
                    gap -= piece[2]
                if gap:
                    for piece in window:
                        self._route(piece)
                    break
                out += self._window(window, tier)
        return out

    def finish(self) -> list[tuple]:
        """The rest, in windows of powers of two, and the step groups that are not full."""
        out = self.pack()
        rest = [p for t in reversed(self.tiers) for p in self.pools[t]]
        left = sum(p[2] for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = rest.pop()
                if piece[2] > gap:
                    piece, after = self._split(piece, gap)
                    rest.append(after)
                window.append(piece)
                gap -= piece[2]
            out += self._window(window, size)
            left -= size
        # part-filled groups: the largest windows first into the emptiest group
        windows = sorted((w for some, _ in self.open.values() for w in some), key=lambda w: -w[1])
        n = max(1, round(sum(w[1] for w in windows) / self.step_tokens))
        groups = [(0, self.next_group + i) for i in range(n)]
        for rows, size in windows:
            filled, group = heapq.heappop(groups)
            out += [row[:7] + (group,) + row[8:] for row in rows]
            heapq.heappush(groups, (filled + size, group))
        return out

    def _window(self, pieces: list[tuple], size: int) -> list[tuple]:
        """Deals a window to the open step group of its tier; returns the group's rows once it is full."""
        rows, offset = [], 0
        for doc_id, start, length, n, ids in pieces:
            rows.append((doc_id, start, length, n, self.next_window, offset, size, None, ids))
            offset += length
        self.next_window += 1
        tier = next(t for t in self.tiers if size <= t)
        some, filled = self.open.get(tier, ([], 0))
        some.append((rows, size))
        if filled + size < self.step_tokens:
            self.open[tier] = (some, filled + size)
            return []
        self.open[tier] = ([], 0)
        self.next_group += 1
        return [row[:7] + (self.next_group - 1,) + row[8:] for rows, _ in some for row in rows]


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document, with its ids and place: see PIECES.

    Every id of every document (its text's, then ``end_id``) lies in exactly one piece. Null texts are
    empty (one id), null document ids stay null, repeated rows are packed each, extra columns are left
    out, an empty table gives no rows. Offsets in a sequence have no gaps; a sequence's length is a
    power of two, so none is padded.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, encode, end = Packer(TaskContext.get().partitionId(), tiers), encoder(tokenizer, kind).encode, end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                ids = encode(text.as_py())
                rows += packer.add(doc_id.as_py(), ids + end)
                size += len(ids)
                if packer.held >= ROUND_TOKENS:
                    rows += packer.pack()
                if rows and size >= 4 * ROUND_TOKENS:
                    yield batch_of(rows)
                    rows, size = [], 0
        rows += packer.finish()
        if rows:
            yield batch_of(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(pieces, PIECES)
