"""Operator 1: token ids in one concatenated array with Elias-Fano coded document boundaries.

A token file is a Parquet folder (any store that Spark reaches, committed by Spark's own protocol).
Each row is a segment: the ids of consecutive documents in one array of fixed-width little-endian
integers, and the documents' boundaries in that array as an Elias-Fano sequence. The sequence keeps
the low bits of each boundary in a packed array and the high bits in unary; a directory of one
unsigned 32-bit count for each 512 bits answers ``select`` without a table of 64-bit offsets. The
document ids are such a sequence, too. A segment knows how many ids stand before it in its part; parts are in order of document id, and
one small sum over parts (a row a task) gives every document its place in the whole array.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribespark.llm.shared import text_of
from scribespark.llm.tokens import encoder

#: Ids after which a segment is closed (it may end with one long document).
SEGMENT_IDS = 1_000_000
BLOCK_BITS = 512
_HEAD = struct.Struct("<QQB")


class EliasFano:
    """A non-decreasing sequence of n integers up to u in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.u, self.low_bits, self.low, self.high = n, u, low_bits, low, high
        blocks = np.add.reduceat(np.bitwise_count(high).astype(np.uint32), np.arange(0, len(high), BLOCK_BITS // 8))
        self.before = np.concatenate([[0], np.cumsum(blocks, dtype=np.uint32)]).astype(np.uint32)

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = np.zeros((u >> low_bits) + n + 1, dtype=np.uint8)
        ones[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return EliasFano(n, u, low_bits, low, np.packbits(ones, bitorder="little"))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.u, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> EliasFano:
        n, u, low_bits = _HEAD.unpack_from(data)
        end = _HEAD.size + (n * low_bits + 7) // 8
        high = np.frombuffer(data, np.uint8, offset=end)
        return EliasFano(n, u, low_bits, np.frombuffer(data[_HEAD.size : end], np.uint8), high)

    def select(self, i: int) -> int:
        """The i-th value: its block by the directory, its bit in the block, its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        at = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.high[at : at + BLOCK_BITS // 8], bitorder="little")
        one = at * 8 + int(np.flatnonzero(bits)[i - int(self.before[block])])
        return ((one - i) << self.low_bits) | self._low(i, i + 1)[0].item()

    def _low(self, start: int, end: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(end - start, dtype=np.uint64)
        first = start * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (end * self.low_bits + 7) // 8], bitorder="little")
        bits = bits[first % 8 :][: (end - start) * self.low_bits].reshape(-1, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def values(self) -> np.ndarray:
        """All values, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def first_from(self, value: int) -> int:
        """The place of the first value that is not below ``value``; n if there is none. By log2(n) selects."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.select(middle) < value else (low, middle)
        return low


#: nulls: documents without an id, they come first; least_id and most_id: of the others, whose distances from
#: least_id are an Elias-Fano sequence, too.
SEGMENTS = "part int, segment int, part_start long, n_ids long, width int, nulls int, least_id long, most_id long, doc_ids binary, boundaries binary, ids binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, id_width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes a token file in ascending id order.

    Null texts are empty, null ids come first, rows with one id stay apart (ordered by their text's
    hash), extra columns are left out; an empty table gives a file of no segments. ``id_width``: bytes
    of an id, 2 or 4; an id that doesn't fit raises.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # the hash spreads rows that share an id, should one id (or null) be very common
    rows = rows.select("*", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    kind_of_id = "<u2" if id_width == 2 else "<u4"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer, kind).encode, np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = total = number = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, doc_ids, held, total, number
            array = np.frombuffer(b"".join(ids), "<u4")
            if id_width == 2 and array.max(initial=0) > 0xFFFF:
                raise ValueError("an id needs more than 2 bytes")
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            known = [x for x in doc_ids if x is not None]
            least, most = (known[0], known[-1]) if known else (None, None)
            distances = EliasFano.of(np.array([x - least for x in known], np.uint64)).to_bytes()
            row = [part, number, total, len(array), id_width, len(doc_ids) - len(known), least, most, distances, EliasFano.of(bounds).to_bytes(), array.astype(kind_of_id).tobytes()]
            total, number, held, ids, doc_ids = total + len(array), number + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                ids.append(encode(text.as_py()) + end)
                doc_ids.append(doc_id.as_py())
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield close()
        if ids:
            yield close()

    rows.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(path)


_NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_READ = "part int, doc_id long, part_start long, n_tokens long, ids binary"


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document of a token file.

    ``only``: a few document ids to look up. They are found in the segments that may hold them by select on the
    coded ids and boundaries, and nothing else of a segment is decoded.
    """
    file = spark.read.schema(SEGMENTS).parquet(path)
    wanted = None if only is None else sorted({int(x) for x in only})
    chosen = file
    if wanted is not None:
        chosen = file.where((F.col("least_id") <= (wanted[-1] if wanted else -1)) & (F.col("most_id") >= (wanted[0] if wanted else 0)))

    def of(part: int, before: int, width: int, ids: bytes, docs: list[int | None], bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        texts = [np.frombuffer(ids, "<u2" if width == 2 else "<u4", b - a, a * width).astype("<u4").tobytes() for a, b in bounds]
        columns = [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array([before + a for a, _ in bounds], pa.int64()), pa.array([b - a for a, b in bounds], pa.int64()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "part_start", "n_tokens", "ids"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, width, nulls, least, doc_ids, boundaries, ids in zip(*(batch.column(i).to_pylist() for i in range(8))):
                own, bounds = EliasFano.from_bytes(doc_ids), EliasFano.from_bytes(boundaries)
                if wanted is None:
                    docs = [None] * nulls + [x + (least or 0) for x in own.values().tolist()]
                    ends = bounds.values().tolist()
                    for at in range(0, len(docs), 500):
                        yield of(part, before, width, ids, docs[at : at + 500], list(zip(ends[at : at + 500], ends[at + 1 : at + 501])))
                    continue
                found: list[tuple[int, int, int]] = []
                for x in wanted:
                    i = own.first_from(max(0, x - least))
                    while i < own.n and own.select(i) + least == x:
                        found.append((x, bounds.select(nulls + i), bounds.select(nulls + i + 1)))
                        i += 1
                yield of(part, before, width, ids, [x for x, _, _ in found], [(a, b) for _, a, b in found])

    # a row a part: as many as the writing job had tasks
    totals = file.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    docs = chosen.select("part", "part_start", "width", "nulls", "least_id", "doc_ids", "boundaries", "ids").mapInArrow(documents, _READ)
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("part_start") + F.col("base")).alias("start"), "n_tokens", "ids")
