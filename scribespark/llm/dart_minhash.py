"""Operator 10: near-duplicates by DartMinHash signatures and a banded join.

A text is a weighted set: each run of five words, weighing as often as it occurs. An element's region reaches
from 0 to its weight, any positive number, and is made of cells of one unit. Darts fall on the
plane of (element, weight) by a random process that depends on the place only, each with a time and a
coordinate of the signature. The darts inside a text's regions are thrown until every coordinate has
one; the earliest stays. Two texts keep the same dart with the probability of their weighted Jaccard
similarity, at a cost of the text's size plus ``COORDINATES * log(COORDINATES)`` darts.

Texts of equal words are one class first. Bands of the signatures bring similar classes into buckets;
in each bucket a pivot (the member that meets most texts) is verified against the others, and links are
joined to components. After a few
rounds, the members of a bucket that are still in different components are compared: all pairs in small
buckets, in larger ones all pairs that pass an exact prefix filter on shingles. No candidate is left out,
and a group of near copies costs a few pairs a member.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribespark.llm.graph import components
from scribespark.llm.hashing import elements, mixed, shingles, word_hashes
from scribespark.llm.shared import text_of, written

BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
SIMILARITY = 0.8
PIVOT_ROUNDS = 2
#: Members up to which all pairs of a bucket are tried in the end; larger buckets use the prefix filter.
FEW = 16
#: Rows of 16-byte keys that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Bytes of text hashed at a time.
CHUNK = 400_000
_STEP = 0xD1342543DE82EF95
_PLACE = np.uint64(0x9FB21C651E98DF25)


def signature(cells: np.ndarray, filled: np.ndarray | None = None, t: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, over cells of one unit of weight.

    ``filled``: how far the region reaches into each cell (see ``hashing.regions``), all of it if not given. A dart
    has its place in the cell's weight, and falls beside a region that ends before it.
    """
    if not len(cells):
        return np.zeros(t, np.uint64)
    weight = len(cells) if filled is None else filled.sum()
    limit = t * (math.log(t) + 3) / weight
    while True:
        found, times, ids = np.zeros(t, bool), [], []
        alive, time, reach = cells, np.zeros(len(cells)), filled
        throw = 1
        while len(alive):
            # the cell's next dart: exponential waiting times, from a hash of cell and throw
            dart = mixed(alive + np.uint64(throw * _STEP % (1 << 64)))
            time = time - np.log1p(-(dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            inside = time < limit
            alive, time, dart = alive[inside], time[inside], dart[inside]
            hit = slice(None)
            if reach is not None:
                reach = reach[inside]
                hit = (mixed(dart ^ _PLACE) >> np.uint64(11)) * 2.0**-53 < reach
            times.append(time[hit])
            ids.append(dart[hit])
            throw += 1
        time, dart = np.concatenate(times), mixed(np.concatenate(ids) ^ np.uint64(_STEP))
        order = np.argsort(-time, kind="stable")
        place = (dart[order] % np.uint64(t)).astype(np.int64)
        out = np.zeros(t, np.uint64)
        out[place] = dart[order]  # the earliest comes last and stays
        found[place] = True
        if found.all():
            return out
        limit *= 2


def bands_of(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(_STEP) + rows[:, k])
    return key.astype(np.int64)


SIGNED = "doc_id long, row_hash long, key binary, bands array<bigint>, size int, elems binary"


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """See SIGNED: key names the words of a text, elems are its weighted shingles (sorted, 32 bits each)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts: list[bytes] = []
                size = 0
                while at + len(texts) < batch.num_rows and size < CHUNK:
                    texts.append(batch.column(2)[at + len(texts)].as_py())
                    size += len(texts[-1])
                words, ends = word_hashes(texts)
                rows = []
                for text, a, b in zip(texts, [0, *ends[:-1]], ends):
                    elems = elements(shingles(words[a:b]))
                    key = hashlib.md5(b" ".join(text.lower().split())).digest()
                    rows.append((key, bands_of(signature(elems)), len(elems), np.sort((elems >> np.uint64(32)).astype("<u4")).tobytes()))
                keys, bands, sizes, data = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(rows)), batch.column(1).slice(at, len(rows)), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())],
                    names=["doc_id", "row_hash", "key", "bands", "size", "elems"],
                )
                at += len(rows)

    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.cast("binary").alias("text")).mapInArrow(sign, SIGNED)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is SIMILARITY or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= SIMILARITY * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    one = texts.select(F.col("key").alias("a"), F.col("elems").alias("x"))
    two = texts.select(F.col("key").alias("b"), F.col("elems").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary")


def _bounded(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def classes(table: DataFrame) -> DataFrame:
    """key, comp of every key that has a near copy among the other keys. ``table``: see SIGNED, written."""
    keys = table.groupBy("key", "bands", "size").agg(F.lit(1).alias("one")).drop("one")
    members = keys.select("key", "size", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(full, "bucket")
    # how many a key meets in its buckets: most for the text that its group's copies were made from
    degree = members.groupBy("key").agg(F.sum("n").alias("degree"))
    members = written(members.drop("n").join(degree, "key"), "buckets")
    near = written(members.select("key").distinct(), "near_keys")
    texts = table.select("key", "elems").join(_bounded(near), "key", "left_semi")
    texts = written(texts.groupBy("key").agg(F.first("elems").alias("elems")), "elements")

    comps: DataFrame | None = None
    links = tested = None
    for turn in range(PIVOT_ROUNDS + 1):
        now = members.withColumn("comp", F.col("key"))
        if comps is not None:
            now = members.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
            # buckets that still hold different components
            full = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
            now = written(now.join(full, "bucket"), "open")
        if turn < PIVOT_ROUNDS:
            order = F.struct("degree" if not turn else F.xxhash64(F.col("key"), F.lit(turn)).alias("degree"), "key", "comp", "size")
            others = now.groupBy("bucket").agg(F.max(order).alias("p")).select("bucket", F.col("p.key").alias("a"), F.col("p.comp").alias("ca"), F.col("p.size").alias("sa"))
            pairs = _apart(now.join(others, "bucket"), F.col("ca") != F.col("comp"))
        else:
            few = now.where(F.col("n") <= FEW)
            others = few.select("bucket", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("sa"))
            many = now.where(F.col("n") > FEW).select("key", "comp", "size").distinct()
            pairs = _apart(few.join(others, "bucket"), F.col("ca") < F.col("comp")).unionByName(prefix_pairs(many, texts)).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = written(similar(pairs, texts), "similar")
        links = new if links is None else links.unionByName(new)
        comps = components(links)
    return comps


def _apart(met: DataFrame, apart: Column) -> DataFrame:
    """Distinct pairs (a, b), a < b, in different components and of lengths that allow SIMILARITY."""
    long_enough = F.least("sa", "size") >= SIMILARITY * F.greatest("sa", "size") - 1e-9
    return met.where(apart & long_enough).select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()


def prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ``nodes`` (key, comp, size) in different components that can be similar at all.

    For large buckets of texts that share much, yet not enough: a pair with a similarity of SIMILARITY or
    more has a shingle in common among the rarest of both, so texts meet there only.
    """
    shingles = written(nodes.join(texts, "key").select("key", "comp", "size", "elems").mapInArrow(_exploded, "key binary, comp binary, size int, elem int"), "shingles")
    counts = shingles.groupBy("elem").agg(F.count("*").alias("n")).where("n > 1")
    # a shingle of one text leads nowhere, yet it takes its place among the rarest
    own = Window.partitionBy("key").orderBy("n", "elem")
    ranked = shingles.join(counts, "elem", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("at", F.row_number().over(own))
    rare = written(ranked.where((F.col("at") <= F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9) + 1) & (F.col("n") > 1)).select("key", "comp", "size", "elem", "at"), "rare")
    others = rare.select("elem", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("sa"), F.col("at").alias("ia"))
    # what both still have from here on must make up the common part that SIMILARITY asks for
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("sa") + F.col("size")) - 1e-9)
    room = F.least(F.col("sa") - F.col("ia"), F.col("size") - F.col("at")) + 1 >= need
    return _apart(rare.join(others, "elem"), (F.col("ca") < F.col("comp")) & room)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            some = batch.slice(at, 100)
            elems = [np.frombuffer(x, "<i4") for x in some.column(3).to_pylist()]
            place = pa.array(np.repeat(np.arange(len(elems)), [len(x) for x in elems]))
            yield pa.RecordBatch.from_arrays([*(c.take(place) for c in some.columns[:3]), pa.array(np.concatenate(elems))], names=["key", "comp", "size", "elem"])


def groups(table: DataFrame) -> DataFrame:
    """doc_id, row_hash, comp and class_id, class_size of each row of ``table`` (see SIGNED, written)."""
    comps = classes(table)
    counted = table.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    sizes = counted.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = written(counted.select("key", "comp").join(sizes, "comp"), "classes")
    return table.select("doc_id", "row_hash", "key").join(by_key, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its class), class_size.

    A class is a component of the graph of texts with a similarity of 0.8 or more: weighted Jaccard over
    runs of five words, A-Z lower-cased (all words at once where there are fewer than five). Null texts
    are empty, and all texts without words are one class. Null ids count as above every other for class_id.
    Repeated rows are rows of one class; extra columns are left out; an empty table gives no rows.
    """
    table = written(signed(docs, id_col, text_col), "signatures")
    return groups(table).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id, with all its columns; else as ``near_duplicates``.

    Texts without words are not near copies of each other: they all stay.
    """
    found = groups(written(signed(docs, id_col, text_col).where("size > 0"), "signatures"))
    # a row is known by its id and its text's hash; repeated rows are dropped to one
    ranked = found.where("class_size > 1").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("first"))
    own = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("row_hash") == F.col("first.row_hash"))
    rows = written(found.where("class_size > 1").join(ranked, "comp").select("doc_id", "row_hash", own.alias("kept")).groupBy("doc_id", "row_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "verdicts")
    verdicts = _bounded(rows.select(F.col("doc_id").alias("v_id"), F.col("row_hash").alias("v_hash"), "kept", "rows").where("not kept or rows > 1"))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row_hash"))
    judged = whole.join(verdicts, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("row_hash") == F.col("v_hash")), "left").where("kept is null or kept")
    once = judged.where("rows > 1").groupBy("doc_id", "row_hash").agg(F.first("doc").alias("doc")).select("doc")
    return judged.where("rows is null or rows = 1").select("doc").unionByName(once).select("doc.*")
