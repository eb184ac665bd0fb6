"""Operator 4: exact duplicates with the heavy digests split off.

Frequent-items sketches (Misra-Gries counters: ``approx_top_k``) over all rows, each over the rows of
some tasks, name every digest that may hold more than a ``1 / HEAVY`` share of them. Their exact counts and winners are then
aggregated (partial sums before the shuffle), the true ones are at most ``HEAVY`` rows, and that table
is broadcast: rows of heavy groups are settled where they are read. The remaining digests are dealt
by digest; none of their groups holds more than the share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribespark.llm.shared import text_of, written

#: A digest is heavy with more than this part of the rows: at most so many are broadcast.
HEAVY = 1024
#: Counters of a sketch: its error stays well under the heavy share.
COUNTERS = 8 * HEAVY
#: Sketches, each over a part of the rows; together they name at most 2 * HEAVY * SKETCHES digests.
SKETCHES = 32

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def heavy_groups(rows: DataFrame, digest: str, winner: Column) -> DataFrame:
    """digest, winner (of the group, by max) and group_size of the heavy digests; at most HEAVY rows."""
    key = F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")
    parts = rows.select(key.alias("key"), (F.spark_partition_id() % SKETCHES).alias("part"))
    # a digest above the share among all rows is above it among some sketch's rows
    tops = parts.groupBy("part").agg(F.expr(f"approx_top_k(key, {2 * HEAVY}, {COUNTERS})").alias("top"))
    named = tops.select(F.explode("top").alias("x")).where("x.count > 1").select(F.col("x.item").alias("key")).distinct()
    exact = rows.withColumn("key", key).join(F.broadcast(named), "key", "left_semi").groupBy(digest).agg(F.max(winner).alias("winner"), F.count("*").alias("group_size"))
    total = rows.agg(F.count("*").alias("total"))
    return exact.join(F.broadcast(total)).where((F.col("group_size") > 1) & (F.col("group_size") * HEAVY > F.col("total"))).drop("total")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z (equal SHA-256 of 256 bits). The row with the
    largest id of a group stays; a null id is below every other; of repeated rows with that id one
    stays. Null texts count as empty. Extra columns are left out; an empty table gives no rows.
    """
    digest = F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"))
    # the row number is fixed once the table is written
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    winner = F.struct("doc_id", "row")
    heavy = F.broadcast(written(heavy_groups(rows, "digest", winner), "heavy"))
    hot = rows.join(heavy, "digest")
    group = Window.partitionBy("digest")
    cold = rows.join(heavy, "digest", "left_anti").withColumn("winner", F.max(winner).over(group)).withColumn("group_size", F.count("*").over(group))
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; the rules are those of ``decide``.

    Rows of heavy groups other than the winner go where they are read; only winners and rows of the
    remaining digests are dealt by digest.
    """
    digest = F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))
    narrow = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest")), "digests")
    heavy = F.broadcast(written(heavy_groups(narrow, "digest", F.col("doc_id")), "heavy").drop("group_size"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"))
    settled = rows.join(heavy, "digest", "left").where(F.col("winner").isNull() | (F.col("winner") == F.col("doc_id"))).drop("winner")
    best = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last())
    return settled.withColumn("place", F.row_number().over(best)).where("place = 1").select("doc.*")


def sql(table: str = "documents") -> str:
    """The same result in DuckDB SQL."""
    return f"""
    with d as (select doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) as h from {table}),
    r as (select *, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
                 row_number() over (partition by h order by doc_id desc nulls last) as place from d)
    select doc_id, keep_id, cast(group_size as bigint) as group_size, place = 1 as kept, h as text_sha256 from r"""
