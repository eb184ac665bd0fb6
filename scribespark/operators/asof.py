"""For each row the last sample at or before its time, whatever the distribution of times.

Rows and samples are put into one order (group, time, samples before rows) and dealt out by ranges of it, in
which equal times are told apart by a hash: a busy hour, a busy instant and a busy group are split. A task goes through its
range once, with the last sample at hand; what a range begins with comes from the ranges before it, by a table of a row a range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribespark.sources import files


def asof_join(rows: DataFrame, samples: DataFrame, at: str, ts: str, columns: list[str], by: tuple[str, ...] = (), name: str = "sample") -> DataFrame:
    """rows with ``name``: struct of ``columns`` of the last sample of their group at or before their time, null without one.

    Of samples at one time the greatest by ``columns`` in their order is the last. A null time has no
    sample; samples without a time are nobody's. Null groups are equal.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    group = lambda df: F.struct(*(df[c].alias(k) for k, c in zip(keys, by)), F.lit(0).alias("_"))
    value = F.struct(*columns)
    marks = rows.select(group(rows).alias("_g"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(samples.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.struct(*rows.columns).alias("_r"))
    seen = samples.where(F.col(ts).isNotNull()).select(group(samples).alias("_g"), F.col(ts).alias("_t"), F.lit(0).alias("_kind"), value.alias("_v"), F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"))
    # equal rows may change places, others never do, so a task that runs again deals alike
    order = ["_g", "_t", "_kind", "_v", "_tie", "_id"]
    both = marks.unionByName(seen).withColumns({"_tie": F.xxhash64("_r"), "_id": F.monotonically_increasing_id()})
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie", "_id")
    path = f"{files.shared_dir(rows.sparkSession)}/asof-{uuid.uuid4().hex}"
    found = files.snapshot(_walked(dealt), path)
    # of each range: the group it ends in and the last sample of it; a row a range
    ends = found.where("_r is null")
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy("_g").orderBy("_range"))
    in_order = Window.orderBy("_range")
    carried = ends.select("_range", "_g", last.alias("_c"))
    begins = carried.select("_range", F.lag("_g").over(in_order).alias("_from"), F.lag("_c").over(in_order).alias("_c"))
    out = found.where("_r is not null").join(F.broadcast(begins), "_range", "left")
    sample = F.when(F.col("_r")[at].isNotNull(), F.coalesce("_v", F.when(F.col("_g") == F.col("_from"), F.col("_c"))))
    return out.select("_r.*", sample.alias(name))


def _walked(dealt: DataFrame) -> DataFrame:
    """Each row of a sorted range with the last sample of its group in the range, and a row that says how the range ends."""
    schema = T.StructType([dealt.schema["_g"], dealt.schema["_v"], dealt.schema["_r"], T.StructField("_range", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        groups = values = None  # of the last row so far: its group and the last sample of it, as arrays of one
        for batch in batches:
            if not batch.num_rows:
                continue
            g, v, r, kind = (batch.column(c) for c in ("_g", "_v", "_r", "_kind"))
            if groups is not None:
                # the state stands before the batch, as a sample of the group that was last
                g, v = pa.concat_arrays([groups, g]), pa.concat_arrays([values, v])
            first = len(g) - batch.num_rows
            is_sample = np.concatenate([np.ones(first, bool), kind.to_numpy() == 0])
            codes = _codes(g)
            new = np.concatenate([[True], codes[1:] != codes[:-1]])
            places = np.arange(len(g))
            start = np.maximum.accumulate(np.where(new, places, 0))
            sample = np.maximum.accumulate(np.where(is_sample, places, -1))
            known = pa.array(np.where(sample >= start, sample, 0), mask=sample < start)
            last = v.take(known)
            rows = np.flatnonzero(~is_sample[first:])
            at = pa.array(rows + first)
            yield pa.RecordBatch.from_arrays([g.take(at), last.take(at), r.take(pa.array(rows)), pa.array(np.full(len(rows), number), pa.int32())], schema=arrow)
            groups, values = g.slice(len(g) - 1), last.slice(len(g) - 1)
        if groups is not None:
            yield pa.RecordBatch.from_arrays([groups, values, pa.nulls(1, arrow.field("_r").type), pa.array([number], pa.int32())], schema=arrow)

    return dealt.mapInArrow(walk, schema)


def _codes(groups: pa.StructArray) -> np.ndarray:
    """A number for each distinct group, nulls included."""
    out = np.zeros(len(groups), np.int64)
    for k in range(len(groups.type)):
        own = groups.field(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return out
