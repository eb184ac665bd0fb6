"""External calls a row, as a Spark job: results, errors and attempts as columns."""

from __future__ import annotations

import heapq
import itertools
import json
import pickle
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scribespark.sources import files


class Pace:
    """Lets at most ``rate`` calls a second begin, over all threads of a task; any number without a rate."""

    def __init__(self, rate: float | None):
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                at = max(now, self.next)
                self.next = at + self.gap
            time.sleep(max(0.0, at - now))


def for_each_model(rows: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """A pending row for each row and model; the dimension is a handful of rows."""
    return rows.crossJoin(F.broadcast(models.select(model)))


def _schema(rows: DataFrame, keys: list[str], result: str) -> tuple[T.StructType, list[str]]:
    """What ``enrich`` gives, and the names of the result's fields."""
    fields = T.StructType.fromDDL(result).fields
    return T.StructType([*(rows.schema[k] for k in keys), *fields, T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())]), [f.name for f in fields]


def _asked(call: Callable[[dict, int], dict], row: dict, keys: list[str], names: list[str], n: int) -> dict:
    """The row that the n-th attempt gives."""
    out = {k: row[k] for k in keys} | dict.fromkeys(names)
    try:
        return out | call(row, n) | {"error": None, "attempts": n}
    except Exception as e:  # noqa: BLE001  whatever a service raises becomes the row's error
        return out | {"error": f"{type(e).__name__}: {e}", "attempts": n}


def enrich(rows: DataFrame, keys: list[str], call: Callable[[dict, int], dict], result: str, max_retries: int = 3, concurrency: int = 8, backoff: float = 0.0, rate: float | None = None) -> DataFrame:
    """keys, the fields of ``result`` (DDL), error and attempts: ``call(row, attempt)`` for every row.

    Calls run in ``concurrency`` threads a task, at most ``rate`` of them a second in a task if that is given (for a rate
    of the whole job see ``enrich_at_rate``); a call that raises is tried ``max_retries`` times more, after ``backoff`` seconds, then twice
    as many and so on (1.0 for 1, 2, 4 seconds), then its row carries the error, so that every row comes back once. ``call`` should be
    idempotent: a task that is run again calls again.
    """
    schema, names = _schema(rows, keys, result)
    arrow = to_arrow_schema(schema)

    def attempts(row: dict, pace: Pace) -> dict:
        for n in range(1, max_retries + 2):
            pace.wait()
            out = _asked(call, row, keys, names, n)
            if out["error"] is None:
                break
            if backoff and n <= max_retries:
                time.sleep(backoff * 2 ** (n - 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(rate)
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pa.RecordBatch.from_pylist(list(pool.map(lambda row: attempts(row, pace), batch.to_pylist())), schema=arrow)

    return rows.mapInArrow(run, schema)


def dealt(budget: int, waiting: list[int]) -> list[int]:
    """How many calls each task may make of ``budget``: in proportion to what it has waiting, no more than that; nothing is left over
    while some task has more."""
    total = sum(waiting)
    if total <= budget:
        return waiting[:]
    shares = [w * budget // total for w in waiting]
    rests = sorted(range(len(waiting)), key=lambda k: (-(waiting[k] * budget % total), k))
    for k in rests[: budget - sum(shares)]:
        shares[k] += 1
    return shares


def enrich_at_rate(rows: DataFrame, keys: list[str], call: Callable[[dict, int], dict], result: str, rate: float, max_retries: int = 3, concurrency: int = 8, backoff: float = 0.0, tasks: int | None = None, period: float = 1.0) -> DataFrame:
    """As ``enrich``, with at most ``rate`` calls a second in all tasks together, retries included.

    The tasks of one barrier stage work in rounds of ``period`` seconds (longer if the rate is below one a round). At each
    round's start they tell each other how many rows they have waiting, and each takes its share of the round's calls: one
    without rows leaves its share to others. A task holds one round's rows and those that wait for another attempt. If
    an executor is lost, the stage is run again as a whole.
    """
    spark = rows.sparkSession
    schema, names = _schema(rows, keys, result)
    arrow = to_arrow_schema(schema)
    period = max(period, 1 / rate)
    budget = max(1, int(rate * period))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        source = (row for batch in batches for row in batch.to_pylist())
        ready: deque[tuple[dict, int]] = deque()
        later: list[tuple[float, int, dict, int]] = []
        count = 0
        with ThreadPoolExecutor(concurrency) as pool:
            while True:
                began = time.monotonic()
                while later and later[0][0] <= began:
                    _, _, row, n = heapq.heappop(later)
                    ready.append((row, n))
                ready.extend((row, 1) for row in itertools.islice(source, max(0, budget - len(ready))))
                told = [json.loads(x) for x in context.allGather(json.dumps([len(ready), len(later)]))]
                if not any(a or b for a, b in told):
                    return
                mine = dealt(budget, [a for a, _ in told])[context.partitionId()]
                pace = Pace(mine / period if mine else None)

                def one(item: tuple[dict, int], pace: Pace = pace) -> tuple[dict, dict]:
                    pace.wait()
                    return item[0], _asked(call, item[0], keys, names, item[1])

                done = []
                for row, out in pool.map(one, [ready.popleft() for _ in range(mine)]):
                    n = out["attempts"]
                    if out["error"] is None or n > max_retries:
                        done.append(out)
                    else:
                        count += 1
                        heapq.heappush(later, (time.monotonic() + backoff * 2 ** (n - 1), count, row, n + 1))
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                time.sleep(max(0.0, began + period - time.monotonic()))

    return rows.repartition(tasks or spark.sparkContext.defaultParallelism).mapInArrow(run, schema, barrier=True)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a result yet; those that failed for good are in ``done`` too, so a rerun ends."""
    return rows.join(done.select(*keys), keys, "left_anti")


def fill(rows: DataFrame, keys: list[str], path: str, call: Callable[[dict, int], dict], result: str, commit: int | None = None, enricher: Callable[..., DataFrame] = enrich, **options) -> DataFrame:
    """Asks for the results that ``path`` (what ``enrich`` gives, as files) lacks, adds them, until none is pending.

    With ``commit``, answers are kept in steps. ``enrich`` works in tasks of few rows, of which some ``commit`` rows are in work at a time; each task adds
    its file to ``path`` as it ends (version 2 of Hadoop's file committer), so a run that is killed loses what is in work only. Another enricher, which may share
    its tasks out otherwise, gets ``commit`` rows a micro-batch of a stream over the pending rows; each adds its answers to ``path`` before the next is asked.
    A rerun asks for what isn't in ``path``. What has failed for good is in ``path`` with its error.
    """
    spark = rows.sparkSession
    done = spark.read.parquet(path)

    def add(some: DataFrame, _: int = 0, **written) -> None:
        enricher(some, keys, call, result, **options).select(*done.columns).write.options(**written).mode("append").parquet(path)

    while not (todo := pending(rows, done, keys)).isEmpty():
        if commit:
            folder = f"{files.shared_dir(spark)}/pending-{uuid.uuid4().hex}"
            tasks = spark.sparkContext.defaultParallelism
            step = max(1, commit // tasks)
            if enricher is enrich:
                todo.write.parquet(f"{folder}/rows")
                fixed = spark.read.schema(todo.schema).parquet(f"{folder}/rows")
                add(fixed.repartition(-(-fixed.count() // step)), **{"mapreduce.fileoutputcommitter.algorithm.version": "2"})
            else:
                todo.write.option("maxRecordsPerFile", step).parquet(f"{folder}/rows")
                stream = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", tasks).parquet(f"{folder}/rows")
                stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        else:
            add(todo)
        done = spark.read.schema(done.schema).parquet(path)
    return done


_WAITING = "rows binary"
#: Groups of keys whose waiting rows share a state and a timer.
BUCKETS = 4096


def enrich_stream(stream: DataFrame, keys: list[str], call: Callable[[dict, int], dict], result: str, delays: tuple[float, ...] = (1.0, 2.0, 4.0), buckets: int = BUCKETS) -> DataFrame:
    """As ``enrich`` on a stream: a row that fails waits in the stream's state and is asked again after each of ``delays`` seconds, meanwhile
    others go on; after the last it comes out with its error. A key that is waiting isn't asked twice.

    Keys are dealt out to ``buckets`` groups by hash: what a call of Python and a state cost is paid a group, not a row. A group holds those of its
    rows that wait; new ones pass through. State is part of the stream's checkpoint: a restart between attempts loses no row and repeats none that has come out.
    """
    schema, names = _schema(stream, keys, result)
    columns = schema.fieldNames()

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        #: by key: when to ask again (ms), the row, attempts made
        waiting: dict[str, tuple[float, dict, int]] = pickle.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs()
        asked = set(waiting)

        def ask(some: list[tuple[str, dict, int]]) -> Iterator[pd.DataFrame]:
            out = []
            for key, row, n in some:
                got = _asked(call, row, keys, names, n + 1)
                if got["error"] is None or n >= len(delays):
                    waiting.pop(key, None)
                    out.append([got[c] for c in columns])
                else:
                    waiting[key] = (1000 * (time.time() + delays[n]), row, n + 1)
            if out:
                yield pd.DataFrame(out, columns=columns, dtype=object)

        yield from ask([(key, row, n) for key, (due, row, n) in waiting.items() if due <= now])
        for batch in () if state.hasTimedOut else batches:
            new = []
            for row in batch["row"]:
                row = row if isinstance(row, dict) else row.asDict()
                key = repr([row[k] for k in keys])
                if key not in asked:
                    asked.add(key)
                    new.append((key, row, 0))
            yield from ask(new)
        if waiting:
            state.update((pickle.dumps(waiting),))
            # timers count from the micro-batch's time
            state.setTimeoutDuration(max(1, int(min(due for due, _, _ in waiting.values()) - now) + 1))
        elif state.exists:
            state.remove()

    # a struct keeps nulls and long integers as they are, columns of a frame would make floats of them
    bucket = F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)).alias("bucket")
    rows = stream.select(F.struct(*stream.columns).alias("row"), bucket)
    return rows.groupBy("bucket").applyInPandasWithState(step, schema, _WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout)


def enrich_available(stream: DataFrame, keys: list[str], call: Callable[[dict, int], dict], result: str, out: str, checkpoint: str, delays: tuple[float, ...] = (1.0, 2.0, 4.0), seconds: float = 3600.0, every: str = "1 second") -> DataFrame:
    """Runs ``enrich_stream`` into ``out`` until all that is available has come out, or ``seconds`` have gone by; what is in ``out``.
    Timers are looked at ``every`` so often.

    What waits then is asked by the next run. Rows with an error are the dead letters: ``dead_letters``.
    A restarted stream looks at its timers only after a first micro-batch, and without new rows there is none: each run
    therefore adds a file without rows to a second source.
    """
    spark = stream.sparkSession
    ticks = f"{checkpoint}/ticks"
    spark.createDataFrame([], stream.schema).coalesce(1).write.mode("append").parquet(ticks)
    tick = spark.readStream.schema(stream.schema).parquet(ticks)
    asked = enrich_stream(stream.unionByName(tick), keys, call, result, delays)
    query = asked.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime=every).start(out)
    end, first = time.monotonic() + seconds, None
    try:
        while time.monotonic() < end and query.isActive:
            last = query.lastProgress
            first = last["batchId"] if last and first is None else first
            # the first micro-batch may be one whose answers the sink has: it is passed over and tells of no state
            if last and last["batchId"] > first and not last["numInputRows"] and last["stateOperators"] and not last["stateOperators"][0]["numRowsTotal"]:
                break
            time.sleep(0.1)
        if query.exception():
            raise query.exception()
        # between two micro-batches, if that comes soon: one that is cut off asks again
        end = time.monotonic() + 5
        while time.monotonic() < end and query.status["isTriggerActive"]:
            time.sleep(0.02)
    finally:
        query.stop()
    return spark.read.schema(asked.schema).parquet(out)


def dead_letters(done: DataFrame) -> DataFrame:
    """The rows that were given up, with their last error and how often they were asked."""
    return done.where("error is not null")
