"""Transcript tables derived from the test tables, in Spark, and the same in DuckDB SQL.

The reference data is not public; these stand in for it, deterministic and growing with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scribespark.functions.batches import words_of

#: Speech models in their logical order.
MODELS = ("tiny", "base", "small", "medium", "large", "turbo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer pieces than cores out to all of them; larger tables are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_of(doc_id: str = "doc_id") -> Column:
    tens = F.col(doc_id) % 10
    return F.when(tens < 8, "train").when(tens == 8, "test").otherwise("validation")


SPLIT_SQL = "case when doc_id%10<8 then 'train' when doc_id%10=8 then 'test' else 'validation' end"


def models(spark: SparkSession) -> DataFrame:
    """The dimension of models: model, ordinal."""
    return spark.createDataFrame([(m, i) for i, m in enumerate(MODELS, 1)], "model string, ordinal int")


#: Words of an utterance.
UTTERANCE = 20


#: Words of documents or utterances that are put together at once.
WORDS_AT_ONCE = 100_000


def _kept(m: str, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a model hears of texts of n words each: for all of them in a row the words' places in their text, and how many a text."""
    of, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    again = {"medium": 4, "turbo": 1}.get(m, 0)
    first = np.minimum(n, again) * (2 if m == "turbo" else 1)
    if again:
        kept, size = np.concatenate([at, np.zeros(first.sum(), np.int64)]), n + first
        # a text's own words come after the repeated ones
        place = np.concatenate([np.repeat(first, n) + at, np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)])
        if m == "medium":
            kept[len(at) :] = place[len(at) :]
        texts = np.concatenate([of, np.repeat(np.arange(len(n)), first)])
        out = np.empty(len(kept), np.int64)
        out[(np.cumsum(size) - size)[texts] + place] = kept
        return out, size
    keep = (at + 1) % {"tiny": 3, "base": 5}[m] != 0 if m in ("tiny", "base") else np.ones(len(at), bool)
    return at[keep], np.bincount(of[keep], minlength=len(n))


def _said(words: pa.Array, n: np.ndarray) -> list[pa.Array]:
    """The texts of n words each, and what each model makes of them."""
    joined = lambda words, n: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), words), " ")
    texts, starts = joined(words, n), np.cumsum(n) - n
    out = [texts]
    for m in MODELS:
        if m in ("small", "large"):
            out.append(pc.utf8_lower(texts) if m == "small" else texts)
            continue
        kept, size = _kept(m, n)
        out.append(joined(words.take(pa.array(kept + np.repeat(starts, size))), size))
    return out


def _wide(docs: DataFrame, utterance: int | None) -> DataFrame:
    """doc_id, utterance, split, reference and a column a model: what six models make of each utterance of that many words, or of the whole text."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, utterance int, reference string, " + ", ".join(f"{m} string" for m in MODELS)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words, n = words_of(batch.column("text"))
            pieces = np.maximum(1, -(-n // utterance)) if utterance else np.ones(len(n), np.int64)
            of = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(utterance, n[of] - utterance * number) if utterance else n
            ends = np.cumsum(size)
            first = 0
            while first < len(of):
                begin = int(ends[first] - size[first])
                last = max(first + 1, int(np.searchsorted(ends, begin + WORDS_AT_ONCE, "right")))
                texts = _said(words.slice(begin, int(ends[last - 1]) - begin).cast(pa.string()), size[first:last])
                ids = batch.column("doc_id").take(pa.array(of[first:last]))
                columns = [ids, pa.array(number[first:last], pa.int32()), *texts]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                first = last

    said = docs.select("doc_id", "text").mapInArrow(cut, schema)
    lost = {"tiny": (11, None), "base": (13, "")}
    heard = [F.when(F.col("doc_id") % lost[m][0] == 0, F.lit(lost[m][1])).otherwise(F.col(m)).alias(m) if m in lost else m for m in MODELS]
    return said.select("doc_id", "utterance", split_of().alias("split"), "reference", *heard)


def _long(wide: DataFrame) -> DataFrame:
    number = F.create_map(*(F.lit(x) for i, m in enumerate(MODELS, 1) for x in (m, i)))
    rows = wide.unpivot(["doc_id", "utterance", "split", "reference"], list(MODELS), "model", "hypothesis")
    return rows.select("doc_id", "utterance", "split", "model", F.element_at(number, F.col("model")).alias("ordinal"), "reference", "hypothesis")


def _documents(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs) if chosen is None else docs.join(chosen, "doc_id", "left_semi")


def asr_long(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    """doc_id, utterance, split, model, ordinal, reference, hypothesis: six models' transcripts of each utterance.

    Every document is cut into utterances of UTTERANCE words each, the last with what is left: all words of
    all documents are in one. A document without words is one utterance without words. ``chosen`` (doc_id):
    of these documents only; the others' texts are not cut.
    """
    return _long(_wide(_documents(spark, sf_dir, chosen), UTTERANCE))


def asr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``asr_long``, a whole document at once: texts of any length."""
    return _long(_wide(_documents(spark, sf_dir), None)).drop("utterance")


def asr_sql(where: str = "true") -> str:
    """CTEs up to ``asr``, of the documents that meet a condition."""
    return f"""
 words0 as (select doc_id, {SPLIT_SQL} as split, list_filter(str_split_regex(coalesce(text,''),'\\s+'), lambda w: w<>'') as words from documents where {where}),
 starts0 as (select *, unnest(range(0, greatest(len(words),1), {UTTERANCE})) as i from words0),
 base0 as (select doc_id, split, cast(i//{UTTERANCE} as int) as utterance, words[i+1:i+{UTTERANCE}] as rw from starts0),
 models as (select * from (values ('tiny',1),('base',2),('small',3),('medium',4),('large',5),('turbo',6)) t(model,ordinal)),
 heard as (select doc_id, utterance, split, model, ordinal, rw, case model
   when 'tiny' then list_filter(rw, lambda w,i: i%3<>0) when 'base' then list_filter(rw, lambda w,i: i%5<>0)
   when 'small' then list_transform(rw, lambda w: lower(w)) when 'medium' then rw[1:4]||rw[1:4]||rw[5:]
   when 'large' then rw else rw[1:1]||rw[1:1]||rw end as hw from base0 cross join models),
 asr as (select doc_id, utterance, split, model, ordinal, array_to_string(rw,' ') as reference,
   case when model='tiny' and doc_id%11=0 then null when model='base' and doc_id%13=0 then ''
        else array_to_string(hw,' ') end as hypothesis from heard)"""


ASR_SQL = asr_sql()


def asr_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an utterance, a column whisper_<model>_transcription a model."""
    wide = _wide(_documents(spark, sf_dir), UTTERANCE)
    return wide.select("doc_id", "utterance", "split", "reference", *(F.col(m).alias(f"whisper_{m}_transcription") for m in MODELS))


def asr_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asr_long with the rows of every 17th document twice; ordinal_in tells the first."""
    # repeated on the way, so that no text is read and cut a second time
    times = F.when(F.col("doc_id") % 17 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return asr_long(spark, sf_dir).select("*", F.explode(times).alias("ordinal_in"))


DUPES_SQL = ASR_SQL + """, dupes as (select *, 1 as ordinal_in from asr union all select *, 2 as ordinal_in from asr where doc_id%17=0)"""

EVENT_MODELS = {"click": "tiny", "view": "base", "purchase": "small", "signup": "large"}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of a speech service, from events."""
    model = F.create_map(*(F.lit(x) for kv in EVENT_MODELS.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("finished_at"),
        F.concat(F.lit("replica_"), (F.col("user_id") % 40).cast("string")).alias("replica_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.try_element_at(model, "event_type").alias("model"),
        F.col("value").alias("inference_time_seconds"),
        F.get_json_object("props", "$.k").cast("double").alias("audio_duration"),
        F.length(F.when(F.col("event_type") != "error", F.concat(F.col("event_type"), F.lit(" heard by "), F.col("user_id").cast("string")))).alias("text_length"),
    ).withColumn("response_time", F.col("inference_time_seconds") + F.col("audio_duration") / 100)


LOG_SQL = """
 log as (select *, inference_time_seconds + audio_duration/100 as response_time from (
  select event_id as request_id, ts as finished_at, 'replica_'||cast(user_id%40 as varchar) as replica_id,
   case when event_type='error' then 'error' else 'success' end as status,
   case event_type when 'click' then 'tiny' when 'view' then 'base' when 'purchase' then 'small' when 'signup' then 'large' end as model,
   value as inference_time_seconds, cast(json_extract_string(props,'$.k') as double) as audio_duration,
   cast(length(case when event_type<>'error' then event_type||' heard by '||cast(user_id as varchar) end) as int) as text_length from events))"""


def gpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of four devices, from events."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 4).cast("int").alias("gpu_index"),
        F.floor(F.col("value") * 100).cast("long").alias("memory_used_mb"),
        F.lit(46000).cast("long").alias("memory_total_mb"),
        F.get_json_object("props", "$.k").cast("int").alias("gpu_utilization_percent"),
    )


GPU_SQL = """
 gpu as (select ts, cast(user_id%4 as int) as gpu_index, cast(floor(value*100) as bigint) as memory_used_mb,
   cast(46000 as bigint) as memory_total_mb, cast(json_extract_string(props,'$.k') as int) as gpu_utilization_percent from events)"""


def poly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a dynamic column in the shapes that results come in: raw JSON text, and as a variant."""
    n, m, kind = F.col("doc_id").cast("string"), (F.col("doc_id") % 50).cast("string"), F.col("doc_id") % 7
    raw = (
        F.when(kind == 1, "{}")
        .when(kind == 2, "[]")
        .when(kind == 3, F.concat(F.lit('{"text":"doc '), n, F.lit('","inference_time_seconds":'), m, F.lit(".25}")))
        .when(kind == 4, F.concat(F.lit('[{"text":"a","inference_time_seconds":'), m, F.lit('.5},{"text":"b"}]')))
        .when(kind == 5, F.concat(F.lit('"plain '), n, F.lit('"')))
        .when(kind == 6, '{"error":"timeout"}')
    )
    return table(spark, sf_dir, "documents").select("doc_id", split_of().alias("split"), raw.alias("raw")).withColumn("v", F.parse_json("raw"))


POLY_SQL = f"""
 poly as (select doc_id, {SPLIT_SQL} as split, doc_id%7 as kind, case doc_id%7 when 1 then '{{}}' when 2 then '[]'
   when 3 then '{{"text":"doc '||doc_id||'","inference_time_seconds":'||(doc_id%50)||'.25}}'
   when 4 then '[{{"text":"a","inference_time_seconds":'||(doc_id%50)||'.5}},{{"text":"b"}}]'
   when 5 then '"plain '||doc_id||'"' when 6 then '{{"error":"timeout"}}' end as raw from documents)"""


def audio_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and a sound: samples in -1..1, rate, path."""
    vector = F.col("embedding").cast("array<double>")
    path = F.format_string("0123456789abc%d.wav", "vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("array"), F.lit(16000).alias("sampling_rate"), path.alias("path"))
