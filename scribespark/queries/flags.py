"""Hallucination detectors and what is made of their flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribespark.functions import hallucination as hall
from scribespark.functions.let import with_once
from scribespark.functions.wer import quality_band
from scribespark.plans.fixtures import ASR_SQL, asr_documents, asr_long
from scribespark.queries.accuracy import tokens_sql, wer_sql
from scribespark.queries.registry import query


#: CTEs up to ``d``: asr with words, detectors and their texts.
D_SQL = (
    "with "
    + ASR_SQL
    + ","
    + wer_sql("basic")
    + f""",
 w0 as (select doc_id, utterance, split, model, reference, hypothesis, wer, coalesce({tokens_sql('hypothesis')},[]) as w, len({tokens_sql('reference')}) as nr,
   regexp_replace(coalesce(hypothesis,''),'^\\s+|\\s+$','','g') as s from scored),
 w1 as (select *, len(w) as nh, case when len(w)>0 and nr>0 then cast(len(w) as double)/nr end as ratio,
   list_min(list_filter(range(3, len(w)//2+1), lambda l: len(list_filter(range(0, len(w)-2*l+1), lambda i: w[i+1:i+l]=w[i+l+1:i+2*l]))>0)) as l0,
   list_min(list_filter(range(0, length(s)-10), lambda i: substring(s,cast(i+1 as int),5)=substring(s,cast(i+6 as int),5))) as c0,
   list_min(list_filter(range(0, len(w)-2), lambda i: w[i+1]=w[i+2] and w[i+2]=w[i+3])) as s0 from w0),
 w2 as (select *, case when l0 is not null then list_min(list_filter(range(0, nh-2*l0+1), lambda i: w[i+1:i+l0]=w[i+l0+1:i+2*l0])) end as i0 from w1),
 w3 as (select *, case when l0 is not null then list_min(list_filter(range(1, nh//l0+2), lambda k: w[i0+l0*k+1:i0+l0*k+l0]<>w[i0+1:i0+l0])) end as k0 from w2),
 d as (select doc_id, utterance, split, model, reference, hypothesis,
   l0 is not null as repetition, coalesce(ratio<0.5 or ratio>2.0,false) as length_anomaly,
   case when ratio<0.5 then 'too_short' when ratio>2.0 then 'too_long' end as length_type, c0 is not null as char_repetition,
   coalesce(wer>0.8 and ratio>1.5,false) as insertions, s0 is not null as stuttering,
   case when l0 is not null then 'Repeated phrase '''||array_to_string(w[i0+1:i0+l0],' ')||''' '||k0||' times' else '' end as repetition_info,
   case when ratio<0.5 then 'Too short: ' when ratio>2.0 then 'Too long: ' end || nh||' words vs '||nr||' words (ratio: '||format('{{:.2f}}',ratio)||')' as length_info,
   case when c0 is not null then 'Character repetition: '''||substring(s,cast(c0+1 as int),5)||''' repeated' else '' end as char_info,
   'High WER ('||format('{{:.2f}}',wer)||') with '||format('{{:.1f}}',ratio)||'x word count suggests insertions' as insertions_info,
   'Word stuttering: '''||w[s0+1]||''' repeated 3 times' as stuttering_info from w3)"""
)


def _one(spark: SparkSession, sf_dir: str, found: Column, **fields: str) -> DataFrame:
    rows = asr_long(spark, sf_dir).select("doc_id", "utterance", "model", found.alias("x"))
    return rows.select("doc_id", "utterance", "model", *(F.col(f"x.{k}").alias(v) for k, v in fields.items()))


@query(D_SQL + " select doc_id, utterance, model, repetition as detected, repetition_info as info from d")
def hall_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, hall.repetition(F.col("hypothesis")), detected="detected", info="info")


@query(D_SQL + " select doc_id, utterance, model, length_anomaly as detected, length_type as kind from d")
def hall_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, hall.length_anomaly(F.col("hypothesis"), F.col("reference")), detected="detected", type="kind")


@query(D_SQL + " select doc_id, utterance, model, char_repetition as detected, char_info as info from d")
def hall_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, hall.character_repetition(F.col("hypothesis")), detected="detected", info="info")


@query(D_SQL + " select doc_id, utterance, model, insertions as detected, case when insertions then insertions_info else '' end as info from d")
def hall_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, hall.insertions(F.col("hypothesis"), F.col("reference")), detected="detected", info="info")


@query(D_SQL + " select doc_id, utterance, model, stuttering as detected, case when stuttering then stuttering_info else '' end as info from d")
def hall_stutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, hall.stuttering(F.col("hypothesis")), detected="detected", info="info")


def flags(rows: DataFrame, *keys: str) -> DataFrame:
    rows = with_once(rows, "f", hall.hallucinations(F.col("hypothesis"), F.col("reference")))
    each = [F.col(f"f.{k}.detected").alias(k) for k in hall.DETECTORS]
    return rows.select(*keys, "split", "model", "reference", "hypothesis", hall.flagged("f").alias("has_hallucination"), *each, hall.summary_text("f").alias("info"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(asr_long(spark, sf_dir), "doc_id", "utterance")


_ANY = "(repetition or length_anomaly or char_repetition or insertions or stuttering)"


@query(D_SQL + f" select doc_id, utterance, model, {_ANY} as has_hallucination, repetition, length_anomaly, char_repetition, insertions, stuttering from d")
def hallucination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).drop("split", "reference", "hypothesis", "info")


@query(
    D_SQL
    + f""" select doc_id, utterance, split, reference, model, hypothesis, has_hallucination, repetition, length_anomaly, char_repetition, insertions, stuttering, info from (
 select *, true as has_hallucination, concat_ws('; ', case when repetition then 'Repetition: '||repetition_info end, case when length_anomaly then 'Length: '||length_info end,
  case when char_repetition then 'Char rep: '||char_info end, case when insertions then 'Insertions: '||insertions_info end, case when stuttering then 'Stuttering: '||stuttering_info end) as info
 from d where {_ANY})"""
)
def hallucination_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged pairs, with the rows they belong to: one pass, as flags and rows are worked out together."""
    return _flags(spark, sf_dir).where("has_hallucination")


@query(
    D_SQL
    + f""", g as (select model, count(*) as samples, count(*) filter (where {_ANY}) as flagged, round(100.0*count(*) filter (where {_ANY})/count(*),1) as rate_pct,
  count(*) filter (where repetition) as repetition, count(*) filter (where length_anomaly) as length_anomaly, count(*) filter (where char_repetition) as char_repetition,
  count(*) filter (where insertions) as insertions, count(*) filter (where stuttering) as stuttering from d group by model)
 select *, case when rate_pct<10 then 'excellent' when rate_pct<20 then 'good' when rate_pct<30 then 'fair' else 'poor' end as band from g"""
)
def hallucination_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(k).alias(k) for k in hall.DETECTORS]
    stats = _flags(spark, sf_dir).groupBy("model").agg(F.count("*").alias("samples"), F.count_if("has_hallucination").alias("flagged"), F.round(F.count_if("has_hallucination") * 100.0 / F.count("*"), 1).cast("double").alias("rate_pct"), *counts)
    return stats.withColumn("band", quality_band(F.col("rate_pct"), (10, 20, 30))).orderBy(F.desc("rate_pct"), "model")


@query()
def hallucination_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of whole documents, of any length; a test does it in Python."""
    return flags(asr_documents(spark, sf_dir), "doc_id").drop("split", "reference", "hypothesis")
