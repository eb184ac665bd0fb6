"""Dynamic JSON columns: text, times, what is missing, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribespark.functions import variant
from scribespark.operators import profile, report
from scribespark.plans.fixtures import POLY_SQL, poly_json
from scribespark.queries.registry import query


@query("with " + POLY_SQL + """ select doc_id, case kind when 0 then '' when 1 then '{}' when 2 then '' when 3 then 'doc '||doc_id when 4 then 'a b' when 5 then 'plain '||doc_id else raw end as text,
 case when kind=5 then 'plain '||doc_id end as media_path, case when kind=3 then 'doc '||doc_id end as text_field from poly""")
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return poly_json(spark, sf_dir).select("doc_id", variant.text_of(v).alias("text"), variant.media_path(v).alias("media_path"), F.try_variant_get(v, "$.text", "string").alias("text_field"))


@query("with " + POLY_SQL + " select doc_id, split from poly where kind in (0,1,2)")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poly_json(spark, sf_dir).where(variant.is_missing(F.col("v"))).select("doc_id", "split")


_TIME = "case kind when 3 then doc_id%50+0.25 when 4 then doc_id%50+0.5 end"


@query("with " + POLY_SQL + f", t as (select split, cast({_TIME} as double) as x from poly) select split, count(x) as n, round(avg(x),3) as mean, round(median(x),3) as median, round(min(x),3) as lo, round(max(x),3) as hi, round(sum(x),3) as total from t group by split")
def inference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times found in results, by split; a split without any has a count of 0 and nulls."""
    rows = poly_json(spark, sf_dir).select("split", F.explode_outer(variant.times_of(F.col("v"))).alias("x"))
    return report.time_stats(rows, "split", "x")


@query(
    "with " + POLY_SQL + """, c as (select count(*) as total, count(doc_id) as a, count(split) as b, count(raw) as r, count(*) filter (where kind=0) as nul, count(*) filter (where kind=1) as ed,
  count(*) filter (where kind=2) as el, count(*) filter (where kind in (1,3,6)) as di, count(*) filter (where kind in (2,4)) as li from poly),
 u as (select 'doc_id' as column_name, total, a as non_null, total-a as "null", 0 as empty_dict, 0 as empty_list, 0 as dict, 0 as list from c union all
  select 'split', total, b, total-b, 0, 0, 0, 0 from c union all select 'raw', total, r, total-r, 0, 0, 0, 0 from c union all
  select 'v', total, total-nul-ed-el, nul, ed, el, di, li from c)
 select column_name, total, non_null, "null", cast(empty_dict as bigint) as empty_dict, cast(empty_list as bigint) as empty_list, cast(dict as bigint) as dict, cast(list as bigint) as list, round(non_null*100.0/total,2) as non_null_pct from u"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(poly_json(spark, sf_dir))


_FILLED = {"whisper_tiny": "kind>2", "whisper_base": "kind>2 and doc_id%2=0", "whisper_small": "kind>2 and doc_id%3=0"}


@query(
    "with " + POLY_SQL + " union all ".join(f" select '{c}' as model_column, count(*) as total, count(*) filter (where {done}) as with_result, count(*) filter (where not ({done})) as without, round(count(*) filter (where {done})*100.0/count(*),2) as pct, cast(null as varchar) as error from poly" for c, done in _FILLED.items())
    + " union all select 'whisper_large', null, null, null, null, 'Column ''whisper_large'' does not exist in table'"
)
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each model's column of the wide table is filled; one that is asked for isn't there."""
    v, n = F.col("v"), F.col("doc_id")
    wide = poly_json(spark, sf_dir).select("doc_id", v.alias("whisper_tiny"), F.when(n % 2 == 0, v).alias("whisper_base"), F.when(n % 3 == 0, v).alias("whisper_small"))
    return profile.completion(wide, [*_FILLED, "whisper_large"])


@query("with " + POLY_SQL + """ select doc_id, case when kind in (1,3,4,6) then 'ok' else 'error' end as status, case when kind=2 then 'list without an object' when kind in (0,5) then 'not an object' end as error,
 case kind when 3 then 'doc '||doc_id when 4 then 'a' end as text, kind in (3,4) and doc_id%2=1 as mismatch from poly""")
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as objects or errors, and whether the text names another document than an even one."""
    rows = poly_json(spark, sf_dir).select("doc_id", variant.as_result(F.col("v")).alias("r"))
    text = F.try_variant_get("r.value", "$.text", "string")
    expected = F.when(F.col("doc_id") % 2 == 0, text)
    return rows.select("doc_id", F.when(F.col("r.error").isNull(), "ok").otherwise("error").alias("status"), "r.error", text.alias("text"), (text.isNotNull() & ~expected.eqNullSafe(text)).alias("mismatch"))
