"""Word error rates: tokens, methods, models side by side, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribespark.functions import text, wer
from scribespark.functions.let import with_once
from scribespark.operators import align, report, reshape
from scribespark.operators.order import numbered
from scribespark.plans.fixtures import ASR_SQL, DUPES_SQL, MODELS, asr_documents, asr_dupes, asr_long, asr_sql, asr_wide, models, table
from scribespark.queries.registry import query
from scribespark.sources import files


def tokens_sql(expression: str) -> str:
    return f"list_filter(str_split_regex({expression},'\\s+'), lambda w: w<>'')"


PUNCT_SQL = r"'[!-/:-@\[-`{-~]'"
CLEAN_SQL = {
    "basic": lambda x: x,
    "ignore_punctuation": lambda x: f"regexp_replace({x},{PUNCT_SQL},'','g')",
    "normalized": lambda x: f"regexp_replace(lower({x}),'\\p{{P}}','','g')",
}


def wer_sql(method: str, source: str = "asr", out: str = "scored") -> str:
    """CTEs that add ``wer`` to the rows of ``source``; words are written as bytes from 65 on."""
    clean, t = CLEAN_SQL[method], tokens_sql
    code = lambda words: f"array_to_string(list_transform({words}, lambda x: chr(cast(64+list_position(v,x) as int))),'')"
    return f"""
 {out}_t as (select *, {t('reference')} as r0, {t('hypothesis')} as h0, {t(clean('reference'))} as rt, {t(clean('hypothesis'))} as ht from {source}),
 {out}_v as (select *, list_distinct(rt||ht) as v,
   coalesce(len(r0)>0 and len(h0)>0 and r0<>['nan'] and h0<>['nan'] and len(rt)>0, false) as ok from {out}_t),
 {out} as (select * exclude (r0,h0,v,ok), case when ok then cast(levenshtein({code('rt')},{code('ht')}) as double)/len(rt) end as wer from {out}_v)"""


SCORED_SQL = "with " + ASR_SQL + "," + wer_sql("basic")


def scored(spark: SparkSession, sf_dir: str, method: str = "basic") -> DataFrame:
    return asr_long(spark, sf_dir).withColumn("wer", wer.wer("reference", "hypothesis", method))


def percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("model", (F.col("wer") * 100).alias("wer"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query(f"select doc_id, cast(len(w) as int) as n_words, w[1] as first_word, w[len(w)] as last_word from (select doc_id, {tokens_sql('text')} as w from documents)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word"))


@query(
    f"""select doc_id, md5(array_to_string({tokens_sql(CLEAN_SQL['ignore_punctuation']('text'))},' ')) as no_punctuation,
 md5(array_to_string({tokens_sql(CLEAN_SQL['normalized']('text'))},' ')) as normalized from documents"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.without_punctuation("text")).alias("no_punctuation"), F.md5(text.normalized("text")).alias("normalized"))


def _pairs(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return rounded(scored(spark, sf_dir, method).select("doc_id", "utterance", "model", "wer"), "wer")


def _pairs_sql(method: str) -> str:
    return "with " + ASR_SQL + "," + wer_sql(method) + " select doc_id, utterance, model, round(wer,6) as wer from scored"


@query(_pairs_sql("basic"))
def wer_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "basic")


@query(_pairs_sql("ignore_punctuation"))
def wer_nopunct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "ignore_punctuation")


@query(_pairs_sql("normalized"))
def wer_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "normalized")


@query(SCORED_SQL + " select doc_id, utterance, model, cast(levenshtein_words as int) as edits, cast(len(rt)-len(ht) as int) as deletions_less_insertions from (select *, round(wer*len(rt)) as levenshtein_words from scored where wer is not null)")
def wer_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, deletions and insertions depend on ties; what doesn't is compared with SQL."""
    pairs = asr_long(spark, sf_dir).where(~wer.missing("reference") & ~wer.missing("hypothesis"))
    e = wer.edits(F.col("reference"), F.col("hypothesis"), texts=True)
    found = pairs.select("doc_id", "utterance", "model", e.alias("e"))
    return found.select("doc_id", "utterance", "model", (F.col("e.s") + F.col("e.d") + F.col("e.i")).alias("edits"), (F.col("e.d") - F.col("e.i")).alias("deletions_less_insertions"))


_METHODS_SQL = ",".join(wer_sql(m, out=f"s_{m}") for m in CLEAN_SQL)
_PCT_SQL = "round(wer*100,6) as pct, case when wer is null then 'N/A' else printf('%.1f%%', wer*100) end as pct_text, wer is not null as has_score"
_UNION = " union all ".join(f"select doc_id, utterance, model, '{m}' as method, '{wer.METHODS[m]}' as label, wer from s_{m}" for m in CLEAN_SQL)


def by_method(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each method: method, label, wer and its text."""
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(wer.METHODS[m]).alias("label"), F.col(f"w.{m}").alias("wer")) for m in wer.METHODS))
    out = rows.select(*keys, wer.wers("reference", "hypothesis").alias("w")).select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
    return out.withColumns({"pct": F.round(F.col("wer") * 100, 6), "pct_text": wer.percent_label(F.col("wer")), "has_score": F.col("wer").isNotNull()}).drop("wer")


@query("with " + ASR_SQL + "," + _METHODS_SQL + f" select doc_id, utterance, model, method, label, {_PCT_SQL} from ({_UNION})")
def wer_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_method(asr_long(spark, sf_dir), "doc_id", "utterance", "model")


_COMPARED_SQL = _METHODS_SQL + f" select u.doc_id, u.utterance, u.model, method, label, {_PCT_SQL}, reference, hypothesis from ({_UNION}) u join asr a on a.doc_id=u.doc_id and a.utterance=u.utterance and a.model=u.model"


@query("with " + asr_sql("doc_id=42") + "," + _COMPARED_SQL)
def compare_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models and methods for one document, by id."""
    return _compared(spark, sf_dir, 42)


@query("with " + asr_sql("doc_id=(select doc_id from documents order by md5('0|'||doc_id), doc_id limit 1)") + "," + _COMPARED_SQL)
def compare_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``compare_sample``, asked for an id that isn't there: a random document stands in."""
    return _compared(spark, sf_dir, -1)


def _compared(spark: SparkSession, sf_dir: str, doc_id: int) -> DataFrame:
    chosen = sample_of(table(spark, sf_dir, "documents"), "doc_id", doc_id)
    return by_method(asr_long(spark, sf_dir, chosen), "doc_id", "utterance", "model", "reference", "hypothesis")


def sample_of(rows: DataFrame, key: str, wanted: object = None, seed: int = 0) -> DataFrame:
    """One row with a key: the wanted one, else, or where there is none such, a random one, the same for the same seed."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return rows.agg(F.min(F.struct((~F.col(key).eqNullSafe(F.lit(wanted))).alias("other"), draw.alias("draw"), F.col(key).alias(key))).alias("x")).select(f"x.{key}")


@query(SCORED_SQL + ", l as (select case when doc_id%19=0 then null else cast(doc_id as varchar) end as id, row_number() over (order by ordinal, doc_id, utterance)-1 as pos, utterance, split, model, round(wer*100,6) as pct from scored where wer is not null) select coalesce(id, 'unknown_'||pos) as id, utterance, split, model, pct from l")
def wer_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long percentages without undefined ones, from the wide table; rows without an id are named by their place.

    Every 19th document stands for those that have none.
    """
    wide = asr_wide(spark, sf_dir)
    long = reshape.melt(wide, ["doc_id", "utterance", "split", "reference"], reshape.model_columns(wide), "column_name", "hypothesis")
    name = F.lower(reshape.display_name(F.col("column_name")))
    rate = F.round(wer.wer("reference", "hypothesis") * 100, 6)
    rated = with_once(long.withColumn("model", name), "pct", rate).select("doc_id", "utterance", "split", "model", "pct")
    # written, as dealing rows out by ranges reads them twice
    kept = files.snapshot(rated.where("pct is not null"), f"{files.shared_dir(spark)}/rated-{uuid.uuid4().hex}")
    scored = kept.join(F.broadcast(models(spark)), "model")
    placed = numbered(scored, ["ordinal", "doc_id", "utterance"], "at")
    known = F.when(F.col("doc_id") % 19 != 0, F.col("doc_id").cast("string"))
    return placed.select(F.coalesce(known, F.format_string("unknown_%d", "at")).alias("id"), "utterance", "split", "model", "pct")


@query(
    "with " + ASR_SQL + """ select a.doc_id, a.utterance, upper(m.model[1])||m.model[2:] as label, m.ordinal, a.hypothesis from asr a join models m on a.model=m.model"""
)
def melt_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = asr_wide(spark, sf_dir)
    long = reshape.melt(wide, ["doc_id", "utterance"], reshape.model_columns(wide), "column_name", "hypothesis")
    labels = models(spark).select(F.concat(F.lit("whisper_"), "model", F.lit("_transcription")).alias("column_name"), "ordinal")
    return long.join(F.broadcast(labels), "column_name").select("doc_id", "utterance", reshape.display_name(F.col("column_name")).alias("label"), "ordinal", "hypothesis")


_SUMMARY = """ select model, count(*) as n, round(avg(p),6) as mean, round(stddev_samp(p),6) as std, round(min(p),6) as lo, round(max(p),6) as hi, round(median(p),6) as median,
 round(least(120, max(p)+10),6) as axis_cap, format('Avg: {:.3f}', avg(p)) as label, case when avg(p)<15 then 'excellent' when avg(p)<25 then 'good' when avg(p)<35 then 'fair' else 'poor' end as band
 from (select model, wer*100 as p from scored where wer is not null) group by model"""


@query(SCORED_SQL + _SUMMARY)
def wer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.summary(percents(spark, sf_dir)), "mean", "std", "lo", "hi", "median", "axis_cap")


@query(
    SCORED_SQL
    + """ select model, count(*) as n, round(avg(p),6) as mean, round(stddev_samp(p),6) as std, round(min(p),6) as lo, round(quantile_cont(p,0.25),6) as q25,
 round(quantile_cont(p,0.5),6) as q50, round(quantile_cont(p,0.75),6) as q75, round(max(p),6) as hi from (select model, wer*100 as p from scored where wer is not null) group by model"""
)
def wer_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.describe(percents(spark, sf_dir)), "mean", "std", "lo", "q25", "q50", "q75", "hi")


@query(
    SCORED_SQL
    + """, x as (select model, wer*100 as p from scored where wer is not null),
 e as (select model, count(*) as n, case when min(p)=max(p) then min(p)-0.5 else min(p) end as a, case when min(p)=max(p) then max(p)+0.5 else max(p) end as b from x group by model),
 w as (select *, (b-a)/15 as width from e),
 c as (select x.model, cast(least(floor((p-a)/width),14) as int) as bin, n, a, width, count(*) as in_bin from x join w using (model) group by all)
 select model, bin, round(a+bin*width,6) as left_edge, in_bin, round(in_bin/(n*width),6) as density from c"""
)
def wer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.histogram(percents(spark, sf_dir)), "left_edge", "density")


@query(
    SCORED_SQL
    + """, x as (select model, wer*100 as p from scored where wer is not null),
 q as (select model, quantile_cont(p,0.25) as q1, quantile_cont(p,0.5) as q2, quantile_cont(p,0.75) as q3 from x group by model)
 select model, round(q1,6) as q1, round(q2,6) as q2, round(q3,6) as q3, round(min(p) filter (where i),6) as whisker_low, round(max(p) filter (where i),6) as whisker_high,
  count(*) filter (where not i) as outliers from (select x.*, q1,q2,q3, p between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) as i from x join q using (model)) group by model,q1,q2,q3"""
)
def wer_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.boxplot(percents(spark, sf_dir)), "q1", "q2", "q3", "whisker_low", "whisker_high")


@query("with " + DUPES_SQL + "," + wer_sql("basic", "dupes") + " select doc_id, " + ", ".join(f"round(avg(wer*100) filter (where model='{m}'),6) as {m}" for m in MODELS) + " from scored group by doc_id")
def wer_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, a column a model, means over repeated rows; worst for the first model first."""
    rows = asr_dupes(spark, sf_dir).select("doc_id", "model", (wer.wer("reference", "hypothesis") * 100).alias("pct"))
    cells = reshape.pivoted(rows, ["doc_id"], "model", list(MODELS), F.round(F.avg("pct"), 6))
    return cells.orderBy(F.desc_nulls_last("tiny"), "doc_id")


@query("with " + DUPES_SQL + " select count(*) as rows, count(distinct (doc_id, utterance, model)) as kept, count(*) - count(distinct (doc_id, utterance, model)) as duplicates from dupes")
def dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.duplicates(asr_dupes(spark, sf_dir), ["doc_id", "utterance", "model"])


@query("with " + DUPES_SQL + " select doc_id, utterance, split, reference, ordinal_in from (select *, row_number() over (partition by doc_id, utterance order by ordinal_in, ordinal) as p from dupes) where p=1")
def dedupe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.keep_first(asr_dupes(spark, sf_dir), ["doc_id", "utterance"], F.col("ordinal_in"), F.col("ordinal")).select("doc_id", "utterance", "split", "reference", "ordinal_in")


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by model and class of difference; classes depend on the matcher, so SQL can't say it."""
    ops = align.opcodes(asr_long(spark, sf_dir).where("hypothesis is not null"), "model")
    return align.diff_counts(ops, "model")


@query()
def wer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate and edit counts of whole documents, of any length: SQL has no fitting form, a test does it in Python."""
    pairs = asr_documents(spark, sf_dir)
    e = wer.edits(F.col("reference"), F.col("hypothesis"), texts=True)
    known = ~wer.missing("reference") & ~wer.missing("hypothesis")
    found = pairs.select("doc_id", "model", F.when(known, e).alias("e"))
    rate = F.round(F.try_divide(F.col("e.cost"), F.col("e.n")), 6)
    return found.select("doc_id", "model", rate.alias("wer"), F.col("e.s").alias("substitutions"), F.col("e.d").alias("deletions"), F.col("e.i").alias("insertions"))
