"""Loading, updating and describing the corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribespark.functions import values
from scribespark.operators import ingest
from scribespark.operators.order import numbered
from scribespark.plans.fixtures import SPLIT_SQL, audio_arrays, split_of, table
from scribespark.queries.registry import query
from scribespark.sources import audio, files, replica, tree


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", split_of())


@query("select 'doc_'||doc_id||'.wav' as filename, md5(text) as transcription_md5 from documents")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as CSV, more rows appended, and read again."""
    rows = table(spark, sf_dir, "documents").select(F.format_string("doc_%d.wav", "doc_id").alias("filename"), F.col("text").alias("transcription"), "doc_id")
    path = _folder(spark, "csv")
    files.write_csv(rows.where("doc_id % 2 = 0").drop("doc_id"), path)
    files.write_csv(rows.where("doc_id % 2 = 1").drop("doc_id"), path, mode="append")
    return files.read_csv(spark, path, "filename string, transcription string").select("filename", F.md5("transcription").alias("transcription_md5"))


@query(f"select doc_id, split, 'train_corpus' as corpus from (select doc_id, {SPLIT_SQL} as split from documents) where split='train'")
def import_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "splits")
    files.write_splits(docs(spark, sf_dir).select("doc_id", "split"), path)
    return files.read_split(spark, path, "train").select("doc_id", "split", F.lit("train_corpus").alias("corpus"))


@query(f"select doc_id, split, lang, n_chars, md5(text) as text_md5 from (select *, {SPLIT_SQL} as split from documents)")
def loaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace and a table made where they aren't, filled by two inserts, found by the default name and kept as a snapshot; then
    the namespace is dropped with all that is in it."""
    rows = docs(spark, sf_dir).select("doc_id", "split", "lang", "n_chars", F.md5("text").alias("text_md5"))
    space = f"asr_{uuid.uuid4().hex}"
    name, folder = f"{space}.transcripts", _folder(spark, "namespace")
    try:
        for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
            # the second run finds both there and leaves them as they are
            files.create_table(spark, name, ", ".join(f"{c} {t}" for c, t in rows.dtypes), folder)
            files.insert(rows.where(part), name)
        return files.snapshot(files.get_table(spark, default=name), _folder(spark, "snapshot"))
    finally:
        files.drop_namespace(spark, space)


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def ingest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't among the loaded (labelled) ones, appended to what is there in two steps."""
    found = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path, loaded = _folder(spark, "ingested"), table(spark, sf_dir, "labels").select("doc_id")
    files.append(ingest.new_rows(found.where("doc_id % 2 = 0"), loaded, "doc_id"), path)
    # the second run meets the first one's rows again and skips what it has put out
    done = files.append(found.limit(0), path)
    return files.append(ingest.new_rows(ingest.new_rows(found, loaded, "doc_id"), done, "doc_id"), path)


@query("select doc_id, lang, n_chars from documents where doc_id%11<>0")
def replica_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica that lacks rows, has changed ones and some that its source has removed catches up, by way of a published copy."""
    source = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").where("doc_id % 11 <> 0")
    copy, path = _folder(spark, "copy"), _folder(spark, "replica")
    stale = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))
    replica.publish(stale, path, "doc_id", "documents")
    replica.publish(source, copy, "doc_id", "documents")
    return replica.pull(copy, path, "doc_id", source.schema, spark)


@query("select doc_id, case when doc_id%11=0 then 'removed' when doc_id%3=0 then 'new' else 'changed' end as kind from documents where case when doc_id%11=0 then doc_id%3<>0 else doc_id%3=0 or (doc_id%5=0 and n_chars<>0) end")
def replica_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which rows a stale replica differs from its source."""
    source = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").where("doc_id % 11 <> 0")
    stale = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))
    return replica.changes(source, stale, "doc_id")


@query("select 'sample_'||lpad(cast(doc_id as varchar),cast(greatest(3,len(cast(doc_id as varchar))) as int),'0') as id, md5('This is sample transcription '||doc_id||': '||coalesce(text,'')) as transcription_md5 from documents")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A demo row for each document, from its id and text."""
    rows = files.sample_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("id", F.md5("transcription").alias("transcription_md5"))


@query(f"select split||'_'||lpad(cast(row_number() over (partition by split order by doc_id)-1 as varchar),6,'0') as id, 'clips/'||doc_id||'.wav' as wav_file, 16000 as sample_rate, n_chars from (select *, {SPLIT_SQL} as split from documents)")
def clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of clips as it is written: ids that count within each split."""
    rows = numbered(docs(spark, sf_dir).select("split", "doc_id", "n_chars"), ["doc_id"], "at", ("split",))
    clips = rows.select(F.format_string("%s_%06d", "split", "at").alias("id"), F.format_string("clips/%d.wav", "doc_id").alias("wav_file"), F.lit(16000).alias("sample_rate"), "n_chars")
    path = _folder(spark, "manifest")
    files.write_csv(clips, path)
    return files.read_csv(spark, path, clips.schema)


@query("select doc_id, md5(text) as text_md5, lang from documents")
def select_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("select doc_id as id, upper(lang) as language, n_chars, length(text) as n_points, 'train_data/'||doc_id||'.wav' as audio from documents")
def computed_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed columns that exist stay as they are; one is renamed, one rewritten from another."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    rows = ingest.add_computed(rows, {"n_points": F.length("text"), "n_chars": F.lit(0).cast("long"), "path": F.format_string("%d.wav", "doc_id")})
    rows = rows.withColumnsRenamed({"doc_id": "id", "path": "audio"}).withColumn("audio", F.concat(F.lit("train_data/"), "audio"))
    return rows.select("id", F.upper("lang").alias("language"), "n_chars", "n_points", "audio")


@query("select doc_id, lang, cast(null as varchar) as whisper_tiny, cast(null as varchar) as whisper_base from documents")
def ensure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ingest.ensure_columns(rows, {"whisper_tiny": "string", "whisper_base": "string", "lang": "string"})


def _steps() -> list[ingest.Step]:
    return [
        ("id", lambda c: "id" not in c, lambda d: d.withColumn("id", values.id_from_path(F.col("split"), F.col("audio")))),
        ("sentence", lambda c: "sentence" in c, lambda d: d.withColumnRenamed("sentence", "transcription")),
        ("filePath", lambda c: "filePath" not in c, lambda d: d.withColumn("filePath", F.concat(F.lit("data/"), values.base_name(F.col("audio"))))),
    ]


@query(f"select split||'_'||doc_id||'.wav' as id, md5(text) as transcription, 'data/0123456789abc'||doc_id||'.wav' as \"filePath\" from (select *, {SPLIT_SQL} as split from documents)")
def migrate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw import brought to the table's columns; run twice, as a rerun must change nothing."""
    raw = docs(spark, sf_dir).select("split", F.md5("text").alias("sentence"), F.format_string("0123456789abc%d.wav", "doc_id").alias("audio"))
    return ingest.migrate(ingest.migrate(raw, _steps()), _steps()).select("id", "transcription", "filePath")


@query(f"select doc_id, 'train_data/f'||doc_id||'.wav' as file_path, split||'_'||doc_id||'.wav' as id, doc_id||'.wav' as name, '/mnt/audio/'||doc_id||'.wav' as container_path, case when doc_id%2=0 then '/abs/'||doc_id||'.wav' else '/base/rel/'||doc_id||'.wav' end as resolved from (select *, {SPLIT_SQL} as split from documents)")
def derive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("given", F.when(F.col("doc_id") % 2 == 0, F.format_string("/abs/%d.wav", "doc_id")).otherwise(F.format_string("rel/%d.wav", "doc_id")))
    raw = F.format_string("0123456789abc%d.wav", "doc_id")
    name = values.base_name(F.col("given"))
    return d.select("doc_id", F.concat(F.lit("train_data/"), F.format_string("f%d.wav", "doc_id")).alias("file_path"), values.id_from_path(F.col("split"), raw).alias("id"), name.alias("name"), F.concat(F.lit("/mnt/audio/"), name).alias("container_path"), values.resolved(F.col("given"), "/base").alias("resolved"))


@query("select doc_id, case doc_id%5 when 0 then 'tiny' when 1 then 'large-v3' when 2 then 'tiny' when 3 then 'medium' else 'base' end as model from documents")
def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = F.array(*(F.lit(x) for x in ("whisper_tiny", "whisper_turbo", "tiny_rep4", "whisper_medium", "something_else")))
    return table(spark, sf_dir, "documents").select("doc_id", values.model_name(F.get(columns, (F.col("doc_id") % 5).cast("int"))).alias("model"))


@query(f"select doc_id, split from (select *, {SPLIT_SQL} as split from documents) where split='test' and coalesce(regexp_matches(text,'(?i)licen[cs]e|the and'),false)")
def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(docs(spark, sf_dir).where("split = 'test'"), "text", "licen[cs]e|the and").select("doc_id", "split")


def search(rows: DataFrame, column: str, term: str, literal: bool = False) -> DataFrame:
    """Rows whose text holds the term, whatever its case: a regular expression unless ``literal``; null doesn't."""
    text = F.col(column)
    found = F.contains(F.lower(text), F.lower(F.lit(term))) if literal else text.rlike(f"(?i){term}")
    return rows.where(F.coalesce(found, F.lit(False)))


_FILES = "select doc_id, 'dir.x/f'||doc_id||(case doc_id%4 when 0 then '.WAV' when 1 then '.txt' when 2 then '.mp3' else '' end) as path from documents"


@query(f"select doc_id, path, case doc_id%4 when 0 then 'audio' when 1 then 'text' when 2 then 'audio' else 'other' end as kind, doc_id%4 in (0,2) as is_audio_type from ({_FILES})")
def classify_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*(F.lit(x) for x in (".WAV", ".txt", ".mp3", "")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("dir.x/f"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 4).cast("int"))).alias("path"))
    ext = values.extension(F.col("path"))
    kind = F.when(ext.isin(*values.AUDIO_EXTENSIONS), "audio").when(ext == ".txt", "text").otherwise("other")
    content_type = F.concat(F.col("kind"), F.lit("/x"))
    return rows.withColumn("kind", kind).withColumn("is_audio_type", content_type.startswith("audio"))


@query("select source, count(*) as n, (select count(*) from (select distinct 'src'||(doc_id%25) as s from documents) where s not in (select source from documents where source is not null)) as unknown from documents where source in (select 'src'||(doc_id%25) from documents where doc_id%2=0) group by source")
def only_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the sources asked for, and how many names asked for are unknown."""
    d = table(spark, sf_dir, "documents")
    asked = d.select(F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string")).alias("source"), "doc_id")
    chosen = d.join(asked.where("doc_id % 2 = 0").select("source").distinct(), "source", "left_semi")
    unknown = ingest.unknown_names(asked, d, "source").agg(F.count("*").alias("unknown"))
    return chosen.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(unknown))


_UPSERT = """select d.doc_id, coalesce(l.quality, case when d.doc_id%3=0 then 9 end) as quality, d.n_chars from documents d left join labels l using (doc_id)"""


@query(_UPSERT)
def batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written over a column, each after an older value that must lose."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 9).alias("quality"), "n_chars")
    return ingest.upsert(base, label_updates(spark, sf_dir), "doc_id", ["quality"], "seq")


def label_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three updates for each label: a wrong one, then the right one, then none, which changes nothing."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    wrong = labels.select("doc_id", F.lit(5).alias("quality"), F.lit(1).alias("seq"))
    none = labels.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(3).alias("seq"))
    return wrong.unionByName(labels.withColumn("seq", F.lit(2))).unionByName(none)


@query("""select doc_id, case when doc_id%3=0 then 'a/X'||doc_id||'.srt' when doc_id%3=1 then 'b/x'||doc_id||'.txt' end as transcript, case when doc_id%4=0 then 'raw/x'||doc_id||'.wav' when doc_id%4=1 then 'raw/x'||doc_id||'.flac' end as original from documents""")
def match_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio files with their transcripts (by stem, any case, else the plain .txt) and originals (by extension)."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    name = F.col("doc_id").cast("string")
    wavs = ids.select("doc_id", F.concat(F.lit("x"), name).alias("stem"))

    def found(condition: str, path: DataFrame, priority: int) -> DataFrame:
        return ids.where(condition).select(path.alias("path"), F.lit(priority).alias("priority")).withColumn("stem", F.lower(values.stem(F.col("path"))))

    by_pattern = found("doc_id % 3 = 0", F.concat(F.lit("a/X"), name, F.lit(".srt")), 0).unionByName(found("doc_id % 6 = 0", F.concat(F.lit("a/X"), name, F.lit(".vtt")), 1))
    plain = found("doc_id % 3 < 2", F.concat(F.lit("b/x"), name, F.lit(".txt")), 0)
    raw = found("doc_id % 4 = 0", F.concat(F.lit("raw/x"), name, F.lit(".wav")), 0).unionByName(found("doc_id % 4 < 2", F.concat(F.lit("raw/x"), name, F.lit(".flac")), 3))
    out = ingest.match_by_priority(wavs, by_pattern, "stem", "priority", "path", "first")
    out = ingest.match_by_priority(out, plain, "stem", "priority", "path", "plain")
    out = ingest.match_by_priority(out, raw, "stem", "priority", "path", "original")
    return out.select("doc_id", F.coalesce("first", "plain").alias("transcript"), "original")


@query(f"with d as (select {SPLIT_SQL} as split from documents) select s.split, count(d.split) as n, (select count(*) from d) as total from (values ('train'),('test'),('validation'),('dev')) s(split) left join d on d.split=s.split group by s.split")
def split_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    names = spark.createDataFrame([(x,) for x in ("train", "test", "validation", "dev")], "split string")
    counts = d.groupBy("split").agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))


@query(
    f"""with p as (select doc_id, {SPLIT_SQL} as split from documents where doc_id not in (select doc_id from labels)),
 b as (select split, cast(floor((row_number() over (partition by split order by doc_id)-1)/100) as int) as batch from p),
 c as (select split, batch, count(*) as rows from b group by split, batch)
 select split, batch, rows, cast(sum(rows) over (partition by split order by batch) as bigint) as done_after, cast(sum(rows) over (partition by split) - sum(rows) over (partition by split order by batch) as bigint) as remaining_after from c"""
)
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.new_rows(docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")
    return ingest.batches(rows, "doc_id", 100, "split")


@query("select doc_id, lang, part from (select *, 'first' as part from (select doc_id, lang from documents order by doc_id limit 100) union all select *, 'slice' from (select doc_id, lang from documents order by doc_id limit 2000 offset 500))")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a limit: the first rows, and a slice."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.orderBy("doc_id").limit(100).withColumn("part", F.lit("first")).unionByName(d.orderBy("doc_id").offset(500).limit(2000).withColumn("part", F.lit("slice")))


@query("select 'docs' as dataset, cast(doc_id as varchar) as id, n_chars as size, lang from documents union all select 'pages', cast(page_id as varchar), cast(null as bigint), cast(null as varchar) from pages")
def master_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "documents").select(F.lit("docs").alias("dataset"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("size"), "lang")
    two = table(spark, sf_dir, "pages").select(F.lit("pages").alias("dataset"), F.col("page_id").cast("string").alias("id"))
    return ingest.union_manifests(one, two)


@query("select doc_id, code from (select doc_id, case doc_id%6 when 0 then 'en' when 1 then 'de' when 2 then 'fr' when 3 then null when 4 then 'klingon' else 'pt' end as code from documents)")
def normalize_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(*(F.lit(x) for x in ("English", " GERMAN ", "FR", "", "Klingon", "portuguese")))
    return table(spark, sf_dir, "documents").select("doc_id", values.language_code(F.get(given, (F.col("doc_id") % 6).cast("int"))).alias("code"))


@query("select vec_id, array_to_string(list_transform(embedding, lambda x: cast(trunc(least(1.0::double,greatest(-1.0::double,cast(x as double)))*32767) as int)),',') as pcm, len(embedding)*2 as stereo_samples from embeddings")
def pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono = values.pcm16(F.col("array"))
    return audio_arrays(spark, sf_dir).select("vec_id", F.array_join(mono.cast("array<string>"), ",").alias("pcm"), F.size(values.interleaved([mono, mono])).cast("long").alias("stereo_samples"))


@query("select vec_id, 16000 as sample_rate, 1 as channels, round(len(embedding)/16000.0,3) as duration_sec, 44+2*len(embedding) as size from embeddings")
def wav_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds encoded as WAV files in a binary column, stored, and described from their headers."""
    rows = audio_arrays(spark, sf_dir).select("vec_id", audio.wav_bytes(values.pcm16(F.col("array")), "sampling_rate", F.lit(1)).alias("content"))
    stored = files.snapshot(rows, _folder(spark, "wav"))
    return stored.select("vec_id", audio.header(F.col("content")).alias("h"), F.length("content").cast("long").alias("size")).select("vec_id", "h.*", "size")


def _write_corpus(sounds: DataFrame, folder: str) -> DataFrame:
    """Writes a WAV, and for some a transcript and an original, for each sound, in folders below ``folder``; vec_id of those written."""
    rows = sounds.select("vec_id", audio.wav_bytes(values.pcm16(F.col("array")), "sampling_rate", F.lit(1)).alias("wav"), F.element_at("array", 1).cast("string").alias("said"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)

        def put(name: str, content: bytes) -> None:
            system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(content)

        for batch in batches:
            for k, wav, said in zip(*(c.to_pylist() for c in batch.columns)):
                put(f"wav/{k % 10}/x{k}.wav", wav)
                if k % 3 == 0:
                    put(f"text/a/X{k}.srt", f" {said}\n".encode())
                if k % 3 < 2:
                    put(f"text/b/x{k}.txt", f"plain {k}".encode())
                for ending in [".flac"] * (k % 4 < 2) + [".mp3"] * (k % 4 == 0):
                    put(f"raw/x{k}{ending}", b"")
            yield batch.select(["vec_id"])

    return rows.mapInArrow(write, "vec_id long")


@query(
    """select 'corpus' as dataset, 'x'||vec_id as id, 'wav/'||(vec_id%10)||'/x'||vec_id||'.wav' as wav_file, case when vec_id%4=0 then 'raw/x'||vec_id||'.mp3' when vec_id%4=1 then 'raw/x'||vec_id||'.flac' else '' end as orig_audio,
 16000 as sample_rate, 1 as channels, round(len(embedding)/16000.0,3) as duration_sec, case when vec_id%3=0 then 'srt' when vec_id%3=1 then 'plain '||vec_id else '' end as transcript,
 case when vec_id%3=0 then 'text/a/X'||vec_id||'.srt' when vec_id%3=1 then 'text/b/x'||vec_id||'.txt' else '' end as transcript_file from embeddings"""
)
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of sounds written as WAV files with sidecars and originals, rebuilt from disk in two runs.

    The second run meets the first one's manifest again and takes up only what has been written since.
    """
    folder = _folder(spark, "corpus")
    folder = folder if "://" in folder else f"file://{folder}"
    sounds = audio_arrays(spark, sf_dir)
    older = None
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1"):
        _write_corpus(sounds.where(part), folder).write.format("noop").mode("overwrite").save()
        found = tree.manifest_from_disk(spark, "corpus", f"{folder}/wav", f"{folder}/text", f"{folder}/raw", (".srt", ".vtt"), older)
        older = files.append(found, f"{folder}/manifest")
    inside = lambda c: F.regexp_replace(c, "^.*?/corpus-[0-9a-f]+/", "").alias(c)
    said = F.when(F.col("transcript_file").endswith(".srt") & F.col("transcript").cast("double").isNotNull(), "srt").otherwise(F.col("transcript")).alias("transcript")
    return older.select("dataset", "id", inside("wav_file"), inside("orig_audio"), "sample_rate", "channels", "duration_sec", said, inside("transcript_file"))


@query("select 'x'||vec_id as id, 'wav/'||(vec_id%10)||'/x'||vec_id||'.wav' as file, cast(44+2*len(embedding) as bigint) as length, case when vec_id%3<2 then 'plain '||vec_id end as transcript from embeddings")
def audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds written as files in folders, listed without being read, each with the transcript that lies in a text file of its name."""
    folder = _folder(spark, "listed")
    folder = folder if "://" in folder else f"file://{folder}"
    _write_corpus(audio_arrays(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    found = files.list_audio(spark, folder).withColumn("id", values.stem(F.col("path")))
    said = files.read_sidecars(spark, f"{folder}/text").select(values.stem(F.col("path")).alias("id"), F.col("text").alias("transcript"))
    inside = F.regexp_replace("path", "^.*?/listed-[0-9a-f]+/", "").alias("file")
    return found.join(said, "id", "left").select("id", inside, "length", "transcript")
