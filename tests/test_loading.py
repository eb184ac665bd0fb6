"""Files, catalog, updates, enrichment and sound."""

import random
import statistics
import struct
import time
import wave

from pyspark.sql import functions as F

from scribespark.functions import values, variant
from scribespark.operators import enrich, ingest, order, profile, telemetry
from scribespark.queries.accuracy import sample_of
from scribespark.queries.loading import search
from scribespark.sources import audio, files, replica, tree
from scribespark.streaming import streams


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'he said "x",\nthen left'), ("b", "plain")], "filename string, transcription string")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_csv(df.where("filename = 'b'"), f"{tmp_path}/c", mode="append")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == [("a", 'he said "x",\nthen left'), ("b", "plain"), ("b", "plain")]


def test_catalog(spark, tmp_path):
    files.create_table(spark, "asr_test.t", "id int, x string")
    files.create_table(spark, "asr_test.t", "id int, x string")
    files.insert(spark.createDataFrame([(1, "a")], "id int, x string"), "asr_test.t")
    assert files.get_table(spark, "asr_test.t").count() == 1
    files.drop_namespace(spark, "asr_test")
    assert not spark.catalog.databaseExists("asr_test")


def test_audio_tree(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, rate in (("a", 8000), ("sub/b", 16000)):
        with wave.open(str(tmp_path / f"in/{name}.wav"), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\0" * 4 * 4000)
    (tmp_path / "in/bad.wav").write_bytes(b"no sound")
    (tmp_path / "in/a.txt").write_text("  hello\nthere \n")
    assert files.list_audio(spark, str(tmp_path / "in")).count() == 3
    assert [r.text for r in files.read_sidecars(spark, str(tmp_path / "in")).collect()] == ["hello\nthere"]
    got = {r.id: (r.sample_rate, r.channels, r.duration_sec, r.transcript) for r in tree.manifest_from_disk(spark, "d", str(tmp_path / "in"), str(tmp_path / "in")).collect()}
    assert got == {"a": (8000, 2, 0.5, "hello\nthere"), "b": (16000, 2, 0.25, ""), "bad": (None, None, None, "")}


def test_pcm(spark):
    row = spark.range(1).select(F.array(F.lit(-2.0), F.lit(0.5), F.lit(1.0)).alias("a")).select(values.pcm16(F.col("a")).alias("m"), values.interleaved([values.pcm16(F.col("a"))] * 2).alias("s")).first()
    assert row.m == [-32767, 16383, 32767] and row.s == [-32767, -32767, 16383, 16383, 32767, 32767]


def test_upsert_takes_the_latest_and_keeps_on_null(spark):
    table = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id int, x string")
    updates = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (2, None, 1)], "id int, x string, seq int")
    assert dict(map(tuple, ingest.upsert(table, updates, "id", ["x"], "seq").collect())) == {1: "late", 2: "old", 3: "old"}


def test_new_rows_once(spark):
    a, b = spark.range(5).toDF("k"), spark.range(3).toDF("k")
    assert [r.k for r in ingest.new_rows(a, b, "k").orderBy("k").collect()] == [3, 4]
    assert [r.k for r in ingest.new_rows(a, b, "k", 1).collect()] == [3]
    assert ingest.new_rows(a, a, "k").count() == 0


def test_enrich_retries_and_keeps_errors(spark):
    def call(row, attempt):
        if row["id"] == 0 or attempt < row["id"]:
            raise ValueError("busy")
        return {"y": row["id"] * 10}

    rows = spark.range(4).withColumn("id", F.col("id").cast("int"))
    got = {r.id: (r.y, r.error, r.attempts) for r in enrich.enrich(rows, ["id"], call, "y int", max_retries=2).collect()}
    assert got == {0: (None, "ValueError: busy", 3), 1: (10, None, 1), 2: (20, None, 2), 3: (30, None, 3)}


def test_missing_and_text_of_variants(spark):
    df = spark.createDataFrame([(None,), ("null",), ("{}",), ("[]",), ('{"text":"x"}',), ('["a",{"text":"b"},3]',), ("7",)], "raw string").select(F.parse_json("raw").alias("v"))
    got = [tuple(r) for r in df.select(variant.is_missing(F.col("v")), variant.text_of(F.col("v"))).collect()]
    assert got == [(True, ""), (True, ""), (True, "{}"), (True, ""), (False, "x"), (False, "a b"), (False, "7")]


def test_profile_of_an_empty_table(spark):
    rows = profile.column_profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.column_name, r.total, r.non_null_pct) for r in rows] == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_completion_of_a_missing_column(spark):
    df = spark.createDataFrame([(1, "{}", None), (2, '{"text":"x"}', "1")], "id int, a string, b string").select("id", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    got = [tuple(r) for r in profile.completion(df, ["a", "c", "b"]).collect()]
    assert sorted(got, key=lambda r: r[0]) == [("a", 2, 1, 1, 50.0, None), ("b", 2, 1, 1, 50.0, None), ("c", None, None, None, None, "Column 'c' does not exist in table")]
    assert [r.pct for r in profile.completion(df.limit(0), ["a"]).collect()] == [0.0]


def test_trimming_starts_above_twenty(spark):
    for n, lo, p95 in ((20, 0.0, 19.0), (21, 1.0, 19.0)):
        df = spark.range(n).select(F.lit("r").alias("g"), F.col("id").cast("double").alias("x"))
        row = order.order_stats(df, ["g"], "x", 0.01, 20).first()
        assert (row.lo, row.p95, row.median) == (lo, p95, (n - 1) / 2)


def test_order_stats_of_groups(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 50))) for g in ("a", "b", None) for _ in range(rng.randint(1, 400))] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: r for r in order.order_stats(df, ["g"], "x").collect()}
    for g in ("a", "b", None):
        own = sorted(x for k, x in rows if k == g)
        r = got[g]
        assert (r.n, r.median, r.lo, r.hi, r.p95) == (len(own), statistics.median(own), own[0], own[-1], own[int(0.95 * len(own))])
        assert abs(r["mean"] - statistics.fmean(own)) < 1e-9
    assert "c" not in got


def test_numbers_run_through_all_tasks(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(9)
    assert all(r.at == r.k for r in order.numbered(df, ["k"], "at").collect())
    got = sorted((r.g, r.at, r.k) for r in order.numbered(df, ["k"], "at", ("g",)).collect())
    assert [(g, a) for g, a, _ in got] == [(g, i) for g, n in ((0, 334), (1, 333), (2, 333)) for i in range(n)]
    assert all(a[2] < b[2] for a, b in zip(got, got[1:]) if a[0] == b[0])
    assert order.numbered(df.limit(0), ["k"], "at").count() == 0


def test_upserts_survive_a_run_without_news(spark, tmp_path):
    base = spark.createDataFrame([(1, "old", "a"), (2, "old", "b")], "id int, x string, y string")

    def run():
        stream = streams.file_stream(spark, f"{tmp_path}/in", updates.schema)
        return {r.id: (r.x, r.y) for r in streams.upsert_available(stream, base, f"{tmp_path}/changes", f"{tmp_path}/check", "id", ["x", "y"], "seq").collect()}

    updates = spark.createDataFrame([(1, "new", None, 2)], "id int, x string, y string, seq int")
    updates.limit(0).write.parquet(f"{tmp_path}/in")
    assert run() == {1: ("old", "a"), 2: ("old", "b")}
    updates.write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == run() == {1: ("new", "a"), 2: ("old", "b")}
    spark.createDataFrame([(1, "late", "c", 1), (2, None, "d", 1)], updates.schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == run() == {1: ("new", "c"), 2: ("old", "d")}


def test_sound_after_other_chunks(spark):
    def chunk(name, data):
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    form, sound = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16)), chunk(b"data", b"\0" * 16000)
    many = chunk(b"note", b"odd") * 500
    files_ = [form + sound, form + chunk(b"LIST", b"x" * 27) + sound, chunk(b"junk", b"") + form + chunk(b"fact", b"1234") + sound, form, sound, b"", form + many + sound, many + form + sound, form + sound[:10], b"fmt "]
    df = spark.createDataFrame([(i, bytearray(b"RIFF\0\0\0\0WAVE" + x)) for i, x in enumerate(files_)] + [(19, None)], "i int, c binary")
    got = {r.i: r.h and tuple(r.h) for r in df.select("i", audio.header(F.col("c")).alias("h")).collect()}
    assert got == {0: (8000, 1, 1.0), 1: (8000, 1, 1.0), 2: (8000, 1, 1.0), 3: None, 4: None, 5: None, 6: (8000, 1, 1.0), 7: (8000, 1, 1.0), 8: (8000, 1, 1.0), 9: None, 19: None}


def test_a_replica_catches_up(spark, tmp_path):
    """New, changed, nulled and removed rows, ranges that vanish; a replica like its source isn't touched."""
    rows = [(k, f"v{k}", None if k % 4 else k) for k in range(300)]
    schema = "k long, x string, y long"
    frame = lambda r: spark.createDataFrame(r, schema)
    path, copy = f"{tmp_path}/replica", f"{tmp_path}/copy"
    replica.publish(frame(rows), path, "k", "numbers")
    record = replica.published(spark, path).first()
    assert (record.name, record.rows, record.key) == ("numbers", 300, "k") and record.published_at

    def files_of():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "replica").rglob("*.parquet")}

    before = files_of()
    assert replica.pull(frame(rows[::-1]), path, "k").count() == 300 and files_of() == before
    now = [r for r in rows if r[0] not in (5, 6, 7)] + [(1000, "new", 1), (1001, None, None)]
    now = [(k, "other", y) if k == 20 else (k, x, None) if k == 40 else (k, x, y) for k, x, y in now]
    assert sorted((r.k, r.kind) for r in replica.changes(frame(now), frame(rows), "k").collect()) == [(5, "removed"), (6, "removed"), (7, "removed"), (20, "changed"), (40, "changed"), (1000, "new"), (1001, "new")]
    for source in (frame(now), None):
        if source is None:  # back again, by way of a published copy
            replica.publish(frame(rows), copy, "k", "numbers")
            got, want = replica.pull(copy, path, "k", frame(rows).schema, spark), rows
        else:
            got, want = replica.pull(source, path, "k"), now
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert replica.differing(replica.digests(frame(want), "k"), replica.stored_digests(spark, path)) == []
        kept = [p for p, t in files_of().items() if before.get(p) == t]
        assert len(kept) > 250  # of about 290 ranges
        before = files_of()
    assert replica.pull(frame([]), path, "k").count() == 0


def test_materialised_frames(spark):
    df = spark.range(10).toDF("k").orderBy("k")
    assert [r.k for r in df.tail(2)] == [8, 9] and [r.k for r in df.head(2)] == [0, 1] and len(df.toPandas()) == 10
    assert files.persisted(df).storageLevel.useDisk
    df.show(2)


def test_calls_wait(spark):
    began = time.monotonic()
    pace = enrich.Pace(50.0)
    for _ in range(6):
        pace.wait()
    assert time.monotonic() - began >= 0.1

    def call(row, attempt):
        raise ValueError("busy")

    began = time.monotonic()
    rows = spark.range(1).coalesce(1)
    assert enrich.enrich(rows, ["id"], call, "y int", max_retries=2, backoff=0.2, rate=100.0).first().attempts == 3
    assert time.monotonic() - began >= 0.6  # 0.2 and 0.4 seconds


def test_fill_asks_for_what_is_pending_only(spark, tmp_path):
    def call(row, attempt):
        if row["id"] == 4:
            raise ValueError("never")
        return {"y": 1}

    rows = spark.range(6)
    spark.createDataFrame([(i, 7, None, 0) for i in range(3)], "id long, y int, error string, attempts int").write.parquet(f"{tmp_path}/done")
    for _ in range(2):
        done = enrich.fill(rows, ["id"], f"{tmp_path}/done", call, "y int", max_retries=0)
        assert {r.id: (r.y, r.error) for r in done.collect()} == {0: (7, None), 1: (7, None), 2: (7, None), 3: (1, None), 4: (None, "ValueError: never"), 5: (1, None)}
        assert done.count() == 6


def test_one_replica_has_no_deviation(spark):
    df = spark.createDataFrame([("a",)] * 3, "replica_id string")
    row = telemetry.replica_balance(df, 1).first()
    assert row["std"] == 0 and row.balance == 1 and row.all_used


def test_search_and_sample(spark):
    df = spark.createDataFrame([(1, "A.b"), (2, "axb"), (3, None)], "id int, t string")
    assert [r.id for r in search(df, "t", "a.b").collect()] == [1, 2]
    assert [r.id for r in search(df, "t", "a.b", literal=True).collect()] == [1]
    assert sample_of(df, "id", 2).first().id == 2
    assert sample_of(df, "id", 9, 4).collect() == sample_of(df, "id", None, 4).collect() and sample_of(df, "id").first().id in (1, 2, 3)


def test_languages_and_ids(spark):
    df = spark.createDataFrame([("English", "en"), (" FR ", "fr"), ("", None), (None, None), ("Elvish", "elvish")], "given string, code string")
    assert all(r.x == r.code for r in df.select("code", values.language_code(F.col("given")).alias("x")).collect())


def test_tree(spark, tmp_path):
    """Deep and flat folders in many tasks, each file once; bytes read don't grow with the sound; what is listed before is skipped."""
    names = [f"in/{k % 3}/{k % 5}/f{k}.wav" for k in range(40)] + [f"in/flat{k}.WAV" for k in range(60)] + ["in/x.mp3"]
    for k, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"\0" * 2 * 8000 * (k % 4))
    for parts in (1, 2, 7, 64):
        rows = tree.audio_tree(spark, f"{tmp_path}/in", parts=parts).collect()
        assert sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in rows) == sorted(names[:100]) and {r.bytes_read for r in rows} == {12 + 8 + 16 + 8}
        assert all(r.duration_sec == (r.length - 44) / 16000 for r in rows)
    assert tree.audio_tree(spark, f"{tmp_path}/in", (), 4).count() == 101 and tree.audio_tree(spark, f"{tmp_path}/none").count() == 0
    first = tree.manifest_from_disk(spark, "d", f"{tmp_path}/in", f"{tmp_path}/in")
    assert {r.orig_audio == r.wav_file for r in first.collect()} == {True}
    assert tree.manifest_from_disk(spark, "d", f"file://{tmp_path}/in", f"{tmp_path}/in", older=first.limit(30)).count() == 70


def test_transcripts_by_pattern(spark, tmp_path):
    for d in ("wav", "text/b", "text/a", "raw"):
        (tmp_path / d).mkdir(parents=True)
    for name in ("One", "two", "three"):
        (tmp_path / f"wav/{name}.wav").write_bytes(b"")
    for name, said in (("text/b/one.vtt", "late"), ("text/b/ONE.srt", " second "), ("text/a/one.srt", "first"), ("text/two.txt", "plain"), ("text/THREE.txt", "other name"), ("text/One.txt", "less")):
        (tmp_path / name).write_text(said)
    for name in ("raw/two.ogg", "raw/two.mp3", "raw/One.aac", "raw/three.wav"):
        (tmp_path / name).write_text("")
    got = {r.id: (r.transcript, r.orig_audio.removeprefix(f"{tmp_path}/")) for r in tree.manifest_from_disk(spark, "d", f"{tmp_path}/wav", f"{tmp_path}/text", f"{tmp_path}/raw", (".srt", ".vtt")).collect()}
    assert got == {"One": ("first", ""), "two": ("plain", "raw/two.mp3"), "three": ("", "raw/three.wav")}
