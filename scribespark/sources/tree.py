"""A file tree as a table, and the manifest of a speech corpus from what lies on disk.

The data source ``audio_tree`` lists folders in tasks and reads, of WAV files, only the heads of chunks, so
the work follows the number of files, not the length of their sound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scribespark.functions.values import stem
from scribespark.operators import ingest
from scribespark.sources.audio import wav_figures
from scribespark.sources.files import read_sidecars

#: Endings under which an original is looked for, the first that is there counts.
ORIGINALS = (".wav", ".mp3", ".m4a", ".flac", ".ogg")
_SCHEMA = "path string, length long, sample_rate int, channels int, duration_sec double, bytes_read long"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("duration_sec", pa.float64()), ("bytes_read", pa.int64())])


@dataclass
class Part(InputPartition):
    """A folder: all below it, or a share of the files in it."""

    folder: str
    below: bool
    share: int = 0
    shares: int = 1


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


class TreeReader(DataSourceReader):
    """Options: ``path``, ``endings`` (comma-separated, lower case, default .wav; empty: all), ``parts`` (tasks wanted, default 64)."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.endings = tuple(x for x in options.get("endings", ".wav").split(",") if x)
        self.parts = int(options.get("parts", "64"))

    def partitions(self) -> list[Part]:
        """Folders are opened, breadth first, until there are as many as tasks are wanted; the files of an opened one are shared out by name."""
        from pyarrow import fs

        system, root = _open(self.path)
        if system.get_file_info(root).type != fs.FileType.Directory:
            return []
        waiting, opened = [root], []
        while waiting and len(waiting) + len(opened) < self.parts:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting += sorted(x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory)
        shares = max(1, self.parts // max(1, len(opened) + len(waiting)))
        return [Part(f, False, k, shares) for f in opened for k in range(shares)] + [Part(f, True) for f in waiting]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition is None:  # without partitions Spark asks once, for all
            return
        system, _ = _open(self.path)
        prefix = "file:" if system.type_name == "local" else self.path[: self.path.index("://") + 3]
        rows: list[tuple] = []
        for info in system.get_file_info(fs.FileSelector(partition.folder, recursive=partition.below)):
            if info.type != fs.FileType.File or (self.endings and not info.path.lower().endswith(self.endings)):
                continue
            if zlib.crc32(info.base_name.encode()) % partition.shares != partition.share:
                continue
            rows.append((prefix + info.path, info.size, *self._figures(system, info)))
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _figures(self, system, info) -> tuple:
        if not info.path.lower().endswith(".wav"):
            return None, None, None, 0
        total = 0

        def read(at: int, n: int) -> bytes:
            nonlocal total
            file.seek(at)
            got = file.read(n)
            total += len(got)
            return got

        try:
            with system.open_input_file(info.path) as file:
                found = wav_figures(read, info.size)
        except OSError:  # gone or unreadable: listed without figures
            found = None
        return *(found or (None, None, None)), total


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class AudioTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def audio_tree(spark: SparkSession, path: str, endings: tuple[str, ...] = (".wav",), parts: int | None = None) -> DataFrame:
    """path, length, sample_rate, channels, duration_sec, bytes_read of the files below a folder with one of the endings.

    Files that are no WAV have null figures; a folder that isn't there is empty.
    """
    spark.dataSource.register(AudioTree)
    reader = spark.read.format("audio_tree").option("path", path).option("endings", ",".join(endings))
    return reader.option("parts", str(parts or 4 * spark.sparkContext.defaultParallelism)).load()


def _plain_path(path: Column) -> Column:
    """file:/a, file:///a and /a are one place."""
    return F.regexp_replace(path, "^file:/+", "/")


def manifest_from_disk(spark: SparkSession, dataset: str, wavs: str, transcripts: str, originals: str | None = None, patterns: tuple[str, ...] = (), older: DataFrame | None = None) -> DataFrame:
    """dataset, id, wav_file, orig_audio, sample_rate, channels, duration_sec, transcript, transcript_file of each WAV.

    ``patterns``: endings of transcripts in order of preference, matched by name without ending in any case; else the ``.txt`` of just that
    name; else the transcript and its file are empty strings. ``originals``: folder of originals, by ``ORIGINALS``, '' if there is none; without
    a folder the WAV itself. A WAV whose ``wav_file`` is in ``older`` is skipped, and of it neither head nor transcript
    is asked for again. Of several files equally good the first by path is taken. Unreadable WAVs have null figures.
    """
    found = audio_tree(spark, wavs).select(_plain_path(F.col("path")).alias("wav_file"), "sample_rate", "channels", "duration_sec").withColumn("id", stem(F.col("wav_file")))
    if older is not None:
        found = found.join(older.select("wav_file"), "wav_file", "left_anti")
    found = found.withColumn("_low", F.lower("id"))
    texts = read_sidecars(spark, transcripts, tuple(f"*{p}" for p in (*patterns, ".txt"))).select(_plain_path(F.col("path")).alias("path"), "text").withColumn("_id", stem(F.col("path")))
    # places before those of plain .txt files of just the name
    rank = F.coalesce(*(F.when(F.col("path").endswith(p), F.lit(i)) for i, p in enumerate(patterns)), F.lit(len(patterns)))
    texts = texts.withColumn("_rank", rank).withColumn("_file", F.struct("path", "text"))
    by_pattern = texts.where(F.col("_rank") < len(patterns)).withColumn("_low", F.lower("_id"))
    plain = texts.where(F.col("path").endswith(".txt")).select(F.col("_id").alias("id"), F.lit(0).alias("_rank"), "_file")
    found = ingest.match_by_priority(found, by_pattern, "_low", "_rank", "_file", "_first")
    found = ingest.match_by_priority(found, plain, "id", "_rank", "_file", "_plain").withColumn("_text", F.coalesce("_first", "_plain"))
    original = F.col("wav_file")
    if originals is not None:
        raw = audio_tree(spark, originals, ()).select(_plain_path(F.col("path")).alias("path")).withColumn("id", stem(F.col("path")))
        ranked = F.coalesce(*(F.when(F.col("path").endswith(e), F.lit(i)) for i, e in enumerate(ORIGINALS)))
        raw = raw.withColumn("_rank", ranked).where("_rank is not null")
        found = ingest.match_by_priority(found, raw, "id", "_rank", "path", "_original")
        original = F.coalesce("_original", F.lit(""))
    text = lambda field: F.coalesce(F.col(f"_text.{field}"), F.lit(""))
    return found.select(F.lit(dataset).alias("dataset"), "id", "wav_file", original.alias("orig_audio"), "sample_rate", "channels", "duration_sec", text("text").alias("transcript"), text("path").alias("transcript_file"))
