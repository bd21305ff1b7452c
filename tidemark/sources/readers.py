"""Readers: event logs, audio logs, manifests, text lines, waveforms, probes, file lists.

JSON arrays are read one file per row (a log of one recording is one file, or a folder of pages),
so that records keep their position.  A source is told by the whole path of its log, never by its
name alone: ``7.json`` and ``007.json``, and equal names in two folders, are different sources.  A
table of (file, source_id) may name sources instead.  Files that can't be read give no rows; they
come back as a table of their own, with the reason.

Logs of very many recordings come in packs (``packed=True``): Parquet rows of ``PACK``, each a whole
document with the path of its log, so that the number of files does not grow with the recordings.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple
from urllib.parse import unquote
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import parse_timed_line, parse_transcript_line
from tidemark.functions.timefmt import parse_rate
from tidemark.schemas import MANIFEST_CLIP, PROBE, RAW_EVENT, SIGNAL
from tidemark.session import local_path, task_count

#: A document of a log in a pack: the path of the log, the page and the bytes.
PACK = "file STRING, page BIGINT, content BINARY"

STEM = r"([^/]+?)(?:\.[^./]*)?$"


class LogRead(NamedTuple):
    """Rows of the readable files, and (file, reason) of the others."""

    rows: DataFrame
    unreadable: DataFrame


def plain_path(path: Column) -> Column:
    """A path without scheme and host, so that it is the same however a store is reached."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([path] if isinstance(path, str) else [*path])


def _log_of(where: Column) -> Column:
    """The path of a file, or that of the folder ``log=<name>`` of a paged log."""
    return F.coalesce(F.nullif(F.regexp_extract(where, r"^(.*/log=[^/]+)/page=\d+/", 1), F.lit("")), where)


def _documents(
    spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None = None, packed: bool = False
) -> DataFrame:
    """Whole files: file (the path of the log), source_id, page, value (null where the bytes are not UTF-8)."""
    value = F.try_validate_utf8(F.col("content").cast("string")).alias("value")
    if packed:
        packs = spark.read.schema(PACK).parquet(*([path] if isinstance(path, str) else path))
        docs = packs.select(plain_path(F.col("file")).alias("file"), F.coalesce("page", F.lit(0)).alias("page"), value)
    else:
        where = plain_path(F.col("path"))
        page = F.regexp_extract(where, r"/page=(\d+)/", 1).try_cast("bigint")
        docs = _files(spark, path).select(_log_of(where).alias("file"), F.coalesce(page, F.lit(0)).alias("page"), value)
    if sources is None:
        return docs.withColumn("source_id", F.xxhash64("file"))
    named = sources.select(plain_path(F.col("file")).alias("file"), F.col("source_id").alias("__named"))
    return docs.join(named, "file", "left").withColumn("source_id", F.coalesce("__named", F.xxhash64("file"))).drop("__named")


def _without_bytes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, reason) of files of no bytes: a scan leaves them out, the listing has them."""
    found = _files(spark, path)
    listed = spark.createDataFrame([(unquote(f),) for f in found.inputFiles()], "path STRING").select(plain_path(F.col("path")).alias("path"))
    empty = listed.join(found.select(plain_path(F.col("path")).alias("path")), "path", "left_anti")
    return empty.select(_log_of(F.col("path")).alias("file"), F.lit("empty").alias("reason"))


def _read_list(spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None, items: Column, packed: bool) -> LogRead:
    """Rows (source_id, page, pos, e) of documents that are lists; ``items`` is null where one can't be parsed."""
    docs, value = _documents(spark, path, sources, packed), F.col("value")
    text = F.ltrim(F.regexp_replace(value, r"^[\s\x{FEFF}]+", ""))
    reason = (
        F.when(value.isNull(), "not UTF-8").when(text == "", "empty")
        .when(~text.startswith("["), "not a list").when(items.isNull(), "not JSON")
    )
    judged = docs.select("file", "source_id", "page", items.alias("items"), reason.alias("reason"))
    rows = judged.where(F.col("reason").isNull()).select("source_id", "page", F.posexplode("items").alias("pos", "e"))
    bad = judged.where(F.col("reason").isNotNull()).select("file", "reason")
    # a pack holds its empty documents as rows
    return LogRead(rows, bad if packed else bad.union(_without_bytes(spark, path)))


def event_logs(spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None = None, *, packed: bool = False) -> LogRead:
    """Event tables from JSON arrays of event objects, one file (or paged folder) per source."""
    fields = RAW_EVENT.replace(", _corrupt_record STRING", "")
    rows, unreadable = _read_list(spark, path, sources, F.from_json("value", f"array<struct<{fields}>>"), packed)
    # pages keep their order: page in the upper, position in the lower half
    return LogRead(rows.select("source_id", (F.shiftleft("page", 32) + F.col("pos")).alias("event_id"), "e.*"), unreadable)


def read_event_logs(spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None = None, *, packed: bool = False) -> DataFrame:
    """The rows of :func:`event_logs`."""
    return event_logs(spark, path, sources, packed=packed).rows


def audio_records(value: Column) -> Column:
    """Records of an audio log as an array of structs, null where it can't be parsed.

    A log lists ``[t, label, score]`` lists, event objects, or both in one document.  Lists of fewer than
    three entries and entries of another kind are left out; unreadable numbers become null.
    """
    items = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    usable = F.filter(items, lambda e: F.schema_of_variant(e).startswith("OBJECT") | F.try_variant_get(e, "$[2]", "variant").isNotNull())

    def field(e: Column, place: int, name: str, kind: str) -> Column:
        # a list has no names and an object no places, so that one of two is null
        text = F.coalesce(F.try_variant_get(e, f"$[{place}]", "string"), F.try_variant_get(e, f"$.{name}", "string"))
        return text if kind == "string" else text.try_cast(kind)

    return F.transform(
        usable,
        lambda e: F.struct(
            field(e, 0, "timestamp_s", "double").alias("timestamp_s"), field(e, 1, "label", "string").alias("label"),
            field(e, 2, "confidence", "double").alias("score"),
        ),
    )


def audio_logs(spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None = None, *, packed: bool = False) -> LogRead:
    """Audio tables from JSON logs, one file (or paged folder) per source."""
    rows, unreadable = _read_list(spark, path, sources, audio_records(F.col("value")), packed)
    return LogRead(rows.select("source_id", "e.*"), unreadable)


def read_audio_events(spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None = None, *, packed: bool = False) -> DataFrame:
    """The rows of :func:`audio_logs`."""
    return audio_logs(spark, path, sources, packed=packed).rows


def manifest_clips(value: Column, schema: str = MANIFEST_CLIP) -> Column:
    """Clips of a manifest, either a bare array or an object with ``clips``."""
    bare = F.from_json(value, f"array<struct<{schema}>>")
    wrapped = F.from_json(value, f"struct<clips: array<struct<{schema}>>>")
    return F.when(F.ltrim(value).startswith("["), bare).otherwise(wrapped.clips)


def read_manifests(
    spark: SparkSession, path: str | Sequence[str], schema: str = MANIFEST_CLIP, sources: DataFrame | None = None
) -> DataFrame:
    docs = _documents(spark, path, sources)
    return docs.select("source_id", F.posexplode(manifest_clips(F.col("value"), schema)).alias("clip_ix", "c")).select(
        "source_id", "clip_ix", "c.*"
    )


def read_transcript_lines(spark: SparkSession, path: str | Sequence[str], sources: DataFrame | None = None) -> DataFrame:
    docs = _documents(spark, path, sources)
    return transcript_table(docs.select("source_id", F.posexplode(F.split("value", "\n")).alias("ix", "line")))


def transcript_table(lines: DataFrame) -> DataFrame:
    """``source_id, ix, line`` to the transcript table; lines without times keep -1."""
    parsed = lines.withColumn("__p", parse_transcript_line(F.col("line")))
    return parsed.select("source_id", F.col("ix").cast("bigint").alias("ix"), "__p.*")


def timed_text_table(lines: DataFrame) -> DataFrame:
    """``source_id, line`` of screen or vision text to times and text."""
    return lines.withColumn("__p", parse_timed_line(F.col("line"))).select("source_id", "__p.*")


def read_signal(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Waveform chunks stored as parquet rows of samples."""
    return spark.read.schema(SIGNAL).parquet(*([path] if isinstance(path, str) else path))


def _listing(folder: str, shares: int):
    """For ``mapInArrow``, rows of a share's number: (path, length) of the files in that share of the entries of ``folder``.

    Names that Spark leaves out, and files of no bytes, are left out here too.
    """

    def files(where: str, share: int | None = None) -> Iterator[tuple[str, int]]:
        with os.scandir(where) as entries:
            for entry in entries:
                name = entry.name
                if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
                    continue
                if share is not None and crc32(os.fsencode(name)) % shares != share:
                    continue
                if entry.is_dir():
                    yield from files(entry.path)
                    continue
                try:
                    length = entry.stat().st_size
                except FileNotFoundError:  # removed meanwhile, or a link to nothing
                    continue
                if length:
                    yield "file:" + os.fsencode(entry.path).decode("utf-8", "replace"), length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column(0).to_pylist():
                found = files(folder, share)
                while rows := list(islice(found, 10_000)):
                    paths, lengths = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    return run


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str], kind: str = "image") -> DataFrame:
    """Files of a folder tree by extension; contents are not read.

    A folder on a local or mounted store is listed by tasks, when the rows are asked for.  Spark's own
    listing, which holds a status of every file on the driver, serves other stores and patterns.
    """
    low = [e.lower().lstrip(".") for e in extensions]
    local = local_path(spark, folder)
    if local is not None and os.path.isdir(local):
        shares = task_count(spark)
        names = spark.range(0, shares, 1, shares).mapInArrow(_listing(local, shares), "path string, length long")
    else:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_folder = F.nullif(F.regexp_extract("path", r"/stem=([^/]+)/[^/]+$", 1), F.lit(""))  # as Spark's writer names files
    return names.where(ext.isin(*low)).select(
        F.coalesce(by_folder, F.regexp_extract("path", STEM, 1)).alias("stem"), F.concat(F.lit("."), ext).alias("ext"), "path", "length",
        F.lit(kind).alias("kind"),
    )


def class_names(value: Column) -> Column:
    """Names of a class file in order, blank lines skipped."""
    return F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x != "")


def read_class_names(spark: SparkSession, path: str, default: str = "target_indicator") -> DataFrame:
    """Index and name per class; a missing file gives the single default class."""
    fallback = spark.createDataFrame([(0, default)], "ix INT, name STRING")
    try:
        docs = spark.read.text(path, wholetext=True)
    except Exception as err:  # the path check is the only thing done eagerly
        if "PATH_NOT_FOUND" in str(err):
            return fallback
        raise
    return docs.select(F.posexplode(class_names(F.col("value"))).alias("ix", "name"))


def media_info(probes: DataFrame) -> DataFrame:
    """Duration, size, and the first video and audio stream of probe documents."""
    p = probes.withColumn("__p", F.from_json("probe", f"struct<{PROBE}>"))
    video = F.get(F.filter("__p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    audio = F.get(F.filter("__p.streams", lambda s: s["codec_type"] == "audio"), F.lit(0))
    p = p.withColumns({"__v": video, "__a": audio})
    return p.select(
        "source_id",
        F.coalesce(F.col("__p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration"),
        F.coalesce(F.col("__p.format.size").try_cast("bigint"), F.lit(0)).alias("size_bytes"),
        F.col("__v.codec_name").alias("video_codec"),
        F.col("__v.width").alias("width"),
        F.col("__v.height").alias("height"),
        F.round(parse_rate(F.coalesce("__v.r_frame_rate", F.lit("0/1"))), 2).alias("fps"),
        F.col("__v.r_frame_rate").alias("r_frame_rate"),
        F.col("__v.avg_frame_rate").alias("avg_frame_rate"),
        F.col("__a.codec_name").alias("audio_codec"),
        F.col("__a").isNotNull().alias("has_audio"),
    )
