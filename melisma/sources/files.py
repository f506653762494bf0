"""Files: recordings, waves, probes, subtitles and ground truth. Readers and writers are Spark's own throughout."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import text as T

# Extensions of recordings; what a wave must be.
EXTENSIONS = ("m4a", "mp3", "wav", "aac", "ogg", "opus", "flac", "wma", "mp4", "mov", "mkv", "webm")
RATE, CHANNELS, WIDTH = 16_000, 1, 2


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length of the recordings in a folder; contents are not read."""
    return only_recordings(spark.read.format("binaryFile").load(path).drop("content"))


def only_recordings(files: DataFrame) -> DataFrame:
    """The rows of a file listing whose ``path`` ends in an extension of recordings."""
    return files.where(F.col("path").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))


def newest(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, path of the file that was changed last, of several the one whose path sorts last."""
    return files.groupBy(*keys or []).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def newest_recording(spark: SparkSession, path: str) -> DataFrame:
    return newest(recordings(spark, path))


def read_waves(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """path, chunk_ix, samples (array<float> in [-1, 1)): 16 kHz mono 16-bit waves in chunks; anything else is an error."""
    return wave_chunks(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content"), chunk)


def wave_chunks(files: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """path, chunk_ix, samples of the waves in (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for name, raw in zip(x["path"], x["content"], strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    if (w.getframerate(), w.getnchannels(), w.getsampwidth()) != (RATE, CHANNELS, WIDTH):
                        raise ValueError(f"{name}: not a 16 kHz mono 16-bit wave")
                    data = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                for i in range(0, max(1, len(data)), chunk):
                    yield pd.DataFrame({"path": [name], "chunk_ix": [i // chunk], "samples": [data[i : i + chunk]]})

    return files.mapInPandas(run, "path string, chunk_ix int, samples array<float>")


def audio_probe(probes: DataFrame, column: str) -> DataFrame:
    """The rows with codec, rate, channels of the first audio stream (null without one) and duration, from probe JSON."""
    kind = "streams array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int>>, format struct<duration:string>"
    p = probes.withColumn("_p", F.from_json(column, kind)).withColumn("_s", F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "audio"), F.lit(0)))
    return p.withColumns({"codec": F.col("_s.codec_name"), "rate": F.col("_s.sample_rate").cast("int"), "channels": F.col("_s.channels"), "duration": F.col("_p.format.duration").cast("double")}).drop("_p", "_s")


def srt_starts(lines: DataFrame, column: str = "value") -> DataFrame:
    """The rows that hold a cue's times, with ``start`` in seconds."""
    part = [F.regexp_extract(column, r"(\d+):(\d+):(\d+),(\d+) -->", i).cast("string") for i in (1, 2, 3, 4)]
    h, m, s, ms = (p.try_cast("long") for p in part)
    return lines.where(F.col(column).rlike(r"\d+:\d+:\d+,\d+ -->")).withColumn("start", h * 3600 + m * 60 + s + ms / 1000)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """path, start of every cue of subtitle files."""
    return srt_starts(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")).select("path", "start")


def write_texts(texts: DataFrame, path: str, column: str, bom: bool = False) -> None:
    """One file for each row (subtitles with a byte-order mark, reports without), by partitions of one row."""
    body = F.concat(F.lit("﻿" if bom else ""), F.col(column)).alias("value")
    key = [c for c in texts.columns if c != column]
    texts.select(*key, body).write.mode("overwrite").option("lineSep", "\n").partitionBy(*key).text(path)


def truth_line(start, verse, display):
    """A line of a ground-truth file: the time in eight places, then a comment."""
    return F.concat(T.fixed(start, 2, 8), F.lit("  # פסוק "), verse.cast("string"), F.lit(": "), display)


def truth_times(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that hold a time before their comment, with ``start``."""
    t = F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1)))
    return lines.where(F.length(t) > 0).withColumn("start", t.cast("double"))
