"""Entities from a directory that files keep arriving in.

An extension: parsing is stateless per document, so the batch functions of ``tolparse.frames`` run unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import frames
from ..parsing.engine import Parser
from ..sources.files import decoded


def document_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, arrived, text) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    raw = reader.load(path)
    return decoded(raw.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("arrived"), "content"))


def entity_stream(docs: DataFrame, parser: Parser, types: Iterable[str]) -> DataFrame:
    """Entities of a stream (or table) of documents."""
    return frames.entities(docs, parser, types)


def counts_by_window(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts in tumbling windows; a window is closed when the watermark passes it."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
