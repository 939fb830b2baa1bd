"""Line dedup: lines that several documents share stay in the first of these documents alone.

Lines are exploded in normalised form (trimmed, A-Z lower-cased) and hashed; distinct documents are counted for each hash, in
two steps that combine before they shuffle, so a line that all documents hold is one row from each task. Hashes over the
threshold meet the lines again, by their 16 bytes alone, and give each text the places of its lines to drop; the text is put
together from the others by position. Texts are shuffled once, to meet these places.

The join on the hash is split: a hash that more than one in ``HOT`` of all shared lines have is sent to all tasks (there are
fewer than ``HOT`` of them, however large the table), and the others are dealt out by it.

A document is told by its id; texts are told by id and two hashes of the text, so rows of one id or of no id are not
gathered under it. Defined results: a null or empty text is one empty line; rows that share an id are one document, and equal
rows have equal results; a null id is an id of its own that comes after all others; lines shorter than ``MIN_CHARS``
characters, empty ones too, are never dropped; empty tables give no rows; other columns are not read. Two lines are the same if
two 64-bit hashes of theirs are: at 10^12 different lines some 10^-15 pairs are mistaken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

MIN_CHARS, MIN_DOCS, HOT = 10, 2, 4096
_BLANKS = " \t\n\x0b\x0c\r"
_ID = ["none", "doc", "t1", "t2"]


def key(line: Column) -> Column:
    """A line as it is compared: without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _named(docs: DataFrame) -> DataFrame:
    """(none, doc, t1, t2, text): the id with null as an id of its own, and the text's two hashes."""
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    one, two = _hashes(F.col("text"))
    return rows.withColumns({"t1": one, "t2": two})


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, pos, h1, h2) of the lines that can be dropped."""
    found = docs.select(*_ID, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(*_ID, "pos", key(F.col("line")).alias("key"))
    one, two = _hashes(F.col("key"))
    return found.filter(F.length("key") >= min_chars).select(*_ID, "pos", one.alias("h1"), two.alias("h2"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_lines, keeper): the hashes that at least ``min_docs`` documents hold, and the first of these."""
    in_doc = lines.groupBy("h1", "h2", "none", "doc").agg(F.count("*").alias("n"))
    counted = in_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n_lines"), F.min(F.struct("none", "doc")).alias("keeper"))
    return counted.filter(F.col("docs") >= min_docs).drop("docs")


def _dropped(lines: DataFrame, min_docs: int) -> DataFrame:
    """(id, places) of the texts that lose lines."""
    shared = written(shared_lines(lines, min_docs), "shared-lines")
    total = shared.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.col("n_lines") * HOT > total
    often, seldom = (shared.filter(x).select("h1", "h2", "keeper") for x in (hot, ~hot))
    often = F.broadcast(often)
    found = lines.join(often, ["h1", "h2"]).unionByName(lines.join(often, ["h1", "h2"], "left_anti").join(seldom, ["h1", "h2"]))
    return found.filter(F.struct("none", "doc") != F.col("keeper")).groupBy(*_ID).agg(F.collect_set("pos").alias("places"))


def _kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc_id, text, places): the lines that stay."""
    names = ["doc_id", "n_lines", "n_dropped", "text", "kept_sha256"]
    for part in parts:
        for at in range(0, part.num_rows, 256):
            own = part.slice(at, 256)
            out = []
            for doc, text, places in zip(*(c.to_pylist() for c in own.columns), strict=True):
                lines, gone = text.split("\n"), frozenset(places or ())
                kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
                out.append((doc, len(lines), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text, kept_sha256) for each row of ``docs`` (doc_id, text): the text without the lines that an earlier document has."""
    named = _named(docs.select("doc_id", F.make_valid_utf8(F.col("text").cast("string")).alias("text")))
    lines = written(_lines(named, min_chars), "lines")
    places = written(_dropped(lines, min_docs), "dropped-lines")
    whole = named.join(places, _ID, "left")
    schema = "doc_id long, n_lines long, n_dropped long, text string, kept_sha256 string"
    return whole.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "text", "places").mapInArrow(_kept, schema)
