"""Hierarchies over flat sequences: sections under headers, and routines with what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import folds

SECTIONS = "doc_id long, section_id int, parent_id int, level int, title string, start_off int, end_off int"


def header_level(kind, value):
    """Columns to a header's level: ``=`` and ``-`` underlines are 1 and 2, else the number of # (leading blanks don't count; 1 where the text is not there)."""
    marks = F.greatest(F.coalesce(F.length(F.regexp_extract(F.ltrim(value), r"^#+", 0)), F.lit(1)), F.lit(1))
    return F.when(kind == "setext_heading_1", 1).when(kind == "setext_heading_2", 2).when(kind == "atx_heading", marks).otherwise(0).cast("int")


def enclosing(headers: DataFrame) -> DataFrame:
    """Adds ``parent_seq``: the last header before, of the same document, that has a lower level, whatever the levels.

    One sorted pass keeps the headers that later ones may belong to. A header without a level belongs to none and holds none.
    """

    def start():
        open_: list[tuple[int, int]] = []

        def step(seq: int, level: int | None) -> tuple[int | None]:
            if level is None:
                return (None,)
            while open_ and open_[-1][0] >= level:
                open_.pop()
            parent = open_[-1][1] if open_ else None
            open_.append((level, seq))
            return (parent,)

        return step

    return folds.add_columns(headers, "seq", ["seq", "level"], start, "parent_seq int")


def sections(blocks: DataFrame) -> DataFrame:
    """Nested sections from flat blocks (doc_id, seq, type, value, start_off, end_off); missing levels get sections of their own.

    A section reaches to the end of its last block. One sorted pass holds the sections that are open and gives each as it closes;
    ids count sections as they begin. A heading without a text is one of level 1 without a title.
    """

    def start():
        opened: list[tuple[int, int | None, int, str | None, int]] = []  # id, parent, level, title, first offset
        nr, end = 0, None

        def step(seq: int | None = None, level: int = 0, value: str | None = None, first: int | None = None, last: int | None = None):
            nonlocal nr, end
            if seq is not None and not level:
                end = last
                return ()
            found = []
            while opened and (seq is None or opened[-1][2] >= level):
                found.append((*opened.pop(), end))
            if seq is None:
                return found
            title = None if value is None else value.strip("# \r\n").split("\n")[0]
            for own in range(opened[-1][2] + 1 if opened else 1, level + 1):
                opened.append((nr, opened[-1][0] if opened else None, own, title if own == level else None, first))
                nr += 1
            end = last
            return found

        return step

    leveled = blocks.withColumn("level", header_level(F.col("type"), F.col("value")))
    return folds.emitted(leveled, "seq", ["seq", "level", "value", "start_off", "end_off"], start, SECTIONS.split(", ", 1)[1])


def attach_to_routines(parts: DataFrame, header: str = "routine", attached: tuple[str, ...] = ("modifier", "block", "tail")) -> DataFrame:
    """Adds ``routine_seq``: the routine header, of the same parent, that a modifier, block or tail belongs to.

    A header takes all that directly follows it; anything else between ends it.
    """
    w = W.Window.partitionBy("doc_id", "parent_id").orderBy("seq")
    breaks = F.sum((~F.col("type").isin(header, *attached)).cast("int")).over(w)
    runs = parts.withColumn("_run", breaks)
    own = W.Window.partitionBy("doc_id", "parent_id", "_run").orderBy("seq")
    last = F.last(F.when(F.col("type") == header, F.col("seq")), ignorenulls=True).over(own)
    return runs.withColumn("routine_seq", F.when(F.col("type").isin(header, *attached), last)).drop("_run")


def routine_spans(parts: DataFrame, **kw) -> DataFrame:
    """(doc_id, routine_seq, start_off, end_off, n_parts): each routine with all attached to it."""
    named = attach_to_routines(parts, **kw).filter("routine_seq is not null")
    return named.groupBy("doc_id", "routine_seq").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.count("*").alias("n_parts"))
