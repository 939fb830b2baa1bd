"""Algebra of closed text segments [start, end], as column expressions; matching of two tables' segments."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import folds


def length(s: Column, e: Column) -> Column:
    return e - s + F.lit(1)


def includes(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first segment holds the second (equal ones hold each other)."""
    return (s1 <= s2) & (e1 >= e2)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether exactly one end of the second lies within the first."""
    inside = lambda x: (s1 <= x) & (x <= e1)
    return inside(s2) != inside(e2)


def intersects(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def hull(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.struct(F.least(s1, s2).alias("start_off"), F.greatest(e1, e2).alias("end_off"))


def merge(s1: Column, e2: Column) -> Column:
    """From the first one's start to the last one's end."""
    return F.struct(s1.alias("start_off"), e2.alias("end_off"))


def exclude(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """What is left of the first without the second: an array of no, one or two segments."""
    apart = ~intersects(s1, e1, s2, e2)
    piece = lambda s, e: F.struct(s.cast("int").alias("start_off"), e.cast("int").alias("end_off"))
    left = F.when(apart, piece(s1, e1)).when(s1 < s2, piece(s1, s2 - F.lit(1)))
    right = F.when(~apart & (e1 > e2), piece(e2 + F.lit(1), e1))
    return F.array_compact(F.array(left, right))


def shift(off: Column, by: Column) -> Column:
    """Moves an offset, not below zero."""
    return F.greatest(off + by, F.lit(0))


def shift_line(line: Column, by: Column) -> Column:
    """Moves a line number, not below one."""
    return F.greatest(line + by, F.lit(1))


def covered(structs: Column) -> Column:
    """Characters in an array of segments."""
    return F.aggregate(structs, F.lit(0), lambda n, s: n + s["end_off"] - s["start_off"] + F.lit(1))


# Between two tables.

#: Characters of a stretch: longer documents are dealt out by stretches, so that none is a single task's.
STRETCH = 1 << 20


class _Open:
    """Open segments of one side, by their ends."""

    def __init__(self):
        self.ends: list[int] = []
        self.rows: list = []

    def add(self, end: int, row: dict) -> None:
        at = bisect_right(self.ends, end)
        self.ends.insert(at, end)
        self.rows.insert(at, row)

    def drop_before(self, end: int) -> None:
        if n := bisect_left(self.ends, end):
            del self.ends[:n], self.rows[:n]

    def between(self, low: int, high: int | None = None) -> list[dict]:
        """Those that end in low ... high."""
        return self.rows[bisect_left(self.ends, low) : len(self.ends) if high is None else bisect_right(self.ends, high)]


def _including():
    """A right segment is held by the open left ones that end where it ends, or later."""
    left = _Open()

    def step(start: int | None = None, end: int = -1, first: int = 0, a: dict | None = None, b: dict | None = None):
        if start is None:
            return ()
        left.drop_before(start - 1)
        if a is not None:
            left.add(end, a)
            return ()
        return [(x, b) for x in left.between(end)] if start >= first else ()

    return step


def _overlapping():
    """A left segment holds just one end of a right one that began before and ends within, or begins within and ends behind."""
    left, right = _Open(), _Open()
    starting: list[dict] = []  # left segments that begin where the last row does
    last = None

    def step(start: int | None = None, end: int = -1, first: int = 0, a: dict | None = None, b: dict | None = None):
        nonlocal last, starting
        if start is None:
            return ()
        left.drop_before(start - 1)
        right.drop_before(start)
        if start != last:
            last, starting = start, []
        if a is not None:
            if end < start:  # an empty one holds no end
                return ()
            found = [(a, x) for x in right.between(start, end)]  # right ones that start here too come later
            left.add(end, a)
            starting.append(a)
        elif end >= start:
            found = [(x, b) for x in left.between(start, end - 1)]
            right.add(end, b)
        else:  # an empty one: its start alone is within a segment that begins there, its end alone within one that ends before
            found = [(x, b) for x in [*starting, *left.between(end, end)]]
        return found if start >= first else ()

    return step


def matches(left: DataFrame, right: DataFrame, how: str = "includes", stretch: int = STRETCH) -> DataFrame:
    """(doc_id, left, right): the pairs of segments of a document where the left one ``includes`` or ``overlaps`` the right one, as above.

    Both tables have doc_id, start_off and end_off (``end_off = start_off - 1`` for an empty segment); ``left`` and ``right`` are
    structs of all columns but doc_id. A plane sweep: both tables are united, dealt out by document and stretch of it, sorted by
    start and read once, while segments that are still open are kept in the order of their ends, so a row looks at nothing but what it
    matches. One shuffle and no range join; a task holds open segments alone. A segment goes to each stretch that it reaches,
    and a pair is given where its later one starts.

    Rows of one doc_id, or of none, are of one document. Rows that repeat give pairs that repeat; those without offsets, or
    that end before ``start_off - 1``, match nothing; empty tables give no rows.
    """
    types = [StructType([f for f in t.schema.fields if f.name != "doc_id"]) for t in (left, right)]
    sides = []
    for side, rows in enumerate((left, right)):
        own = F.struct(*(F.col(c) for c in types[side].names))
        start, end = F.col("start_off").cast("long"), F.col("end_off").cast("long")
        both = [F.lit(None).cast(types[0]).alias("left"), F.lit(None).cast(types[1]).alias("right")]
        both[side] = own.alias(("left", "right")[side])
        reached = F.sequence(F.expr(f"cast(start_off as bigint) div {stretch}"), F.expr(f"(cast(end_off as bigint) + 1) div {stretch}"))
        kept = rows.filter("end_off >= start_off - 1")
        sides.append(kept.select("doc_id", start.alias("_start"), end.alias("_end"), F.lit(side).alias("_side"), *both, F.explode(reached).alias("_stretch")))
    swept = sides[0].unionByName(sides[1]).withColumns({
        "_key": F.struct("doc_id", "_stretch"), "_order": F.struct("_start", "_side"), "_first": F.col("_stretch") * stretch,
    })
    out = StructType([StructField(n, t) for n, t in zip(("left", "right"), types, strict=True)])
    found = folds.emitted(swept, "_order", ["_start", "_end", "_first", "left", "right"], {"includes": _including, "overlaps": _overlapping}[how], out, "_key")
    return found.select("_key.doc_id", "left", "right")
