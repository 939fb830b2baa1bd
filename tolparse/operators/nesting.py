"""Nesting of tokens in relational form: depth by windows, and the matching of brackets of several kinds in documents of any length."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import folds


def with_depth(tokens: DataFrame, left: Iterable[str], right: Iterable[str], column: str = "text") -> DataFrame:
    """Adds ``direction`` and ``depth``: an opener has the outer depth, its contents and closer one more."""
    left, right = list(left), list(right)
    step = F.when(F.col(column).isin(left), 1).when(F.col(column).isin(right), -1).otherwise(0)
    before = W.Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(W.Window.unboundedPreceding, -1)
    direction = F.when(F.col(column).isin(left), "down").when(F.col(column).isin(right), "up").otherwise("forward")
    return tokens.withColumns({"direction": direction, "depth": F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int")})


def next_at_level(tokens: DataFrame) -> DataFrame:
    """Adds ``next_idx``: the next token of the document at the same depth, which skipping a nested part leads to."""
    same = W.Window.partitionBy("doc_id", "depth").orderBy("tok_idx")
    return tokens.withColumn("next_idx", F.lead("tok_idx").over(same))


def unmatched(tokens: DataFrame, left: Iterable[str], right: Iterable[str], column: str = "text") -> DataFrame:
    """Per document: closers without an opener, and openers that are never closed, for one kind of pair."""
    step = F.when(F.col(column).isin(list(left)), 1).when(F.col(column).isin(list(right)), -1).otherwise(0)
    run = F.sum(step).over(W.Window.partitionBy("doc_id").orderBy("tok_idx"))
    low = tokens.select("doc_id", step.alias("step"), run.alias("run")).groupBy("doc_id").agg(F.least(F.min("run"), F.lit(0)).alias("low"), F.sum("step").alias("last"))
    return low.select("doc_id", (-F.col("low")).cast("long").alias("unopened"), (F.col("last") - F.col("low")).cast("long").alias("unclosed"))


# Brackets in stretches.

#: Tokens of a stretch: what one fold holds of a document.
STRETCH = 1 << 16


def _of_stretch():
    """Pairs within a stretch, and what is left open or closes what was opened before.

    Levels are those of a pair's outside, counted from the stretch's beginning. Any closer closes the innermost opener, of whatever kind.
    """
    opened: list[tuple[int, str]] = []
    low = 0

    def step(tok: int | None = None, kind: str | None = None, up: bool | None = None):
        nonlocal low
        if tok is None:
            return [(at, own, None, None, low + k) for k, (at, own) in enumerate(opened)]
        if not up:
            opened.append((tok, kind))
            return ()
        if opened:
            at, own = opened.pop()
            return [(at, own, tok, kind, low + len(opened))]
        low -= 1
        return [(None, None, tok, kind, low)]

    return step


def brackets(tokens: DataFrame, pairs: Mapping[str, tuple[Iterable[str], Iterable[str]]], column: str = "text", stretch: int = STRETCH) -> DataFrame:
    """(doc_id, open_idx, open_kind, close_idx, close_kind, level) for each pair, each closer without opener and each opener without closer.

    ``tokens``: doc_id, tok_idx and ``column``; ``pairs``: the texts that open and close each kind (no text is of two roles). A closer
    takes the innermost opener; where that is of another kind the two kinds differ, which is an error like a closer without
    opener (``first_errors``). ``level`` counts the pairs around, so an opener has that depth and its closer one more;
    behind a closer without opener it is one less.

    An associative reduction: stretches of a document are reduced to their own pairs, to the closers and openers left over, and to
    their rise. Rises are summed over a document's stretches, and what is left over meets at its level: a stretch leaves
    at most one closer and one opener at each. So a document of any length is the work of many tasks; none holds more than a
    stretch's openers. Null ids are an id; repeated ids are one document; tokens without an index are left out.
    """
    roles = [(text, name, up) for name, sides in pairs.items() for up, texts in enumerate(sides) for text in texts]
    lookup = F.create_map(*[x for text, name, up in roles for x in (F.lit(text), F.struct(F.lit(name).alias("kind"), F.lit(bool(up)).alias("up")))])
    marks = tokens.filter(F.col(column).isin([r[0] for r in roles]) & F.col("tok_idx").isNotNull()).withColumn("_role", lookup[F.col(column)])
    marks = marks.select(F.struct("doc_id", F.floor(F.col("tok_idx") / stretch).alias("_nr")).alias("_key"), F.col("tok_idx").cast("long").alias("tok_idx"), "_role.kind", "_role.up")
    found = folds.emitted(marks, "tok_idx", ["tok_idx", "kind", "up"], _of_stretch, "open_idx long, open_kind string, close_idx long, close_kind string, level long", "_key")
    # a stretch rises by its openers less its closers, so no second fold is needed to place what is left over
    rises = marks.groupBy("_key").agg(F.sum(F.when(F.col("up"), -1).otherwise(1)).alias("rise"))
    before = W.Window.partitionBy("_key.doc_id").orderBy("_key._nr").rowsBetween(W.Window.unboundedPreceding, -1)
    #: One row of each stretch, so the window holds no document's tokens.
    bases = rises.select(F.col("_key.doc_id").alias("_doc"), F.col("_key._nr").alias("_of"), F.coalesce(F.sum("rise").over(before), F.lit(0)).alias("_base"))
    placed = found.join(bases, F.col("_key.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key._nr") == F.col("_of")))
    placed = placed.select("_key.doc_id", "open_idx", "open_kind", "close_idx", "close_kind", (F.col("level") + F.col("_base")).alias("level"))
    # whole pairs are groups of their own, so the fold runs once for them and for what is left over
    whole = F.when(F.col("close_idx").isNotNull(), F.col("open_idx"))
    at_level = W.Window.partitionBy("doc_id", "level", whole).orderBy(F.coalesce("open_idx", "close_idx"))
    met = placed.withColumns({
        "_open": F.lag("open_idx").over(at_level), "_kind": F.lag("open_kind").over(at_level), "_closed": F.lead("close_idx").over(at_level).isNotNull(),
    }).filter(F.col("close_idx").isNotNull() | ~F.col("_closed"))
    own = F.col("open_idx").isNotNull()
    return met.withColumns({"open_idx": F.when(own, F.col("open_idx")).otherwise(F.col("_open")), "open_kind": F.when(own, F.col("open_kind")).otherwise(F.col("_kind"))}).select(*placed.columns)


def first_errors(matched: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, kind, expected): of ``brackets``, each document's first closer that closes nothing (``expected`` is null) or another kind."""
    wrong = matched.filter("close_idx is not null and (open_idx is null or open_kind <> close_kind)")
    first = wrong.groupBy("doc_id").agg(F.min_by(F.struct("close_idx", "close_kind", "open_kind"), "close_idx").alias("e"))
    return first.select("doc_id", F.col("e.close_idx").alias("tok_idx"), F.col("e.close_kind").alias("kind"), F.col("e.open_kind").alias("expected"))
