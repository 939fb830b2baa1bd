"""Entities and batch statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds

_BREAKS = re.compile(r"[\n\r\t\f]+")


def select_entities(nodes: DataFrame, types: Iterable[str], names: Iterable[str] = ("name",)) -> DataFrame:
    """(doc_id, seq, type, value) from a ``nodes`` table: nodes by alias or symbol, with their direct name children's text, in one sorted pass.

    Two documents of one id are a ``ValueError``: their nodes cannot be told apart (``trees.numbered_documents`` gives them ids of their own).
    """
    types, names = frozenset(types), frozenset(names)

    def start():
        stack: list[tuple] = []  # open entities (end, id, type, values) and names (end, None, texts, their entity's values), outer ones first
        values_of: dict[int, list[str]] = {}
        before = -1

        def step(node: int | None = None, last: int = -1, parent: int | None = None, kind: str | None = None, alias: str | None = None, symbol: str | None = None, value=()):
            nonlocal before
            if node is not None and node <= before:
                raise ValueError("two documents share a doc_id; number them with trees.numbered_documents first")
            before = before if node is None else node
            out = []
            while stack and (node is None or stack[-1][0] < node):
                _, own, first, second = stack.pop()
                if own is None:
                    second.append(_BREAKS.sub(" ", "".join(first)))
                else:
                    out.append((own, first, " ".join(values_of.pop(own))))
            if node is None:
                return out
            if kind in names and parent in values_of:
                stack.append((last, None, [], values_of[parent]))
            if alias in types or symbol in types:
                values_of[node] = []
                stack.append((last, node, kind, None))
            if value:
                for _, own, texts, _ in stack:
                    if own is None:
                        texts += value
            return out

        return step

    return folds.emitted(nodes, "node_id", ["node_id", "last_desc", "parent_id", "type", "alias", "symbol", "value"], start, "seq int, type string, value string")


def count_by_type(entities: DataFrame) -> DataFrame:
    """Entities with a value, by type."""
    return entities.filter("value <> ''").groupBy("type").agg(F.count("*").alias("n"))


def split_by_outcome(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents parsed without error, the others) of ``frames.outcomes``; a text that is not there has no error."""
    return outcomes.filter(~F.col("has_error")), outcomes.filter(F.col("has_error"))


def top(stats: DataFrame, by: str, n: int = 5, tie: str = "doc_id") -> DataFrame:
    """The ``n`` rows that have most of ``by``; smaller ``tie`` first."""
    return stats.orderBy(F.desc(by), F.asc(tie)).limit(n)


def fold_stats(stats: DataFrame, reference_compat: bool = False, times: bool = False) -> DataFrame:
    """One row for all documents: sums, and the longest rollback; with ``times`` also the total milliseconds of parsing and of recovery.

    ``reference_compat``: rollbacks are summed, of recoveries in water the largest is taken, characters are left out.
    """
    total = lambda c: F.sum(c).cast("long").alias(c)
    most = lambda c: F.max(c).cast("long").alias(c)
    summed = [total("tokens_count"), total("recovery_times")]
    times = [F.sum(c).alias(c) for c in ("general_ms", "recovery_ms") if c in stats.columns and times]
    if reference_compat:
        return stats.agg(*summed, total("longest_rollback"), most("recovery_times_any"), *times)
    return stats.agg(total("chars_count"), *summed, most("longest_rollback"), total("recovery_times_any"), *times)


def render_stats(folded: DataFrame) -> DataFrame:
    """The folded statistics as one line of text; times as minutes, seconds and milliseconds."""

    def shown(c: str) -> Column:
        if not c.endswith("_ms"):
            return F.col(c).cast("string")
        ms = F.round(c).cast("long")
        return F.format_string("%02d:%02d.%03d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000)

    return folded.select(F.concat_ws("; ", *(F.concat(F.lit(f"{c}: "), shown(c)) for c in folded.columns)).alias("line"))
