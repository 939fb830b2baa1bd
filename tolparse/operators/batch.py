"""A batch: documents parsed once, all that comes of it written to one table, and reports fanned out from there.

    done = batch.run(files.read_files(spark, "src", "java"), catalog.grammar("java"), ["class", "method"], "out/java")
    done.totals                          # counts and times, gathered while the table was written
    done.failed.show(); done.slowest().show(); done.counts().show()
    done.write_reports("out/java-reports", "java", "src")

The only Python work is the pass that parses; totals come with the write as observed metrics, so they cost no second pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import frames
from ..parsing.engine import Parser
from ..sources import reports
from . import entities as ent

_SUMS = ("chars_count", "tokens_count", "recovery_times", "recovery_times_any")


def _metrics() -> list[Column]:
    """Totals over documents without error, and how many had one."""
    good = lambda c: F.when(~F.col("has_error"), F.col(f"stats.{c}"))
    sums = [F.coalesce(F.sum(good(c)), F.lit(0)).cast("long").alias(c) for c in _SUMS]
    times = [F.coalesce(F.sum(good(c)), F.lit(0.0)).alias(c) for c in ("general_ms", "recovery_ms")]
    return [F.count(F.lit(1)).alias("documents"), F.count_if(F.col("has_error")).alias("failed"), *sums, F.coalesce(F.max(good("longest_rollback")), F.lit(0)).cast("long").alias("longest_rollback"), *times]


@dataclass
class Batch:
    """What a batch left: the table at ``path``, and its totals."""

    spark: SparkSession
    path: str
    totals: dict[str, int | float]

    @property
    def outcomes(self) -> DataFrame:
        """A row for each document: its columns but the text, has_error, stats, messages and entities (and nodes, if they were wanted)."""
        return self.spark.read.parquet(self.path)

    @property
    def failed(self) -> DataFrame:
        """(doc_id, first error) of the documents left out of all else, with the other columns that they came with."""
        first = F.get(F.filter("messages", lambda m: m["type"] == "error"), 0)
        added = ("has_error", "stats", "entities", "nodes")
        return self.outcomes.filter("has_error").select(*(c for c in self.outcomes.columns if c not in (*added, "messages")), first.alias("error"))

    @property
    def stats(self) -> DataFrame:
        return self.outcomes.filter("stats is not null").select("doc_id", "stats.*")

    def _exploded(self, what: str) -> DataFrame:
        return self.outcomes.select("doc_id", F.explode(what).alias("x")).select("doc_id", "x.*")

    @property
    def messages(self) -> DataFrame:
        return self._exploded("messages")

    @property
    def entities(self) -> DataFrame:
        return self._exploded("entities")

    @property
    def nodes(self) -> DataFrame:
        return self._exploded("nodes")

    def counts(self) -> DataFrame:
        """Entities with a value, by type."""
        return ent.count_by_type(self.entities)

    def most(self, by: str, n: int = 5) -> DataFrame:
        """The ``n`` documents without error that have most of a statistic."""
        return ent.top(self.stats.filter("not has_error"), by, n)

    def slowest(self, n: int = 5) -> DataFrame:
        return self.most("general_ms", n)

    def longest_recoveries(self, n: int = 5) -> DataFrame:
        return self.most("recovery_ms", n)

    def totals_frame(self) -> DataFrame:
        """The totals as a row."""
        return self.spark.createDataFrame([self.totals], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in self.totals.items()))

    def write_reports(self, folder: str, grammar: str, source: str, path: str = "path") -> None:
        """The entity report of all files, the statistics as JSON, and the files with errors, below ``folder``."""
        good = self.outcomes.filter("not has_error")
        reports.write_outcomes_report(good.select(F.col(path).alias("path"), "entities"), f"{folder}/entities", grammar, source)
        reports.write_stats(self.stats.filter("not has_error"), f"{folder}/stats")
        self.failed.write.mode("overwrite").json(f"{folder}/failed")


def run(docs: DataFrame, parser: Parser, types: Iterable[str], path: str, names: Iterable[str] = ("name",), nodes: bool = False, tag: str | None = None) -> Batch:
    """Parses each of ``docs`` once and writes what comes of it to a new table at ``path``.

    ``tag``: jobs carry it while the batch runs, so another thread can follow them or end them (``cancel``).
    """
    spark = docs.sparkSession
    want = ["stats", "messages", "entities", *(["nodes"] if nodes else [])]
    seen = Observation()
    found = frames.outcomes(docs, parser, want, types, names).drop("text").observe(seen, *_metrics())
    if tag:
        spark.sparkContext.addJobTag(tag)
    try:
        found.write.parquet(path)
    finally:
        if tag:
            spark.sparkContext.removeJobTag(tag)
    return Batch(spark, path, dict(seen.get))


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the batch that runs under ``tag``."""
    spark.sparkContext.cancelJobsWithTag(tag)
