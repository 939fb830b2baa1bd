"""Reports of two extractors side by side: renaming, chunking, and what only one of them has."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_types(entities: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Entity types renamed, or grouped under one name; others stay."""
    if not names:
        return entities
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return entities.withColumn("type", F.coalesce(F.create_map(*pairs)[F.col("type")], F.col("type")))


def chunk_values(entities: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Values of the given types split at blanks into chunks of so many words, a row each; others stay."""
    if not sizes:
        return entities
    size = F.coalesce(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("type")], F.lit(0))
    words = F.filter(F.split("value", " "), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.greatest(size, F.lit(1)))
    chunks = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.greatest(size, F.lit(1))), " "))
    parts = F.when(size > 0, F.filter(chunks, lambda c: c != "")).otherwise(F.array("value"))
    others = [c for c in entities.columns if c != "value"]
    return entities.select(*others, F.explode(parts).alias("value"))


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """(columns, _n): rows that one side has more often, and by how many: positive where it is the left one, negative where it is the right one.

    Each side is read once; equal rows are counted before they are dealt out, so a value that repeats a million times is a row a task.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).cast("long").alias("_n")).unionByName(right.select(*columns, F.lit(-1).cast("long").alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")


def difference(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that only the left, and only the right one has, as bags: each pair of equal rows cancels out."""
    return sides(surplus(left, right))


def sides(extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``surplus``, what only the left, and only the right one has."""
    columns = [c for c in extra.columns if c != "_n"]
    return _repeated(extra, F.col("_n"), columns), _repeated(extra, -F.col("_n"), columns)


def symmetric(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of the two has, as bags, in one pass over both."""
    return _repeated(surplus(left, right), F.abs("_n"), left.columns)


def _repeated(rows: DataFrame, times: Column, columns: list[str], most: int = 1 << 12) -> DataFrame:
    """``columns`` of each row so many times; in two steps, so that no array is longer than ``most`` or a surplus's number of such arrays."""
    parts = rows.withColumn("_n", times.cast("long")).filter("_n > 0").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most))))
    return parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.col("_n") - F.col("_part") * most)))).select(*columns)


def by_file(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("type", "doc_id")) -> DataFrame:
    """Counts on either side for each key; a file that one side lacks counts 0 there."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = n(left, "n_left").join(n(right, "n_right"), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def report_pairs(paths: DataFrame, column: str = "path") -> DataFrame:
    """Report files in pairs: (prefix before the last underscore, first path, second path)."""
    prefix = F.regexp_extract(column, r"^(.*)_[^_]*$", 1)
    grouped = paths.filter(F.col(column).rlike("_")).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("second"))
    return grouped.filter("n = 2").drop("n")
