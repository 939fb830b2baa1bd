"""Report files: blocks that begin with a line of three asterisks; tables of statistics and parse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "***"


def entity_report(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, line): each file's block: the mark, its path, then type and value on lines of their own."""
    pairs = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "value"))).alias("found"))
    text = F.array_join(F.transform("found", lambda e: F.concat_ws("\n", e["type"], e["value"])), "\n")
    body = F.when(F.size("found") > 0, F.concat(F.lit("\n"), text)).otherwise("")
    return files.join(pairs, "doc_id", "left").select("doc_id", F.concat(F.lit(f"{MARK}\n"), F.col("path"), F.coalesce(body, F.lit(""))).alias("line"))


def _block(path, found):
    """A file's block, from its path and its entities in order."""
    lines = F.transform(found, lambda e: F.concat(F.lit("\n"), e["type"], F.lit("\n"), e["value"]))
    return F.concat(F.lit(f"{MARK}\n"), path, F.array_join(F.coalesce(lines, F.array().cast("array<string>")), ""))


def write_outcomes_report(outcomes: DataFrame, path: str, grammar: str, folder: str) -> None:
    """The entity report of (path, entities): one text file a partition, no shuffle; the header in a folder of its own."""
    outcomes.select(_block(F.col("path"), F.col("entities"))).write.mode("overwrite").text(path)
    _write_header(outcomes.sparkSession, path, grammar, folder)


def write_entity_report(entities: DataFrame, files: DataFrame, path: str, grammar: str, folder: str) -> None:
    """One text file a partition, blocks in no order; grammar and folder in a header of the folder's own."""
    entity_report(entities, files).select("line").write.mode("overwrite").text(path)
    _write_header(entities.sparkSession, path, grammar, folder)


def _write_header(spark: SparkSession, path: str, grammar: str, folder: str) -> None:
    spark.createDataFrame([(f"{grammar}\n{folder}",)], "line string").coalesce(1).write.mode("append").text(f"{path}/header")


def _blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(report, block) of all files: what stands between two marks.

    The reader cuts files at their marks, as it would at line ends, so a report of any length is read by as many tasks as it has
    splits, and no row holds more than a block. All files end their lines as the first one does, with or without a carriage return.
    """
    head = spark.read.option("lineSep", "\n").text(path).first()
    end = "\r\n" if head and head[0].endswith("\r") else "\n"
    cut = spark.read.option("lineSep", f"{end}{MARK}{end}").text(path).select(F.input_file_name().alias("report"), "value")
    # a mark that follows another, or begins or ends a file, is still there
    block = F.regexp_replace("value", r"^(\*\*\*(\r?\n|$))+|\r?\n\*\*\*$", "")
    return cut.select("report", block.alias("block")).filter(F.trim("block") != "")


def read_entity_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq, type, value) of an entity report."""
    lines = F.split("block", r"\r?\n", -1)
    blocks = _blocks(spark, path).select(F.element_at(lines, 1).alias("file"), F.slice(lines, 2, F.size(lines)).alias("rest"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("rest") / 2) - 1), lambda k: F.struct(F.get("rest", 2 * k).alias("type"), F.get("rest", 2 * k + 1).alias("value")))
    return blocks.filter(F.size("rest") > 1).select("file", F.posexplode(pairs).alias("seq", "pair")).select("file", "seq", "pair.type", "pair.value")


def read_value_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(report, file, value) of a per-type report: a block's first line is its file."""
    lines = F.split("block", r"\r?\n", -1)
    rows = _blocks(spark, path).select("report", F.element_at(lines, 1).alias("file"), F.explode(F.slice(lines, 2, F.size(lines))).alias("value"))
    return rows.filter("value <> ''")


def write_value_report(entities: DataFrame, path: str) -> None:
    """A report for each entity type, in folders ``type=...`` below ``path``: (type, file, seq, value) as blocks of a file's values in order."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda e: F.concat(F.lit("\n"), e["value"]))
    blocks = entities.groupBy("type", "file").agg(F.concat(F.lit(f"{MARK}\n"), F.first("file"), F.array_join(values, "")).alias("block"))
    blocks.select("type", "block").write.mode("overwrite").partitionBy("type").text(path)


def report_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of ``write_value_report`` below ``path``, by a listing of its files alone."""
    return sorted({file.rsplit("/", 1)[0] for file in spark.read.text(path).inputFiles()})


def compare_reports(spark: SparkSession, left: str | list[str], right: str | list[str], path: str) -> None:
    """Value reports of two extractors, from files to files: what only one side has, by file, in folders ``left`` and ``right`` below ``path`` (and counted in ``surplus``)."""
    from ..operators import compare

    extra = compare.surplus(*(read_value_report(spark, p).select("file", "value") for p in (left, right)))
    extra.write.mode("overwrite").parquet(f"{path}/surplus")  # few rows; both sides come from them, so reports are read once
    write_differences(*compare.sides(spark.read.schema(extra.schema).parquet(f"{path}/surplus")), path)


def write_by_type(entities: DataFrame, path: str) -> None:
    """A folder for each entity type."""
    entities.write.mode("overwrite").partitionBy("type").parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def write_differences(only_left: DataFrame, only_right: DataFrame, path: str) -> None:
    """Both sides' leftovers, in folders of their own."""
    only_left.write.mode("overwrite").parquet(f"{path}/left")
    only_right.write.mode("overwrite").parquet(f"{path}/right")


def table_frame(spark: SparkSession, table) -> DataFrame:
    """(row, terminal, cell) of a parse table, for any of Spark's writers."""
    return spark.createDataFrame(table.rows(), "row string, terminal string, cell string")
