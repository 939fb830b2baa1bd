"""Helpers shared by the operators: table access, tables kept in the shared folder, worker-side text helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None

#: What counts as a word everywhere in this subpackage: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, for texts can be long: a setting of the session, left alone where it is lower already."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    now = spark.conf.get(name, str(64 << 20)).rstrip("bB")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, f"{most}b")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table under ``sf_dir``; any other columns stay unread."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out to all for the Python work to come; larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, as in tests, a temporary one, if all runs in one process."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tolparse-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(few: DataFrame, at_most: int = 1 << 18) -> DataFrame:
    """``few`` for a join, sent to all tasks unless it has more rows than ``at_most``."""
    return F.broadcast(few) if few.count() <= at_most else few


def gone_of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(_row): of ``rows`` (_row, doc_id) all but one of each group (row, root); that of the smallest doc_id stays, null ids last, then of the smallest row."""
    ids = rows.select(F.col("_row").alias("row"), "doc_id").join(groups, "row")
    kept = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("kept")).select(F.col("kept.row").alias("row"))
    return written(groups.select("row").join(kept, "row", "left_anti").select(F.col("row").alias("_row")), "gone")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus
