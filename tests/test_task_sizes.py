from pyspark.sql import functions as F

from tolparse.operators import grammars
from tolparse.plans import queries


def test_larger_tables_make_more_tasks_not_longer_ones(spark, tmp_path):
    """Before, a scan of as many partitions as cores was read as it was, however long the work on each of its rows."""
    rows = spark.range(40_000).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("a bc").alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        sizes = [r["count"] for r in queries.turns(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 40_000 and max(sizes) <= 1000


def test_counts_of_terminals_below(spark):
    text = "T1 : 'a'\nT2 : 'b'\nr1 = T1 r2 |\nr2 = T2\nr3 =\n%%\n%parsing start r1\n"
    docs = spark.createDataFrame([(1, text), (2, "?")], "doc_id long, text string")
    found = grammars.analysis(docs, ["reachable_count"]).collect()
    assert {(r.doc_id, r.kind, r.rule, r.n) for r in found if r.kind != "error"} == {(1, "reachable_count", "r1", 2), (1, "reachable_count", "r2", 1)}
    assert [r.doc_id for r in found if r.kind == "error"] == [2]
