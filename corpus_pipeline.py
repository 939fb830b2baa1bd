"""From documents to packed sequences: quality filter, near-duplicate removal, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and is written to the shared folder
before the next one reads it. All but the last return the columns of documents.

Defined results: null texts count as empty ones, and are scored, fingerprinted and packed as such (in a mix they have size 0 and
are never taken); null and repeated ids are rows like any others; ties between documents of a group go to the smaller id and
row; empty tables give no rows; other columns than those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tolparse.llm import mixing, packing, quality, simhash, similar
from tolparse.llm.common import sent, table, word_count, written
from tolparse.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels of both kinds it rejects none."""
    docs = docs.select(*COLUMNS)
    machine = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.scores(docs, machine).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, null ids last, then of the smallest row.

    First those that SimHash links (fingerprints within two bits); of the rest, no two texts stay that have a five-word
    Jaccard index of 0.8 or more, which 64-bit fingerprints cannot tell (README). Repeated ids are documents of their own.
    """
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    for operator in (simhash, similar):
        rows = rows.join(sent(operator.duplicates(rows)), "_row", "left_anti")
    return rows.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it, from never to three times."""
    mixed = mixing.systematic_sample(docs.select(*COLUMNS).withColumn("size", word_count(F.col("text"))))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 4096."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The classifier, the fingerprints' hash and the tokenizer are beyond SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under ``sf_dir``."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
