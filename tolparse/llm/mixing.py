"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the total size; a source's target
stops at ``max_repeat`` times its size, the excess is reshared by weight until none is above (water filling).

Sampling: each document of a source is expected ``target / source size`` times. Documents stand in the order (size
stratum, id and size scattered, id), so neighbours have near-equal sizes; the prefix sum of expected copies plus one offset per
source is taken, and a document is emitted once per integer boundary that its step crosses. A prefix sum over a source
that holds a third of all rows must not run in one task: the rank comes from three levels, the strata of a source (some
hundred at most), slices of a stratum (one for every ``SLICE`` rows of the table), and the rows of a slice.

Defined results: null texts have size 0; null sources are one source, the last; empty tables give no rows; repeated rows
are documents of their own; a source of size 0 has target 0 and takes nothing. A source's taken words differ from its target
by less than its largest document. One row for each source is held together, to set the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Slices of the scattered id at most, a power of two; rows of all sources and strata to a slice.
SCATTER, SLICE = 1 << 20, 1 << 14


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> plus ``target``; one row per source, so the windows below run over few rows."""
    by_name = W.Window.orderBy(F.col("source").isNull(), "source")
    filling = W.Window.orderBy("fills", "nr")
    whole = W.Window.partitionBy(F.lit(0))
    s = sources.withColumn("nr", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nr") % len(weights) + 1).cast("int")).cast("double")
    s = s.withColumns({"weight": weight, "cap": (F.col("source_size") * max_repeat).cast("double")})
    s = s.withColumns({"fills": F.col("cap") / F.col("weight"), "total": F.sum("source_size").over(whole).cast("double")})
    before = filling.rowsBetween(W.Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, W.Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    #: The first source, by how soon it fills, that its share leaves unfilled sets the level for all that follow.
    level = F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "nr", "level"))).over(whole)
    s = s.withColumn("level", level["level"])
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", share.alias("target"))


def _stratum(size: Column) -> Column:
    """Sizes in the order of their magnitude: bit length, then the three bits after the first."""
    bits = F.bin(size)
    return (F.length(bits) * 8 + F.conv(F.rpad(F.substring(bits, 2, 3), 3, "0"), 2, 10).cast("int")).cast("int")


def _offset(source: Column, seed: int) -> Column:
    """One offset in (0, 1) per source, from its name and the seed; a multiple of 2**-17, so prefix sums stay exact."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 4), 16, 10).cast("double") + 0.5) / 65536.0


def systematic_sample(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows that have an integer id, ``source`` and ``size``.

    All other columns pass through (those named like the added ones are replaced). ``copies`` is at most ``max_repeat``.
    The rows are evaluated twice, once for the counts; give a table, or something as cheap to compute again.
    """
    docs = docs.drop("source_size", "target", "copies")
    total = docs.count()
    slices = 1
    while slices * SLICE < total and slices < SCATTER:
        slices *= 2
    # the size takes part, so that null or repeated ids are not of one slice
    scatter = F.pmod(F.pmod(F.coalesce(F.col(id_col), F.lit(0)).cast("long"), F.lit(1_000_003)) * 7919 + F.col("size").cast("long") * 104_729, F.lit(SCATTER))
    keyed = docs.withColumns({
        "_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_stratum": _stratum(F.col("size")), "_scatter": scatter,
        "_slice": (scatter / (SCATTER // slices)).cast("int"),
    })
    name, rows = ["_null", "_source"], ["_null", "_source", "_stratum", "_slice"]
    sliced = keyed.groupBy(*rows).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    strata = sliced.groupBy(*name, "_stratum").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    before = lambda keys, order: W.Window.partitionBy(*keys).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = strata.withColumn("_before", F.coalesce(F.sum("n").over(before(name, "_stratum")), F.lit(0)))
    sources = strata.groupBy(*name).agg(F.sum("words").cast("long").alias("source_size")).withColumn("source", F.when(~F.col("_null"), F.col("_source")))
    targets = source_targets(sources.select("source", "source_size"), weights, max_repeat)
    targets = targets.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", _offset(F.col("source"), seed).alias("_offset"))
    inner = F.coalesce(F.sum("n").over(before([*name, "_stratum"], "_slice")), F.lit(0))
    places = (
        sliced.withColumn("_inner", inner).join(starts.select(*name, "_stratum", "_before").join(targets, name), [*name, "_stratum"])
        .select(*rows, (F.col("_before") + F.col("_inner")).alias("_start"), "source_size", "target", "_offset")
    )
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rank = (F.col("_start") + F.row_number().over(W.Window.partitionBy(*rows).orderBy("_scatter", id_col, "size"))).cast("double")
    ranked = keyed.join(places, rows).withColumns({"_rate": rate, "_rank": rank})
    crossed = lambda at: F.floor(F.col("_rate") * at + F.col("_offset"))
    return ranked.withColumn("copies", crossed(F.col("_rank")) - crossed(F.col("_rank") - 1.0)).drop(*rows, "_scatter", "_start", "_offset", "_rate", "_rank")
