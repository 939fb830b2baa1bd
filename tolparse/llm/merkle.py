"""Merkle manifest of a table: a tree of hashes for each group, a tree over the groups' roots, and a proof for every row.

Leaves are numbered by ``row_number`` within their group. A step of the tree is a DataFrame: nodes are grouped by their index
floor-divided by the step's width, and the sorted child arrays are hashed into parents, level by level. On the way back
each step joins its children to their parents' paths and appends the siblings of every level, so the rows that carry a path
shrink as fast as the nodes do. A step spans ``LEVELS`` levels of fanout 2 (with ``levels=1`` each level is a step of
its own); no row holds more than fanout ** levels nodes.

A group may hold any share of the rows: its leaves are dealt out by range of (group, order, row), numbered within a range, and
shifted by the counts of the ranges before. No action depends on the number of groups; the driver learns the largest group's
size and nothing else.

Defined results: a null value is ``-`` and an empty one ``0:``; null ids come first within a group, null groups first of all; rows
that repeat are leaves of their own (their order does not matter, for they are equal); a null id is never tampered with; a
single leaf is its group's subroot, a single subroot the root, and a proof without siblings the hash of nothing; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

FANOUT, LEVELS = 2, 5
#: Rows of a task at least, where fewer tasks than shuffle partitions suffice.
ROWS = 1 << 13
_PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def encoded(values: Iterable[Column]) -> Column:
    """Values one after the other, each as ``-`` or as its size in bytes, a colon and itself."""
    shown = [v.cast("string") for v in values]
    return F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (a table) with ``idx``, from 0 within each group, and ``n``, the group's rows; a null group is a group, and the first."""
    lead = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_row")]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*lead).withColumn("_range", F.spark_partition_id())
    tasks = _tasks(rows.count())
    ranged = written(ranged.coalesce(tasks), "ranged")
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_count"))
    whole = W.Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"), F.sum("_count").over(whole).alias("n")
    )
    place = F.row_number().over(W.Window.partitionBy("_range", group).orderBy(*lead[1:])) - 1
    placed = ranged.withColumn("_place", place).join(F.broadcast(starts) if _few(starts) else starts, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.withColumn("idx", (F.col("_start") + F.col("_place")).cast("long")).drop("_row", "_range", "_of", "_group", "_start", "_place", "_count")


def _tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def _few(rows: DataFrame, at_most: int = 1 << 16) -> bool:
    return rows.limit(at_most + 1).count() <= at_most


def _runs(nodes: Column, fanout: int) -> Column:
    """Consecutive runs of ``fanout`` nodes, the last one maybe of fewer, each as one text."""
    starts = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(fanout))
    return F.transform(starts, lambda k: F.array_join(F.slice(nodes, k + 1, F.lit(fanout)), ""))


class Step:
    """Some levels of all trees: ``rows`` (group, block, depth, c0 ... c<levels>, kept) hold the children of each block and their ancestors within it."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int, kept: list[str], name: str):
        """``nodes``: a table (group, idx, n, digest, and the columns ``kept``)."""
        width, self.tasks = fanout**levels, _tasks(nodes.count())
        children = F.sort_array(F.collect_list(F.struct("idx", "digest", *kept)))
        rows = nodes.groupBy("group", F.expr(f"idx div {width}").alias("block")).agg(children.alias("children"), F.max("n").alias("n"))
        height = F.lit(0)  # levels that the tree still has, as far as they are of this step
        for k in range(levels):
            height = height + (F.col("n") > fanout**k).cast("int")
        rows = rows.withColumns({"depth": height, "c0": F.transform("children", lambda c: c["digest"])})
        for k in range(levels):
            above = F.transform(_runs(F.col(f"c{k}"), fanout), digest)
            rows = rows.withColumn(f"c{k + 1}", F.when(F.col("depth") > k, above).otherwise(F.col(f"c{k}")))
        self.fanout, self.levels, self.kept = fanout, levels, kept
        self.rows = written(rows.coalesce(self.tasks), name)

    def parents(self) -> DataFrame:
        """(group, idx, n, digest) of the blocks' tops."""
        width = self.fanout**self.levels
        return self.rows.select("group", F.col("block").alias("idx"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col(f"c{self.levels}")[0].alias("digest"))

    def children(self, paths: DataFrame) -> DataFrame:
        """(group, idx, path, digest, kept): the children's paths from those of the tops, (group, idx, path)."""
        above = paths.select(F.col("group").alias("_group"), F.col("idx").alias("_block"), "path")
        rows = self.rows.join(above, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
        rows = rows.select("path", "group", "depth", *(f"c{k}" for k in range(self.levels)), F.posexplode("children").alias("_pos", "child"))
        own = []
        for k in range(self.levels):
            at = F.expr(f"_pos div {self.fanout**k}").cast("int")
            first = at - at % self.fanout
            siblings = F.struct(
                F.array_join(F.slice(f"c{k}", first + 1, at - first), "").alias("before"), F.array_join(F.slice(f"c{k}", at + 2, first + self.fanout - at - 1), "").alias("after")
            )
            own.append(F.when(F.col("depth") > k, siblings))
        path = F.concat(F.array_compact(F.array(*own)), "path")
        return rows.select("group", "child.idx", path.alias("path"), "child.digest", *(f"child.{c}" for c in self.kept))


def _grown(nodes: DataFrame, fanout: int, levels: int, kept: list[str], name: str) -> tuple[list[Step], DataFrame]:
    """The steps from ``nodes`` to the trees' roots, and the roots (group, digest)."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    steps, now = [], nodes
    while not steps or largest > 1:
        steps.append(Step(now, fanout, levels, kept if not steps else [], f"{name}-{len(steps)}"))
        now = steps[-1].parents()
        largest = -(-largest // fanout**levels)
    return steps, now.select("group", "digest")


def _descended(steps: list[Step], paths: DataFrame) -> DataFrame:
    """From the roots' paths (group, path) to those of the first step's children."""
    paths = paths.withColumn("idx", F.lit(0).cast("long"))
    for k, step in reversed(list(enumerate(steps))):
        paths = step.children(paths)
        if k:
            paths = written(paths.select("group", "idx", "path").coalesce(step.tasks), "merkle-paths")
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda own, s: digest(F.concat(s["before"], own, s["after"])))


def manifest(leaves: DataFrame, group: str, order: list[str], kept: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each row of ``leaves`` (group, order columns, ``digest``, kept columns): kept, leaf, subroot, root and path.

    A path has an entry for each level from the leaf to the root: the digests of the siblings before and after the node, joined.
    """
    rows = numbered(leaves, group, order).select(F.col(group).alias("group"), "idx", "n", "digest", *kept)
    steps, subroots = _grown(written(rows.coalesce(_tasks(leaves.count())), "leaves"), fanout, levels, kept, "merkle")
    subroots = written(subroots.withColumn("_one", F.lit(0)), "subroots")
    tops = numbered(subroots, "_one", ["group"]).select(F.col("_one").alias("group"), "idx", "n", "digest", F.col("group").alias("of"))
    over, roots = _grown(written(tops, "tops"), fanout, levels, ["of"], "merkle-top")
    start = roots.select("group", F.array().cast(_PATH).alias("path"))
    tops = _descended(over, start).join(F.broadcast(roots.select("group", F.col("digest").alias("root"))), "group")  # one row
    tops = written(tops.select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot"), "root"), "top-paths")
    found = _descended(steps, tops.select("group", "path"))
    named = tops.select(F.col("group").alias("_of"), "subroot", "root")
    named = F.broadcast(named) if _few(named) else named
    return found.join(named, F.col("group").eqNullSafe(F.col("_of"))).select(*kept, F.col("digest").alias("leaf"), "subroot", "root", "path")


def verified(docs: DataFrame, tampered: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents by ``lang``, checked against rows of which some have been tampered with.

    ``docs``: doc_id, source, lang, n_chars, text. Where ``tampered`` holds, 1 is added to n_chars before the row's leaf is computed again.
    """
    leaf = lambda n_chars: digest(encoded([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]))
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("digest"), F.when(F.coalesce(tampered, F.lit(False)), leaf(F.try_add("n_chars", F.lit(1)))).alias("other"))
    found = manifest(written(rows, "digests"), "lang", ["doc_id", "digest"], ["doc_id", "other"], fanout, levels)
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    again = folded(F.coalesce("other", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
