"""Approximate nearest neighbours by an inverted multi-index, cosine measure.

Both halves of the unit vectors are quantised separately; a cell is a pair of centroids. A query visits cells in the
order of its summed distance to their two centroids, by a heap, until they hold the share of all entries that the
fit found necessary; their entries are reranked by the exact cosine of the original vectors.

Centroids, and the share to visit (so that ``RECALL`` of the true neighbours of a sample's queries are met), are fitted on
at most ``SAMPLE`` vectors in hash order of their ids; every vector is indexed. Equal vectors are one entry that lists its
k + 1 smallest ids: no other of its ids can be among anyone's k nearest. Entries of a first-half centroid are cut into
blocks, queries likewise, so that a task holds one block of each at a time, however full a cell is.

Defined results: vectors that are null, empty, zero, of another than the most common dimension, or that hold null or
non-finite components take no part; repeated rows count once; no candidates, no rows; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

K, SAMPLE, PROBES, RECALL, ENTRY_BLOCK, QUERY_BLOCK, SALTS = 5, 16_384, 384, 0.96, 4096, 1024, 16


def _lloyd(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), count, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        size = np.bincount(near, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


class MultiIndex:
    """Two codebooks, and the share of all entries that a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.share = first, second, 1.0
        self.half = first.shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((h**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * h @ c.T for h, c in ((unit[:, : self.half], self.first), (unit[:, self.half :], self.second)))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(unit)
        return a.argmin(axis=1), b.argmin(axis=1)

    @staticmethod
    def traverse(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """All cells by ascending a[i] + b[j]: the heap holds the frontier of visited pairs of ranks."""
        oa, ob = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        sa, sb = a[oa].tolist(), b[ob].tolist()
        heap, n, m = [(sa[0] + sb[0], 0, 0)], len(sa), len(sb)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield oa[i], ob[j]
            if not i and j + 1 < m:
                heapq.heappush(heap, (sa[0] + sb[j + 1], 0, j + 1))
            if i + 1 < n:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))

    def visits(self, unit: np.ndarray, counts: np.ndarray, budget: int) -> list[np.ndarray]:
        """For each query the cells (i * cells + j) it visits until they hold ``budget`` entries."""
        a, b = self.distances(unit)
        width, out = counts.shape[1], []
        for x, y in zip(a, b, strict=True):
            held, cells = 0, []
            for i, j in self.traverse(x, y):
                if counts[i, j]:
                    cells.append(i * width + j)
                    held += counts[i, j]
                    if held >= budget:
                        break
            out.append(np.array(cells, np.int64))
        return out

    @classmethod
    def fit(cls, sample: np.ndarray, entries: int, k: int = K, recall: float = RECALL) -> MultiIndex:
        """``sample``: distinct vectors; ``entries``: how many the index will hold, which sets the codebooks' size (8 to 512)."""
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        rng, half = np.random.default_rng(11), unit.shape[1] // 2
        size = min(len(unit), max(8, min(512, round(2 ** (np.log2(max(2, entries)) / 2 - 2)))))
        index = cls(_lloyd(unit[:, :half], size, rng), _lloyd(unit[:, half:], size, rng))
        i, j = index.cells(unit)
        cell = i * len(index.second) + j
        counts = np.bincount(cell, minlength=len(index.first) * len(index.second)).reshape(len(index.first), -1)
        needed = []
        for q in range(0, len(unit), max(1, len(unit) // PROBES)):
            score = unit @ unit[q]
            score[q] = -np.inf
            true = np.argsort(-score)[: min(k, len(unit) - 1)]
            held, wanted = 0, Counter(cell[true].tolist())
            a, b = index.distances(unit[q : q + 1])
            for x, y in index.traverse(a[0], b[0]):
                held += counts[x, y]
                needed += [held / len(unit)] * wanted.pop(x * counts.shape[1] + y, 0)
                if not wanted:
                    break
        index.share = float(np.quantile(needed, recall)) if needed else 1.0
        return index


def _doubles(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _block_search(k: int):
    def search(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best ids of this block for each of its queries, over the cells that the query visits."""
        none = pd.DataFrame({"q": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "own": pd.Series(dtype="bool")})
        if entries.empty or queries.empty:
            return none
        entries = entries.assign(least=[int(x[0]) for x in entries["ids"]]).sort_values(["second", "least"], kind="stable")
        e, q = (np.stack([np.asarray(v, np.float64) for v in f["vector"]]) for f in (entries, queries))
        score = (q @ e.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(e, axis=1)
        seconds, ids, least = entries["second"].to_numpy(), entries["ids"].tolist(), entries["least"].to_numpy()
        keys, rows = entries["key"].tolist(), []
        for n, (query, key, cells) in enumerate(zip(queries["q"].tolist(), queries["key"].tolist(), queries["cells"], strict=True)):
            at = np.flatnonzero(np.isin(seconds, cells))
            if len(at) > 2 * k + 2:  # all that tie with the k + 1st best stay for the exact order
                own = score[n, at]
                at = at[own >= np.partition(own, len(own) - k - 1)[len(own) - k - 1]]
            own = score[n, at]
            best = at[np.lexsort((least[at], -own))][: k + 1]
            found = sorted((-score[n, x], int(i), keys[x] == key) for x in best for i in ids[x])[: k + 1]
            rows += [(query, i, -s, own) for s, i, own in found]
        return pd.DataFrame(rows, columns=["q", "vec_id", "score", "own"]) if rows else none

    return search


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` (a column) holds."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks")).filter(F.col("id").isNotNull() & (F.size("vector") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    common = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], result)
    v = v.filter(F.size("vector") == common["n"]).withColumn("key", F.xxhash64("vector"))
    v = v.groupBy("id", "key", "vector").agg(F.max("asks").alias("asks"))  # repeated rows count once, and no vector's repeats meet
    same = W.Window.partitionBy("key", "vector").orderBy("id")
    distinct = v.withColumn("nr", F.row_number().over(same)).filter(F.col("nr") <= k + 1)
    entries = written(distinct.groupBy("key", "vector").agg(F.sort_array(F.collect_set("id")).alias("ids")), "entries")
    total = entries.count()
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), "key").limit(SAMPLE).select("vector").toArrow()
    index = MultiIndex.fit(_doubles(sample.column(0).combine_chunks()), total, k, recall)
    budget = max(k + 1, int(np.ceil(index.share * total)))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                x = _doubles(part.column(1))
                i, j = index.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["key", "vector", "ids", "first", "second"])

    kind = entries.schema["vector"].dataType.simpleString()
    placed = written(entries.select("key", "vector", "ids").mapInArrow(place, f"key long, vector {kind}, ids array<long>, first int, second int"), "index")
    counts = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in placed.groupBy("first", "second").count().collect():  # at most 512 * 512 cells
        counts[r["first"], r["second"]] = r["count"]

    def visit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                own = part.slice(at, 256)
                x = _doubles(own.column(1))
                rows, first, seconds = [], [], []
                for n, cells in enumerate(index.visits(x / np.linalg.norm(x, axis=1, keepdims=True), counts, budget)):
                    for i in np.unique(cells // counts.shape[1]).tolist():
                        rows.append(n)
                        first.append(i)
                        seconds.append((cells[cells // counts.shape[1] == i] % counts.shape[1]).astype(np.int32))
                taken = own.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(first, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], ["q", "vector", "key", "first", "cells"])

    asks = v.filter("asks").select("id", "key", "vector")
    # a question is a vector, whatever the ids of the rows that ask it; its number is kept by the table
    questions = written(asks.select("key", "vector").distinct().select(F.monotonically_increasing_id().alias("q"), "vector", "key"), "questions")
    visits = written(questions.mapInArrow(visit, f"q long, vector {kind}, key long, first int, cells array<int>"), "visits")
    entry_blocks = np.maximum(1, -(-counts.sum(axis=1) // ENTRY_BLOCK)).tolist()
    query_blocks = max(1, -(-questions.count() // QUERY_BLOCK))
    blocks = F.element_at(F.array(*map(F.lit, entry_blocks)), F.col("first") + 1)  # a number for each of at most 512 centroids
    visits = visits.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int"))
    # cells meet blocks of queries before vectors do: an entry goes to the blocks of which some query visits its cell
    wanted = visits.groupBy("first", "qb").agg(F.array_distinct(F.flatten(F.collect_set("cells"))).alias("seconds")).toDF("of", "block", "seconds")  # 1,024 queries' cells
    meets = (F.col("first") == F.col("of")) & F.array_contains("seconds", F.col("second"))
    dealt = placed.join(wanted, meets).drop("of", "seconds").withColumn("eb", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    asked = visits.withColumn("eb", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    found = dealt.groupBy("first", "eb", "block").cogroup(asked.groupBy("first", "eb", "qb")).applyInPandas(_block_search(k), "q long, vec_id long, score double, own boolean")
    order = [F.desc("score"), F.asc("vec_id")]
    top = found.withColumn("place", F.row_number().over(W.Window.partitionBy("q").orderBy(*order))).filter(F.col("place") <= k + 1)
    lists = top.groupBy("q").agg(F.collect_list(F.struct("place", "vec_id", "score", "own")).alias("found"))
    # many queries can have one vector, so they are dealt out: each answer has a copy for each of SALTS parts
    answers = questions.join(lists, "q").select("key", "vector", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = asks.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    answered = salted.join(answers, ["key", "vector", "salt"]).select(F.col("id").alias("query_id"), "found")
    others = F.slice(F.filter(F.sort_array("found"), lambda x: ~x["own"] | (x["vec_id"] != F.col("query_id"))), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
