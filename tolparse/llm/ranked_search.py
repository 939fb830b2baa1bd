"""Ranked lexical search: the best documents for each of a set of questions, by a threshold-seeded join.

One pass over the texts leaves an index of the documents: their terms that some question has, with frequencies, and their
number of all terms. From it come the corpus statistics, and for each term the stored bounds: its largest impact, and the kth
largest, rounded down to a step of ``STEP``.

* Seed: at least k documents reach the kth impact of a term, so the largest kth impact of a question's terms bounds its kth
  score from below. Within a task the bound rises to the kth best score found so far.
* Pruning: a question's terms are ordered by their largest impact; the terms at the end whose largest impacts together stay
  below the bound cannot lift a document to it. Only the terms before them generate candidates.
* Candidates: pairs of document and question that share one of these terms, from a join of the index with the questions' terms;
  those whose impacts so far and what the pruned terms can add stay below the bound are dropped. What reaches it
  exactly is kept, for ties go to the smaller id.
* Rescoring: the exact integer score of each candidate, over all of the question's terms. A task keeps its k best of each
  question, and these are ranked in two rounds, the first over parts of a question's candidates.

Questions are taken in blocks of ``BLOCK``, so what is sent to the tasks is bounded by the questions' texts alone. Every
document is joined; nothing is sampled or cut.

Defined results: null texts have no terms, documents and questions without terms have no rows; documents without a question's
terms are not among its results; rows that repeat are documents and questions of their own; ties go to the smaller id, null
ids last; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

K, STEP, BLOCK, DOCS = 50, 1024, 1024, 256
SCALE, SATURATION, SLOPE = 1_000_000_000, 1000, 20
_INDEX = "doc_id long, n long, terms array<int>, freqs array<long>"
#: Bytes as terms see them: ASCII letters in lower case, digits and all beyond ASCII; blanks for the rest.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in b"".join(bytes([c]).lower() for c in range(256)))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_BYTES).split()


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, freqs) of each row of (doc_id, text): its number of terms, and those of the vocabulary with their frequencies."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for part in parts:
            for at in range(0, part.num_rows, DOCS):
                own, sizes, terms, freqs = part.slice(at, DOCS), [], [], []
                for text in own.column(1).to_pylist():
                    words = terms_of(text)
                    counts = Counter(words)
                    found = [w for w in counts if w in number]
                    sizes.append(len(words))
                    terms.append([number[w] for w in found])
                    freqs.append([counts[w] for w in found])
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, kind) for c, kind in zip((sizes, terms, freqs), kinds, strict=True))], ["doc_id", "n", "terms", "freqs"])

    return docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string"))).mapInArrow(batches, _INDEX)


def _length_norm(n: Column | int, docs: int, terms: int):
    """50 for a document without terms, 100 for one of mean length; Python's integers or a column's, without overflow."""
    if isinstance(n, int):
        return 50 + 50 * n * docs // terms
    return (F.expr(f"(cast(50 as decimal(38, 0)) * n * {docs}L) div {terms}L") + 50).cast("long")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def term_bounds(indexed: DataFrame, docs: int, terms: int, k: int = K) -> DataFrame:
    """(term, df, most, kth): the documents that hold each term, and the largest and kth largest of its frequency part there; kth is rounded down, 0 where fewer hold it."""
    held = indexed.select(_length_norm(F.col("n"), docs, terms).alias("m"), F.explode(F.arrays_zip("terms", "freqs")).alias("t")).select("m", F.col("t.terms").alias("term"), F.col("t.freqs").alias("tf"))
    impact = F.expr(f"({SCALE} * tf) div ({SATURATION} * tf + {SLOPE} * m)")
    steps = held.withColumn("impact", impact).groupBy("term", F.expr(f"impact div {STEP}").alias("step")).agg(F.count("*").alias("docs"), F.max("impact").alias("most"))
    above = W.Window.partitionBy("term").orderBy(F.desc("step"))
    reached = steps.withColumn("_docs", F.sum("docs").over(above))
    return reached.groupBy("term").agg(
        F.sum("docs").alias("df"), F.max("most").alias("most"), F.coalesce(F.max(F.when(F.col("_docs") >= k, F.col("step"))) * STEP, F.lit(0)).alias("kth")
    )


class Questions:
    """Questions with their terms by falling largest impact, and lower bounds of their kth scores; plain arrays of the size of the questions."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray, most: np.ndarray, kth: np.ndarray, k: int):
        self.k, self.weights = k, weights
        upper = weights * most
        self.terms = [np.array(sorted(own, key=lambda t: -upper[t]), np.int64) for own in terms]
        self.rest = [np.append(np.cumsum(upper[own][::-1])[::-1], 0) for own in self.terms]
        self.seeds = np.array([max([1, *(weights[own] * kth[own])]) for own in self.terms], np.int64)

    def essential(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms that generate candidates, as lists of questions by term (starts, questions), and what the other terms of each question can add."""
        kept = [int(np.count_nonzero(rest[:-1] >= least)) for rest, least in zip(self.rest, bounds, strict=True)]
        term = np.concatenate([own[:n] for own, n in zip(self.terms, kept, strict=True)] or [np.zeros(0, np.int64)])
        question = np.repeat(np.arange(len(kept)), kept)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(self.weights) + 1))
        return starts, question[order], np.array([rest[n] for rest, n in zip(self.rest, kept, strict=True)], np.int64)


class Best:
    """The k best documents of each question so far, smaller ids first among equals, null ids last."""

    def __init__(self, questions: Questions):
        self.k, self.bounds = questions.k, questions.seeds.copy()
        self.found = [(np.zeros(0, np.int64),) * 3 for _ in questions.terms]

    def add(self, question: int, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        score, none, doc = (np.concatenate(x) for x in zip(self.found[question], (score, none, doc), strict=True))
        first = np.lexsort((doc, none, -score))[: self.k]
        self.found[question] = score[first], none[first], doc[first]
        if len(first) == self.k:
            self.bounds[question] = max(self.bounds[question], score[first[-1]])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _scored(block: pa.RecordBatch, questions: Questions, best: Best, docs: int, terms: int) -> None:
    """Joins some documents of the index with the questions."""
    n = np.array([_length_norm(x, docs, terms) for x in block.column(1).to_pylist()], np.int64)
    sizes = np.diff(block.column(2).offsets.to_numpy())
    doc = np.repeat(np.arange(len(n)), sizes)
    term, tf = block.column(2).flatten().to_numpy().astype(np.int64), block.column(3).flatten().to_numpy()
    impact = questions.weights[term] * (SCALE * tf // (SATURATION * tf + SLOPE * n[doc]))
    starts, of, rest = questions.essential(best.bounds)
    many = starts[term + 1] - starts[term]
    question = of[_ranges(starts[term], many)]
    pair = np.repeat(doc, many) * len(rest) + question
    sums = np.bincount(pair, np.repeat(impact, many), len(n) * len(rest)).astype(np.int64).reshape(len(n), len(rest))  # below 2**53, so exact
    at, asked = np.nonzero((sums > 0) & (sums + rest >= best.bounds))
    if not len(at):
        return
    ids = block.column(0)
    none, own = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
    width = len(questions.weights)
    place = doc * width + term  # of each impact, were the documents rows of a table; sorted, for looking them up
    by_place = np.argsort(place)
    place, impact = np.append(place[by_place], len(n) * width), np.append(impact[by_place], 0)
    order = np.argsort(asked, kind="stable")
    at, asked = at[order], asked[order]
    for q in np.unique(asked):
        here = at[np.searchsorted(asked, q) : np.searchsorted(asked, q, "right")]
        wanted = here[:, None] * width + questions.terms[q]
        there = np.searchsorted(place, wanted)
        score = np.where(place[there] == wanted, impact[there], 0).sum(axis=1)
        good = score >= best.bounds[q]
        best.add(q, score[good], none[here][good], own[here][good])


def _candidates(indexed: DataFrame, questions: Questions, docs: int, terms: int) -> DataFrame:
    """(question, score, none, doc_id): of each task's documents the k best of each question."""
    sent = indexed.sparkSession.sparkContext.broadcast(questions)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(asked)
        for part in parts:
            for at in range(0, part.num_rows, DOCS):
                _scored(part.slice(at, DOCS), asked, best, docs, terms)
        for q, (score, none, doc) in enumerate(best.found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), q, np.int64)), pa.array(score), pa.array(doc, mask=none.astype(bool))], ["question", "score", "doc_id"])

    return indexed.mapInArrow(batches, "question long, score long, doc_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each question with their rank; first of parts, so that no task sees all of a question's candidates."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("_part", F.spark_partition_id() % 64)
    some = parts.withColumn("rank", F.row_number().over(W.Window.partitionBy("question", "_part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.Window.partitionBy("question").orderBy(*order))).filter(F.col("rank") <= k).drop("_part")


def _searched(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {w: nr for nr, w in enumerate(sorted({w for _, own in items for w in own}))}
    indexed = written(index(docs, vocabulary), "term-index")
    total = indexed.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not total.terms:
        return None
    weights, most, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for r in term_bounds(indexed, total.docs, total.terms, k).collect():  # as many rows as the questions have terms
        weights[r.term], most[r.term], kth[r.term] = weight(total.docs, r.df), r.most, r.kth
    questions = Questions([[vocabulary[w] for w in own] for _, own in items], weights, most, kth, k)
    ranked = _ranked(written(_candidates(indexed, questions, total.docs, total.terms), "best"), k)
    names = spark.createDataFrame([(nr, i) for nr, (i, _) in enumerate(items)], "question long, item_id long")
    return ranked.join(F.broadcast(names), "question").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text), a block of questions at a time."""
    spark, found, now = docs.sparkSession, None, []
    rows = items.select(F.col("item_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).toLocalIterator()

    def asked() -> None:
        nonlocal found, now
        if now and (own := _searched(docs, now, k)) is not None:
            found = own if found is None else found.unionByName(own)
        now = []

    for r in rows:
        if own := sorted(set(terms_of(r.text))):
            now.append((r.item_id, own))
        if len(now) == block:
            asked()
    asked()
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
