"""Near copies by exact similarity: all pairs of texts whose sets of five-word shingles have a Jaccard index of 0.8 or more.

Shingles are put in one order for all texts, those that a sample finds frequent last. Of n shingles, two texts that similar
share one of the first n - ceil(0.8 n) + 1 of each, so an equality join on these prefixes misses no pair, whatever the
sample. Pairs that sizes or positions rule out are left away; the rest are verified on all their shingles' XXH64 values.

A shingle's texts, sorted by size, are paired with the next ``REACH`` each. The nearest ``NEXT`` are verified first; others only
if these left them in different components, and so are, last, the pairs that are missing where a shingle has more texts.

Words are as for SimHash: split at ASCII white space, ASCII letters lower-cased. A text of fewer than five words has one
shingle, all its words; null, empty and blank texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gone_of_groups, sent, spread, written
from .simhash import SEED, components

WORDS, REACH, NEXT, SKETCH = 5, 24, 2, 1024
#: Texts in the sample, occurrences in it that make a shingle frequent, frequent shingles at most.
_SAMPLE, _OFTEN, _FREQUENT = 4096, 3, 65_536


def shingles(text: str | None) -> list[bytes]:
    parts = (text or "").encode().lower().split()
    return [b" ".join(parts[i : i + WORDS]) for i in range(max(1, len(parts) - WORDS + 1))]


def hashes(text: str | None) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted."""
    import xxhash

    parts = shingles(text)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts)).view(np.int64))


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample finds often, by hash, and their counts there."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(hashes(text))], ["key"])

    share = min(1.0, _SAMPLE / max(1, rows.count()))
    counts = rows.select("text").sample(share, SEED).mapInArrow(batches, "key long").groupBy("key").count().filter(F.col("count") >= _OFTEN)
    found = sorted((r["key"], r["count"]) for r in counts.orderBy(F.desc("count"), "key").limit(_FREQUENT).collect())
    return np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _prefixes(rows: DataFrame) -> DataFrame:
    """(key, row, n, pos): the first shingles of every text, with their number in all and their place in the order."""
    often = rows.sparkSession.sparkContext.broadcast(_frequent(rows))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = often.value
        for own in (part.slice(k, 512) for part in parts for k in range(0, part.num_rows, 512)):
            out = []
            for row, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                key = hashes(text)
                n = len(key)
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    key = key[np.argsort(np.where(names[at] == key, counts[at], 0), kind="stable")]
                first = n - (4 * n + 4) // 5 + 1
                out.append((key[:first], np.full(first, row, np.int64), np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "row", "n", "pos"])

    return spread(rows.select("row", "text")).mapInArrow(batches, "key long, row long, n int, pos int")


def _possible(n, pos, m, other):
    """Whether texts of n and m shingles that share those at pos and other, and none before, can be similar."""
    left, right = n - pos, m - other
    least = left * (left <= right) + right * (left > right)
    return 9 * least >= 4 * (n + m)


def _pairs(reach: int):
    """Over prefixes sorted by key and size: (a, b, step) of each text and the next ``reach`` of its key, and (a, null, null, key, n, pos) for members of larger groups."""
    half = reach // 2

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        for part in parts:
            old = len(held[0])
            key, row, n, pos = (np.concatenate([h, part.column(c).to_numpy()]) for c, h in enumerate(held))
            a, b, steps, crowd = [], [], [], []
            for step in range(1, reach + 1):
                j = np.arange(max(old, step), len(key))
                j = j[key[j] == key[j - step]]
                if not len(j):
                    break
                if step == half:  # each member of a group beyond the reach has another at half of it
                    crowd = [j, j - step]
                i = j - step
                fits = _possible(n[i].astype(np.int64), pos[i], n[j].astype(np.int64), pos[j]) & (row[i] != row[j])
                a.append(np.maximum(row[i], row[j])[fits])
                b.append(np.minimum(row[i], row[j])[fits])
                steps.append(np.full(len(a[-1]), step))
            made = np.concatenate([np.stack(x, axis=0) for x in zip(a, b, steps, strict=True)], axis=1) if a else np.zeros((3, 0), np.int64)
            made = made[:, np.lexsort(made[::-1])]
            if made.shape[1]:  # of a pair's steps the smallest
                made = made[:, np.concatenate([[True], (made[:2, 1:] != made[:2, :-1]).any(axis=0)])]
            many = np.unique(np.concatenate(crowd)) if len(crowd) else np.zeros(0, np.int64)
            none, no_pair = (lambda t: pa.nulls(made.shape[1], t)), (lambda t: pa.nulls(len(many), t))
            columns = [
                pa.array(np.concatenate([made[0], row[many]])), pa.concat_arrays([pa.array(made[1]), no_pair(pa.int64())]), pa.concat_arrays([pa.array(made[2].astype(np.int32)), no_pair(pa.int32())]),
                pa.concat_arrays([none(pa.int64()), pa.array(key[many])]), pa.concat_arrays([none(pa.int32()), pa.array(n[many])]), pa.concat_arrays([none(pa.int32()), pa.array(pos[many])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "step", "key", "n", "pos"])
            held = [c[-reach:] for c in (key, row, n, pos)]

    return batches


def _sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (row, text): the number of shingles, and which classes of them hold an odd number; of ``SKETCH`` classes, and of two to four for each shingle."""

    def odd(keys: np.ndarray, classes: int) -> bytes:
        return np.packbits(np.bincount(keys & (classes - 1), minlength=classes) & 1).tobytes()

    for part in parts:
        for k in range(0, part.num_rows, 512):
            own = part.slice(k, 512)
            sets = [hashes(t) for t in own.column(1).to_pylist()]
            narrow = pa.array([odd(h, SKETCH) for h in sets], pa.binary())
            wide = pa.array([odd(h, 1 << max(6, (2 * len(h) - 1).bit_length())) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(map(len, sets), pa.int64()), narrow, wide], ["row", "n", "narrow", "wide"])


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (row, text): the shingles' hashes."""
    for part in parts:
        for k in range(0, part.num_rows, 512):
            own = part.slice(k, 512)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([hashes(t) for t in own.column(1).to_pylist()], pa.list_(pa.int64()))], ["row", "keys"])


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch of fewer classes."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs but those that cannot be similar: classes that differ are at most as many as shingles that only one has, and these at most a ninth of all."""
    for part in parts:
        differ = np.zeros(part.num_rows, np.int64)
        for k, (x, y) in enumerate(zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            least = min(len(x), len(y))
            differ[k] = np.bitwise_count(_folded(x, least) ^ _folded(y, least)).sum(dtype=np.int64)
        good = pa.array(9 * differ <= part.column("n").to_numpy() + part.column("m").to_numpy())
        yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])


def _of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    named = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "similar-rows")
    return rows.select("row", "text").join(sent(named), "row", "left_semi")


def _verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar. Narrow sketches rule out most others, wide ones what is left of long texts; hashes are dealt out for the rest, and compared in the JVM."""
    for width in ("narrow", "wide"):
        odd = sketches.select("row", "n", width)
        both = pairs.join(odd.toDF("a", "n", "x"), "a").join(odd.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
        pairs = written(both.mapInArrow(_near, "a long, b long"), "similar-near")
    keys = written(_of(pairs, rows).mapInArrow(_hashed, "row long, keys array<long>"), "similar-keys")
    both = pairs.join(keys.toDF("a", "x"), "a").join(keys.toDF("b", "y"), "b")
    return written(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "similar-links")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose ends are in different components of ``roots`` (node, root)."""
    both = pairs.join(roots.toDF("a", "x"), "a", "left").join(roots.toDF("b", "y"), "b", "left")
    return both.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def links(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b) links between similar rows of ``rows`` (row, text) that join every pair of similar rows, over others at times.

    A key's neighbours are verified first, then pairs further apart that are not joined yet, and last those beyond the reach.
    """
    sketches = written(spread(rows.select("row", "text")).mapInArrow(_sketches, "row long, n long, narrow binary, wide binary"), "similar-sketches")
    keyed = _prefixes(rows).repartition(F.col("key")).sortWithinPartitions("key", "n", "row")
    found = written(keyed.mapInArrow(_pairs(reach), "a long, b long, step int, key long, n int, pos int"), "similar-pairs")
    pairs = written(found.filter("b is not null").groupBy("a", "b").agg(F.min("step").alias("step")), "candidates")
    linked = _verified(pairs.filter(F.col("step") <= NEXT).select("a", "b"), rows, sketches)
    roots = written(components(linked), "similar-roots")
    linked = linked.unionByName(_verified(written(_across(pairs.filter(F.col("step") > NEXT).select("a", "b"), roots), "candidates"), rows, sketches))
    crowd = found.filter("b is null").select("key", F.col("a").alias("row"), "n", "pos").distinct()
    if crowd.isEmpty():
        return linked
    roots = components(linked)
    crowd = crowd.join(roots.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "n", "pos", F.coalesce("root", "row").alias("root"))
    split = crowd.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    crowd = written(crowd.join(split, "key", "left_semi"), "similar-crowds")
    x, y = crowd.alias("x"), crowd.alias("y")
    bound = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.row") > F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & (9 * bound >= 4 * (F.col("x.n") + F.col("y.n"))))
    return linked.unionByName(_verified(written(across.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct(), "candidates"), rows, sketches))


def duplicates(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(_row): the rows of ``rows`` (_row, doc_id, text, a table) but the first of each component of similar texts; see ``common.gone_of_groups``."""
    roots = components(links(rows.select(F.col("_row").alias("row"), F.col("text").cast("string").alias("text")), reach))
    roots = written(roots.union(roots.select("root", "root").distinct()).toDF("row", "root"), "roots")
    return gone_of_groups(rows, roots)


def deduplicated(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row of ``docs`` of each component of similar texts: that of the smallest doc_id, null ids last."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return rows.join(sent(duplicates(rows, reach)), "_row", "left_anti").drop("_row")
