"""SimHash near-duplicates at two or fewer differing bits, by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits, fewer than the three that plain pigeonholing of two bits
would need, so one segment differs by at most one bit. Each segment is indexed under its 32 one-wildcard variants (one bit
masked); fingerprints that share a variant meet in an equality join and are verified on all 64 bits.

Only distinct fingerprints take part. A variant shared by more than ``CROWD`` of them is not joined pair by pair: its
members go to the exact way for crowds, where each is listed under itself and its 64 one-bit neighbours. Two fingerprints
at two or fewer bits share one of these centres, and all that share a centre are at most two bits apart, so linking each to
the smallest of its centre loses no link and makes no pairs. Components come from large-star/small-star rounds.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a text of one or two words has
one shingle, all its words; empty tables give no rows; repeated rows stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gone_of_groups, sent, written

SHINGLE, SEED, BITS, CROWD = 3, 42, 2, 48
#: Fingerprints of which a task makes variants.
_SHARE = 250_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        values = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]])
        digest = xxhash.xxh64_intdigest
        values = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = values[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(k, 1024) for whole in parts for k in range(0, whole.num_rows, 1024)):
            fps = np.fromiter((fingerprint(t, words) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(batches, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """Both segments' one-wildcard variants, as (variant with the masked bit's number above it, segment)."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)

    def masked(segment: Column, name: int) -> Column:
        keep = lambda i: F.lit(0xFFFFFFFF).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: segment.bitwiseAND(keep(i)).bitwiseOR(F.call_function("shiftleft", (i + F.lit(32 * name)).cast("long"), F.lit(32))))

    return F.concat(masked(low, 0), masked(high, 1))


LINKS = "a long, b long"


def _match(crowd: int):
    """Over rows sorted by variant: verified links of small groups, and (fp, null) for each member of a crowd.

    A pair is given once, by the variant that masks its segment's own differing bit (bit 0 if the segments are equal).
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        crowded = [np.zeros(0, np.int64)]  # the variant at the end of what was read, if it is a crowd
        for part in [*parts_or_end(parts)]:
            if part is None:
                key, fp = kept
            else:
                key, fp = (np.concatenate([k, part.column(c).to_numpy()]) for c, k in enumerate(kept))
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            # the last group may go on in the next batch; of a crowd only its variant is kept
            done = len(first) if part is None else len(first) - 1
            big = size > crowd
            if len(crowded[0]) and key[0] == crowded[0][0]:
                big[0] = True
            crowded = [np.zeros(0, np.int64)]
            if done < len(first) and big[-1]:
                crowded, done = [key[-1:]], len(first)
            end = first[done] if done < len(first) else len(key)
            kept = [key[end:], fp[end:]]
            which = np.repeat(np.arange(len(first)), size)[:end]
            key, fp = key[:end], fp[:end]
            hot = big[which] if len(which) else np.zeros(0, bool)
            a, b = [np.unique(fp[hot])], []
            none = len(a[0])
            key, fp = key[~hot], fp[~hot].view(np.uint64)
            for step in range(1, crowd):
                same = np.flatnonzero(key[step:] == key[:-step])
                if not len(same):
                    break
                x, y = fp[same], fp[same + step]
                diff = x ^ y
                low, high = diff & np.uint64(0xFFFFFFFF), diff >> np.uint64(32)
                near = (np.bitwise_count(diff) <= BITS) & (diff != 0)
                bit, segment = (key[same] >> 32) & 31, key[same] >> 37
                use_low = np.bitwise_count(low) <= 1
                own = np.where(use_low, low, high)
                canonical = np.where(own == 0, 0, np.bitwise_count(own - np.uint64(1)))
                pick = near & (segment == np.where(use_low, 0, 1)) & (bit == canonical)
                a.append(x[pick].view(np.int64))
                b.append(y[pick].view(np.int64))
            b = pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), b], ["a", "b"])

    def parts_or_end(parts):
        yield from parts
        yield None

    return batches


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) links that join all distinct values of ``fps.fp`` within two bits; every component of theirs is connected."""
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() // _SHARE))
    keyed = fps.repartition(tasks, "fp").select(F.explode(_variants(F.col("fp"))).alias("variant"), "fp")
    found = written(keyed.repartition(F.col("variant")).sortWithinPartitions("variant").mapInArrow(_match(crowd), LINKS), "simhash-links")
    crowds = found.filter("b is null").select("a").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    centres = crowds.select("a", F.explode(F.concat(F.array("a"), flips)).alias("centre"))
    smallest = centres.groupBy("centre").agg(F.min("a").alias("b"), F.max("a").alias("c")).filter("b < c").select("centre", "b")
    stars = centres.join(smallest, "centre").filter("a <> b").select("a", "b").distinct()
    return found.filter("b is not null").select("a", "b").unionByName(stars)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of ``edges`` (a, b), by large-star and small-star rounds.

    Each round is written to the shared folder. Stars are found by joining the edges with their nodes' smallest neighbours,
    so no node's neighbours are gathered.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node is linked to the smallest of the node and its neighbours
        pairs = both(edges)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours are linked to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "small-star")
        # at rest every node has one smaller neighbour, which has none
        rest = after.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        roots = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi").limit(1).count()
        edges = after
        if rest["n"] == rest["nodes"] and not roots:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components not at rest after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    marked = written(fingerprints(docs, words), "fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = written(components(links(first.select("fp"), crowd)), "roots")
    grouped = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def duplicates(rows: DataFrame, words: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(_row): the rows of ``rows`` (_row, doc_id, text, a table) but the first of each component; see ``common.gone_of_groups``."""
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words, crowd)
    return gone_of_groups(rows, written(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), "groups"))


def deduplicated(docs: DataFrame, words: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: one of the smallest doc_id, null ids last.

    Rows are told apart by a number of their own, so null and repeated ids lose no text.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return rows.join(sent(duplicates(rows, words, crowd)), "_row", "left_anti").drop("_row")
