"""Harmonic packing: lengths fall into reciprocal-capacity classes, and each class's sequences hold a fixed count.

Class k holds pieces that are at most capacity / k tokens long and longer than the next class allows; k of them make a
sequence. The classes are bounded: k up to ``FINE``, then powers of two and their halves more, down to pieces of ``SLACK``
tokens (some 25). A document is cut into pieces of exactly a class's length until what is left is within ``SLACK`` tokens of one,
so a piece wastes at most that. Workers fill sequences independently: pieces are numbered within their class by counts per
bucket, and a piece's number alone gives its sequence.

What is left of each class after its last full sequence, fewer than k pieces, makes shared sequences. They are planned from
the classes' counts alone (one row for each class): in order of falling length, as many of a class as fit go to each sequence
begun so far, so no piece takes part in anything but the lookup of its number.

Only numbers move between workers, never token ids.

Defined results: a null or empty text is a document of the end id alone; empty tables give no rows; repeated rows are
documents of their own, and null or repeated ids share no task, for pieces are dealt out by a row number; a text longer than
a sequence is cut; which of several pieces of a class comes first follows the table's rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

#: ``SLACK``: tokens by which a piece may fall short of its class's length.
CAPACITY, END_ID, SLACK, FINE = 4096, 2, 8, 16
#: Words whose ids a worker remembers, and the longest of them in bytes.
_WORDS, _LONGEST = 300_000, 48


class _Memo(dict):
    """Remembers what ``find`` gives for short keys, and starts anew when it is full."""

    def __init__(self, find: Callable[[bytes | str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: bytes | str) -> bytes:
        found = self.find(key)
        if len(key) <= _LONGEST:
            if len(self) >= _WORDS:
                self.clear()
            self[key] = found
        return found


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies name bytes: printable ones name themselves, the others count from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(others)}


class WordIds:
    """Token ids by white-space-delimited words, as little-endian unsigned 32-bit bytes.

    Texts of printable ASCII, ASCII white space and Latin-1 letters, which normalization only lower-cases, are split here
    by the tokenizer's own pattern, and only their parts go to its model. For others: neither the splitting pattern nor
    the normalizer looks across ASCII white space, so a text's ids are those of its words, one after the other. A worker
    tokenizes a part or word once as long as it remembers it.
    """

    #: Such characters, and the pattern of the tokenizer file for lower-cased texts of them.
    PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ\t-\r]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t-\r]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.words, self.parts = _Memo(self._word), _Memo(self._part)

    def _part(self, part: str) -> bytes:
        named = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.pieces(named)]).tobytes()

    def _plain(self, text: str) -> bytes | None:
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))
        return None

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        found = self._plain(text)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if found is None else found

    def __call__(self, text: str) -> bytes:
        found = self._plain(text)
        return b"".join(map(self.words.__getitem__, text.encode().split())) if found is None else found


@cache
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that tasks share what it remembers."""
    return WordIds(path)


@cache
def classes(capacity: int = CAPACITY, slack: int = SLACK) -> tuple[tuple[int, int], ...]:
    """(length, k) of the classes, longest first; the last one's length is ``slack`` or little more."""
    counts = {*range(1, FINE + 1), *(n << j for n in (2, 3) for j in range(31))}
    lengths = {capacity // k: k for k in sorted(counts) if capacity // k >= max(1, slack)}
    return tuple(sorted(lengths.items(), reverse=True)) or ((capacity, 1),)


@cache
def cut(size: int, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[tuple[int, int, int], ...]:
    """(start, length, class) of a document's pieces: the longest class lengths that fit, until the rest is near one."""
    pieces, start, own = [], 0, classes(capacity, slack)
    while start < size:
        rest = min(size - start, capacity)
        over, k = min((x for x in own if x[0] >= rest), default=own[0])
        if over - rest > slack and (under := max((x for x in own if x[0] <= rest), default=None)):
            rest, k = under
        pieces.append((start, rest, k))
        start += rest
    return tuple(pieces)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's pieces; ``with_ids`` adds their token ids as ``array<int>``."""
    end = end_id.to_bytes(4, "little")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for part in (whole.slice(k, 512) for whole in parts for k in range(0, whole.num_rows, 512)):
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = words(text or "") + end
                total = len(raw) // 4
                for start, length, k in cut(total, capacity, slack) if total <= 4 * capacity else cut.__wrapped__(total, capacity, slack):
                    own = raw[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(own), total, k))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)]
            columns[5] = columns[5].cast(pa.int32())
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(batches, schema)


def _shared(left: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int]]], int]:
    """For each class the (count, sequence) of its left pieces, and the number of sequences; at most a row for each pair of classes."""
    rooms: list[int] = []
    plan: dict[int, list[tuple[int, int]]] = {}
    for k in sorted(left):
        length, n = capacity // k, left[k]
        plan[k] = []
        for s in sorted(range(len(rooms)), key=lambda s: rooms[s]):
            if taken := min(n, rooms[s] // length):
                plan[k].append((taken, s))
                rooms[s] -= taken * length
                n -= taken
        if n:  # fewer than k, so they fit one sequence
            plan[k].append((n, len(rooms)))
            rooms.append(capacity - n * length)
    return plan, len(rooms)


def _planned(totals: dict[int, int], capacity: int) -> list[tuple]:
    """(class, full, first, ends, sequences) for each class: its full sequences, the first one's number, and where its left pieces go by their rank."""
    full = {k: n // k for k, n in totals.items()}
    plan, _ = _shared({k: n % k for k, n in totals.items() if n % k}, capacity)
    base, first, rows = sum(full.values()), 0, []
    for k in sorted(totals):
        own = plan.get(k, [])
        rows.append((k, full[k], first, list(accumulate(n for n, _ in own)), [base + s for _, s in own]))
        first += full[k]
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (which are written first, and numbered); their ``class`` says how many make a sequence."""
    names = [c for c in parts.columns if c not in ("sequence_id", "offset", "_row")]
    parts = written(parts.select(*names).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    buckets = max(1, -(-parts.count() // rows_per_bucket))
    keyed = parts.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    counts = keyed.groupBy("class", "_bucket").agg(F.count("*").alias("n")).withColumn("_super", (F.col("_bucket") / rows_per_bucket).cast("long"))
    # buckets' first numbers by two levels of counts, so no class is summed up in one task
    earlier = lambda by, order: F.coalesce(F.sum("n").over(W.Window.partitionBy(*by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    supers = counts.groupBy("class", "_super").agg(F.sum("n").alias("n"))
    totals = {r["class"]: r["n"] for r in supers.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # one row for each class
    spark = parts.sparkSession
    planned = spark.createDataFrame(_planned(totals, capacity), "class int, full long, first long, ends array<long>, shared array<long>")
    supers = supers.select("class", "_super", earlier(["class"], "_super").alias("above"))
    begins = counts.withColumn("inner", earlier(["class", "_super"], "_bucket")).join(supers, ["class", "_super"])
    places = begins.select("class", "_bucket", (F.col("above") + F.col("inner")).alias("_begin")).join(F.broadcast(planned), "class")  # some 25 classes
    rank = F.row_number().over(W.Window.partitionBy("class", "_bucket").orderBy("_row")) - 1
    placed = keyed.join(places, ["class", "_bucket"]).withColumn("_nr", F.col("_begin") + rank)
    at = F.col("_nr") - F.col("full") * F.col("class")
    shared = F.element_at("shared", (F.size(F.filter("ends", lambda end: end <= at)) + 1).cast("int"))
    sequence = F.when(at < 0, F.col("first") + F.floor(F.col("_nr") / F.col("class"))).otherwise(shared)
    inside = W.Window.partitionBy("sequence_id").orderBy("class", "_nr").rowsBetween(W.Window.unboundedPreceding, -1)
    return placed.withColumn("sequence_id", sequence).select(*names, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and class) of every piece of every document."""
    return pack(pieces(docs, tokenizer_path, capacity, slack, end_id), capacity)
