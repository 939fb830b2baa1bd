"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

logit = w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]: all pairwise interactions, at a cost linear in
a text's distinct features. Words (A-Z lower-cased) share ``BUCKETS`` hash buckets, with counts scaled to unit length;
the statistics describe letters, digits, symbols, line and word shapes; the metadata is the row's ``n_chars``.

The machine is fitted on at most ``MAX_SAMPLE`` labelled rows (a fixed bound, by hash order of their ids) on the
driver; every row is scored, in whole, by the workers.

Defined results: null and empty texts get the score of a text without words; null metadata is a feature of its own;
unlabelled rows, null labels and held-out rows teach nothing; without rows of both labels every score is ``UNKNOWN``; empty
tables give no rows; of labels that disagree on a row each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

BUCKETS, FACTORS, MAX_SAMPLE, THRESHOLD, UNKNOWN = 4096, 8, 8192, 0.3, 0.5
_UPPER, _LETTERS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOLS, _POINTS, _NOT_ASCII = b"#$%&*+<=>@\\^_`{|}~/", b".,;:?!'\"()-", bytes(range(128, 256))
STATS = 20
#: Words whose buckets a worker remembers.
_MEMO = 150_000


def statistics(raw: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """What a text looks like; every share is of its bytes, letters, words or lines."""
    n, w = max(1, len(raw)), max(1, len(words))
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    letters, lines = without(_LETTERS), raw.split(b"\n")
    return [
        np.log1p(len(words)), np.log1p(len(raw)), without(_UPPER) / max(1, letters), letters / n, without(_DIGITS) / n, without(_SYMBOLS) / n, without(_POINTS) / n,
        without(_NOT_ASCII) / n, raw.count(b"|") / w, raw.count(b"!") / w, raw.count(b".") / w, raw.count(b",") / w, len(lines) / w, len(raw) / w,
        len(set(words)) / w, len(set(lines)) / len(lines), float(not words), max(map(len, lines)) / n, np.log1p(max(0, n_chars or 0)), float(n_chars is None),
    ]


class Featurizer:
    """Batches of texts as (document, bucket, value) triples in order of document, and a matrix of statistics."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        known, flat, sizes = self.known, [], []
        stats = np.empty((len(texts), STATS))
        for k, (text, meta) in enumerate(zip(texts, n_chars, strict=True)):
            raw = (text or "").encode()
            words = raw.lower().split()
            stats[k] = statistics(raw, words, meta)
            found = list(map(known.get, words))
            if None in found:
                if len(known) > _MEMO:
                    known.clear()
                for i, f in enumerate(found):
                    if f is None:
                        found[i] = known[words[i]] = crc32(words[i]) % BUCKETS
            flat += found
            sizes.append(len(found))
        doc = np.repeat(np.arange(len(texts)), sizes)
        cell, count = np.unique(doc * BUCKETS + np.array(flat, np.int64), return_counts=True)
        doc, bucket = cell // BUCKETS, cell % BUCKETS
        length = np.sqrt(np.bincount(doc, count.astype(float) ** 2, len(texts)))
        return doc, bucket, count / length[doc], stats


class Machine:
    """A fitted factorisation machine; features are the buckets, then the standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        size = BUCKETS + len(mean)
        self.mean, self.scale = mean, scale
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -5, 5)

    def _logit(self, doc, bucket, value, z) -> tuple[np.ndarray, np.ndarray]:
        n, stat = len(z), slice(BUCKETS, None)
        logit = self.bias + z @ self.linear[stat] + np.bincount(doc, self.linear[bucket] * value, n)
        sums = z @ self.factors[stat]
        squares = (z**2) @ (self.factors[stat] ** 2)
        own = self.factors[bucket] * value[:, None]
        for f in range(FACTORS):
            sums[:, f] += np.bincount(doc, own[:, f], n)
            squares[:, f] += np.bincount(doc, own[:, f] ** 2, n)
        return logit + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def score(self, doc, bucket, value, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(doc, bucket, value, self.scaled(stats))[0], -40, 40)))

    def fit(self, doc, bucket, value, stats, label: np.ndarray, epochs: int = 16, batch: int = 256, rate: float = 0.02, decay: float = 2e-3, seed: int = 6) -> Machine:
        """Adam on the logistic loss over shuffled batches, with weight decay."""
        z, n, rng = self.scaled(stats), len(label), np.random.default_rng(seed)
        start = np.searchsorted(doc, np.arange(n + 1))
        share = float(np.clip(label.mean(), 0.01, 0.99))
        self.bias = float(np.log(share / (1 - share)))
        size = len(self.linear)
        moment, spread, step = np.zeros((size, FACTORS + 1)), np.zeros((size, FACTORS + 1)), 0
        for epoch in range(epochs):
            order = rng.permutation(n)
            for k in range(0, n, batch):
                rows = order[k : k + batch]
                at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
                own, b, v, zz = np.repeat(np.arange(len(rows)), start[rows + 1] - start[rows]), bucket[at], value[at], z[rows]
                logit, sums = self._logit(own, b, v, zz)
                g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label[rows]) / len(rows)
                grad = np.zeros((size, FACTORS + 1))
                gv = g[own] * v
                grad[:BUCKETS, 0] = np.bincount(b, gv, BUCKETS)
                grad[BUCKETS:, 0] = g @ zz
                for f in range(FACTORS):
                    grad[:BUCKETS, f + 1] = np.bincount(b, gv * (sums[own, f] - self.factors[b, f] * v), BUCKETS)
                grad[BUCKETS:, 1:] = (zz * g[:, None]).T @ sums - ((zz**2) * g[:, None]).sum(axis=0)[:, None] * self.factors[BUCKETS:]
                step += 1
                moment = 0.9 * moment + 0.1 * grad
                spread = 0.999 * spread + 0.001 * grad**2
                move = rate * (1 - epoch / epochs) * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
                self.linear -= move[:, 0] + rate * decay * self.linear
                self.factors -= move[:, 1:] + rate * decay * self.factors
                self.bias -= rate * (1 - epoch / epochs) * float(g.sum())
        return self


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Machine | None:
    """Fits the machine on rows of ``docs`` (doc_id, text, n_chars) labelled in ``labels`` (doc_id, quality), but the held-out fold."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(5) != 0)).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_sample)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", docs.text.cast("string").alias("text"), docs.n_chars.cast("long").alias("n_chars"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = Featurizer()
        for part in (whole.slice(k, 512) for whole in parts for k in range(0, whole.num_rows, 512)):
            ids, label, texts, meta = (c.to_pylist() for c in part.columns)
            doc, bucket, value, stats = featurize(texts, meta)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            columns = [[bucket[a:b].astype("<u2").tobytes() for a, b in spans], [value[a:b].astype("<f4").tobytes() for a, b in spans], [s.astype("<f8").tobytes() for s in stats]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "quality", "buckets", "vals", "stats"])

    rows = sample.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text", "n_chars").mapInArrow(batches, "doc_id long, quality int, buckets binary, vals binary, stats binary")
    # a row for each chosen label, however often its document is repeated
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("stats", "buckets", "vals")).alias("x")).select("doc_id", "quality", "x.*").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.stats), bytes(r.buckets)))
    if len({r.quality for r in rows}) < 2:
        return None
    buckets, values = ([np.frombuffer(x, t) for x in c] for c, t in (([r.buckets for r in rows], "<u2"), ([r.vals for r in rows], "<f4")))
    stats = np.stack([np.frombuffer(r.stats, "<f8") for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(b) for b in buckets])
    machine = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    return machine.fit(doc, np.concatenate(buckets).astype(np.int64), np.concatenate(values).astype(float), stats, np.array([r.quality for r in rows], float))


def scores(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Every column of ``docs`` (one that is named ``score`` is replaced) and ``score``, the probability of label 1."""
    docs = docs.drop("score")
    text, meta = docs.columns.index("text"), docs.columns.index("n_chars")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = Featurizer()
        for part in parts:
            for k in range(0, part.num_rows, 512):
                own = part.slice(k, 512)
                found = machine.score(*featurize(own.column(text).to_pylist(), own.column(meta).to_pylist())) if machine else np.full(own.num_rows, UNKNOWN)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.float64())], [*own.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(batches, f"{schema}, score double")
