"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood by the scaled forward recursion.

Tokens are a text's words (A-Z lower-cased) and one end token. Latent states emit symbols: each of the ``VOCABULARY`` most
frequent training words (of ``OFTEN`` occurrences at least) is a symbol with an emission of its own for every state, trained by Baum-Welch; all other words
share ``CLASSES`` classes by their last bytes, and the end token has one of its own. Within its class a word has its add-one share:

    P(word) = P(symbol | state), for a frequent word
    P(word) = P(class | state) * (c + 1) / (sum over the class's other training words of (c + 1), + 1), for the rest

so each class has room for one unseen word, the parameters have a fixed size, and all training counts take part.

Counting, each Baum-Welch round and scoring are one pass each over the rows, on the workers; expected counts are summed
per partition and then by Spark. Counts are kept by a 63-bit key (class and hash) in the shared folder. The words that are most
frequent in all rows (at most ``FREQUENT``, a fixed bound) travel to the workers as arrays, whether training has them or not;
the rarer words of a document meet their counts in a join on the key, so no key of that join is a frequent one.

A sequence of more than ``_SEGMENT`` tokens is worked off in segments: the forward probabilities at a segment's end begin the
next one, and the backward probabilities at its beginning end the one before, so recursions stay exact and only one
segment's are held.

Defined results: a null or empty text is the end token alone; empty tables give no rows; without training documents every
count is 0; repeated rows are documents of their own; of equally frequent words those of the smaller key are symbols.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

STATES, CLASSES, VOCABULARY, OFTEN, ROUNDS, FREQUENT, SUFFIX = 8, 2048, 16_384, 20, 4, 1 << 18, 3
#: Tokens whose recursion is held at a time, distinct words counted before they are passed on, and words remembered.
_CHUNK, _COUNTED, _MEMO = 1 << 19, 300_000, 300_000
#: Tokens of one sequence whose recursion is held at a time.
_SEGMENT = 1 << 18
_BITS = 52
END_CLASS = CLASSES - 1
END_KEY = END_CLASS << _BITS


def word_key(word: bytes) -> int:
    """Class number (of the last bytes) above 52 bits of the word's XXH64."""
    import xxhash

    return crc32(word[-SUFFIX:]) % END_CLASS << _BITS | xxhash.xxh64_intdigest(word) >> 64 - _BITS


def token_counts(docs: DataFrame) -> DataFrame:
    """(key, n, held) over all tokens of ``docs`` (text, held_out): occurrences in training documents and in the others."""

    def rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        columns = []
        for held, own in enumerate(counts):
            ends = own.pop(None, 0)
            keys = np.fromiter((word_key(w) for w in own), np.int64, len(own))
            n = np.append(np.fromiter(own.values(), np.int64, len(own)), ends)
            columns.append((np.append(keys, END_KEY), n * (1 - held), n * held))
            own.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["key", "n", "held"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for part in parts:
            for at in range(0, part.num_rows, 512):
                own = part.slice(at, 512)
                for text, held in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    counts[held].update((text or "").encode().lower().split())
                    counts[held][None] += 1
                if len(counts[0]) + len(counts[1]) > _COUNTED:
                    yield rows(counts)
        yield rows(counts)

    found = docs.select(docs.text.cast("string"), docs.held_out).mapInArrow(batches, "key long, n long, held long").filter("n + held > 0")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


@dataclass
class Counts:
    """What training documents hold: all tokens, distinct tokens, frequent words (of all documents), and what they emit.

    ``symbol``: each frequent word's number among the symbols. ``mass``: each symbol's share of the training tokens, not
    normalised: a class's sum of (c + 1) over its words but the symbols of their own, plus 1; such a symbol's own c + 1.
    """

    tokens: int
    distinct: int
    mass: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    least: int

    @classmethod
    def of(cls, counts: DataFrame, frequent: int | None = None, vocabulary: int | None = None) -> Counts:
        frequent, vocabulary = FREQUENT if frequent is None else frequent, VOCABULARY if vocabulary is None else vocabulary
        mass, tokens, distinct = np.ones(CLASSES), 0, 0
        for r in counts.filter("n > 0").groupBy(F.shiftright("key", _BITS).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            mass[r["class"]] += r["n"] + r["v"]
            tokens, distinct = tokens + r["n"], distinct + r["v"]
        # the smallest count of which, and above which, there are few enough words
        every = F.col("n") + F.col("held")
        by_power = counts.groupBy(F.ceil(F.log2(every) * 8).alias("power")).agg(F.count("*").alias("v"), F.min(every).alias("least")).orderBy(F.desc("power")).collect()
        total, least = 0, 1 << 62
        for r in by_power:  # some hundred steps
            total += r["v"]
            if total > frequent:
                break
            least = r["least"]
        found = counts.filter(every >= least).select("key", "n").toArrow()
        keys, n = (found.column(c).to_numpy() for c in ("key", "n"))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        symbol = keys >> _BITS
        own = np.lexsort((keys, -n))
        own = own[(n[own] >= OFTEN) & (keys[own] != END_KEY)][:vocabulary]
        np.subtract.at(mass, symbol[own], n[own] + 1)
        symbol[own] = CLASSES + np.arange(len(own))
        return cls(tokens, distinct, np.concatenate([mass, n[own] + 1.0]), keys, n, symbol, least)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, frequent double, shares double, n_frequent long, rare array<long>"


def encoded(docs: DataFrame, counts: Counts) -> DataFrame:
    """Every document of (row, doc_id, held_out, text) as its symbols, its rarer keys, and sums of its frequent words' log10(c + 1).

    ``frequent`` sums over all frequent words, ``shares`` over those that only have a class; ``n_frequent`` counts those that training has.
    """
    keys, logs, symbols, seen = counts.keys, np.log10(counts.counts + 1.0), counts.symbol, counts.counts > 0
    names = [c.split()[0] for c in ENCODED.split(", ")]
    end = int(np.searchsorted(keys, END_KEY))
    end_log = float(logs[end]) if end < len(keys) and keys[end] == END_KEY and seen[end] else None
    rare_end = np.array([] if end < len(keys) and keys[end] == END_KEY else [END_KEY], np.int64)  # of a float type, keys would lose bits

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}  # a word's number in the lists below: key, symbol, place among the frequent or -1
        fresh = lambda: [np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int32)]
        memo = fresh()

        def learn(words: list[bytes]) -> None:
            own = np.fromiter(map(word_key, words), np.int64, len(words))
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            at = np.where(keys[at] == own, at, -1) if len(keys) else np.full(len(own), -1)
            symbol = np.where(at >= 0, symbols[at], own >> _BITS) if len(keys) else own >> _BITS
            known.update(zip(words, range(len(known), len(known) + len(words)), strict=True))
            memo[:] = [np.concatenate([m, x.astype(m.dtype)]) for m, x in zip(memo, (own, symbol, at), strict=True)]

        for part in parts:
            for begin in range(0, part.num_rows, 512):
                own = part.slice(begin, 512)
                texts = [(t or "").encode().lower().split() for t in own.column(3).to_pylist()]
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > _MEMO:
                    known.clear()
                    memo[:] = fresh()
                    new = list(set().union(*texts))
                if new:
                    learn(new)
                out: list[list] = [[], [], [], [], [], []]
                for words in texts:
                    nr = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    symbol, place = memo[1][nr], memo[2][nr]
                    common = place >= 0
                    value = logs[place[common]] if len(keys) else np.zeros(0)
                    out[0].append(len(words) + 1)
                    out[1].append(np.append(symbol, END_CLASS).astype("<u2").tobytes())
                    out[2].append(float(value.sum()) + (end_log or 0.0))
                    out[3].append(float(value[symbol[common] < CLASSES].sum()) + (end_log or 0.0))
                    out[4].append(int(seen[place[common]].sum()) + (end_log is not None) if len(keys) else 0)
                    out[5].append(np.concatenate([memo[0][nr[~common]], rare_end]))
                types = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    return docs.select(F.col("row").cast("long"), F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(batches, ENCODED)


@dataclass
class Model:
    """Initial, transition and emission probabilities; emissions as one row per symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def fresh(cls, mass: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
        """States that tend to stay; each emits the symbols' shares, perturbed to tell the states apart."""
        emit = mass[:, None] / mass.sum() * np.exp(np.random.default_rng(seed).normal(0, 0.5, (len(mass), states)))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def updated(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Model:
        """From expected counts, with pseudo-counts: some of the symbols' own shares for emissions, one for the rest."""
        emit = emit + 100.0 * mass[:, None] / mass.sum()
        return cls((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Chunk:
    """Some sequences side by side: at step t stand those longer than t, longest first, so each step is one contiguous slice."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences])
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        steps = int(self.size[0])
        self.wide = np.searchsorted(-self.size, -np.arange(steps), "left")  # sequences longer than t
        self.begin = np.concatenate([[0], np.cumsum(self.wide)])
        nr = np.repeat(np.arange(len(size)), self.size)
        step = np.arange(len(nr)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.place = self.begin[step] + nr
        self.classes = np.empty(len(nr), np.int64)
        self.classes[self.place] = np.concatenate([sequences[i] for i in self.order])
        self.starts = np.cumsum(self.size) - self.size

    def forward(self, model: Model, carried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward probabilities, and the scales, all in step order. ``carried``: the forward probabilities before the first step."""
        emit = model.emit[self.classes]
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        move, before, ones = model.move, carried, np.ones(len(model.start))
        for a, n in zip(self.begin[:-1].tolist(), self.wide.tolist(), strict=True):
            now, c = alpha[a : a + n], scale[a : a + n]
            if before is None:
                now[:] = model.start
            else:
                np.matmul(before[:n], move, out=now)
            now *= emit[a : a + n]
            np.matmul(now, ones, out=c)
            now /= c[:, None]
            before = now
        return emit, alpha, scale

    def log10(self, scale: np.ndarray) -> np.ndarray:
        """Each sequence's log10 likelihood, in the order they were given."""
        out = np.empty(len(self.size))
        out[self.order] = np.add.reduceat(np.log10(scale)[self.place], self.starts)
        return out

    def expected(self, model: Model, carried: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """Expected counts of starts, moves and emissions, the sum of log10 likelihoods, and the backward probabilities before the first step.

        ``carried`` and ``after``: the forward probabilities before the first step and the backward ones at the last, of one sequence's segment.
        """
        emit, alpha, scale = self.forward(model, carried)
        emit /= scale[:, None]
        gamma, moves = np.empty_like(alpha), np.zeros_like(model.move)
        back = model.move.T.copy()
        beta = np.ones((int(self.wide[-1]), len(model.start))) if after is None else after
        begin, wide = self.begin[:-1].tolist(), self.wide.tolist()
        for t in range(len(wide) - 1, -1, -1):
            a, n = begin[t], wide[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), beta.shape[1]))])
            np.multiply(alpha[a : a + n], beta, out=gamma[a : a + n])
            onward = emit[a : a + n]
            onward *= beta
            if t:
                p = begin[t - 1]
                moves += alpha[p : p + n].T @ onward
            elif carried is not None:
                moves += carried.T @ onward
            beta = onward @ back
        counts = np.stack([np.bincount(self.classes, gamma[:, s], len(model.emit)) for s in range(gamma.shape[1])], axis=1)
        starts = gamma[: wide[0]].sum(axis=0) if carried is None else np.zeros(len(model.start))
        return starts, moves * model.move, counts, float(np.log10(scale).sum()), beta


def _segments(sequences: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The segments of a lone sequence that is longer than ``size``."""
    if len(sequences) > 1 or len(sequences[0]) <= size:
        return []
    return [sequences[0][k : k + size] for k in range(0, len(sequences[0]), size)]


def expected_counts(sequences: list[np.ndarray], model: Model, size: int = _SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the sum of log10 likelihoods."""
    parts = _segments(sequences, size)
    if not parts:
        return Chunk(sequences).expected(model)[:4]
    carried: list[np.ndarray | None] = [None]
    for part in parts[:-1]:
        carried.append(Chunk([part]).forward(model, carried[-1])[1][-1:])
    total, after = None, None
    for part, before in zip(reversed(parts), reversed(carried), strict=True):
        *found, after = Chunk([part]).expected(model, before, after)
        total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
    return tuple(total)


def log10_likelihoods(sequences: list[np.ndarray], model: Model, size: int = _SEGMENT) -> np.ndarray:
    """Each sequence's log10 likelihood."""
    parts = _segments(sequences, size)
    if not parts:
        chunk = Chunk(sequences)
        return chunk.log10(chunk.forward(model)[2])
    total, carried = 0.0, None
    for part in parts:
        _, alpha, scale = Chunk([part]).forward(model, carried)
        total, carried = total + float(np.log10(scale).sum()), alpha[-1:].copy()
    return np.array([total])


def _chunks(blobs: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and sequences of like lengths, about ``_CHUNK`` tokens at a time; a longer one stands alone."""
    order = sorted(range(len(blobs)), key=lambda i: -len(blobs[i]))
    rows, held = [], 0
    for i in order:
        rows.append(i)
        held += len(blobs[i]) // 2
        if held >= _CHUNK or len(blobs[i]) // 2 > _SEGMENT:
            yield rows, [np.frombuffer(blobs[k], "<u2") for k in rows]
            rows, held = [], 0
    if rows:
        yield rows, [np.frombuffer(blobs[k], "<u2") for k in rows]


def baum_welch(sequences: DataFrame, model: Model, mass: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Refits ``model`` on all of ``sequences.symbols``; returns it and each round's log10 likelihood before its update."""
    states, size = len(model.start), len(model.emit)
    fields = ", ".join(f"s{k} double" for k in range(states))
    history = []
    for _ in range(rounds):
        now = model

        def batches(parts: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + states + 2, states))
            for part in parts:
                for _, own in _chunks(part.column(0).to_pylist()):
                    start, move, emit, fit = expected_counts(own, now)
                    total[:size] += emit
                    total[size : size + states] += move
                    total[size + states] += start
                    total[-1, 0] += fit
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k]) for k in range(states))], ["at", *(f"s{k}" for k in range(states))])

        sums = sequences.select("symbols").mapInArrow(batches, f"at int, {fields}").groupBy("at").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
        total = np.zeros((size + states + 2, states))
        for r in sums.collect():  # one row per symbol, state and total: at most VOCABULARY + CLASSES + STATES + 2
            total[r["at"]] = r[1:]
        history.append(float(total[-1, 0]))
        model = Model.updated(total[size + states], total[size : size + states], total[:size], mass)
    return model, history


def likelihoods(sequences: DataFrame, model: Model, mass: np.ndarray) -> DataFrame:
    """All columns but ``symbols``, plus ``symbols_log10`` (of the sequence of symbols) and ``share_log10`` (minus the classes' masses)."""
    kept = [c for c in sequences.columns if c != "symbols"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.select(*kept).schema.fields) + ", symbols_log10 double, share_log10 double"
    logs = np.where(np.arange(len(mass)) < CLASSES, -np.log10(mass), 0.0)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fit, share = np.zeros(part.num_rows), np.zeros(part.num_rows)
            for rows, own in _chunks(part.column(len(kept)).to_pylist()):
                fit[rows] = log10_likelihoods(own, model)
                share[rows] = [logs[s].sum() for s in own]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fit), pa.array(share)], [*kept, "symbols_log10", "share_log10"])

    return sequences.select(*kept, "symbols").mapInArrow(batches, schema)


def train(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Counts, Model]:
    """Of (row, doc_id, held_out, text): the counts and the encoded rows, as tables, and what was learned from the rows that are not held out."""
    counts = written(token_counts(docs), "token-counts")
    seen = Counts.of(counts)
    rows = written(encoded(docs, seen), "sequences")
    model, _ = baum_welch(rows.filter(~F.col("held_out")), Model.fresh(seen.mass, states), seen.mass, rounds)
    return counts, rows, seen, model


def score_documents(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("row", F.monotonically_increasing_id())
    counts, rows, seen, model = train(marked, states, rounds)
    scored = likelihoods(rows.select("row", "doc_id", "held_out", "n_tokens", "frequent", "shares", "n_frequent", "symbols"), model, seen.mass)
    rarer = counts.filter((F.col("n") > 0) & (F.col("n") + F.col("held") < seen.least)).select("key", "n")
    rare = rows.select("row", F.explode("rare").alias("key")).join(rarer, "key")
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("rare"), F.count("*").alias("n_rare"))
    rare = F.coalesce("rare", F.lit(0.0))
    base = float(np.log10(seen.tokens + seen.distinct + 1.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(seen.tokens).cast("long").alias("train_tokens"),
        (F.col("frequent") + rare - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("symbols_log10") + F.col("shares") + rare + F.col("share_log10")).alias("score"),
    )
