"""Count-only Viterbi: how many pieces a unigram tokenizer makes of a text, without making them.

An Aho-Corasick automaton enumerates the vocabulary's matches at each place; dynamic programming over places carries the
best score and the number of pieces on the best path. Ties are the tokenizer's own: matches reach a place in the order of
their beginnings and only a better score replaces what is there, so the longest piece of equal paths wins; a character
that no piece covers costs the unknown piece, and with byte fallback counts as its UTF-8 bytes; neighbouring unknown
characters fuse only where there is no byte fallback.

Where scores are whole numbers, sums are exact in any order, and where no piece holds the word mark after another character,
the best path of a text is that of its words: a worker then computes each word once as long as it remembers it. For any
other vocabulary, as trained ones with fractions, the path of the whole text is computed, and scores are summed in the tokenizer's
own order and type (doubles, from the text's beginning), so that roundings and ties are the tokenizer's.

Defined results: null and empty texts have 0 pieces; empty tables give no rows; repeated rows stay rows of their own.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: The unknown piece scores this much less than the lowest normal piece.
UNKNOWN_PENALTY = 10.0
_MEMO, _LONGEST = 600_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@cache
def vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """(pieces with scores in order of id, the unknown piece's id, whether there are byte pieces) of a SentencePiece model file.

    Control, unused and byte pieces can never match a text.
    """
    with open(path, "rb") as f:
        data = f.read()
    pieces, unknown, fallback = [], 0, False
    for number, value in _fields(data):
        if number != 1:
            continue
        own = dict(_fields(value))
        kind = own.get(3, 1)
        if kind == 2:
            unknown = len(pieces)
        fallback |= kind == 6
        pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, kind))
    return [(p, s if k in (1, 4) else None) for p, s, k in pieces], unknown, fallback


class PieceCounter:
    """Counts by words where these can be told apart, else by whole texts; ``pieces``: (piece, score), where a piece without score never matches."""

    def __init__(self, pieces: list[tuple[str, float | None]], fallback: bool):
        import ahocorasick

        scored = {p: s for p, s in pieces if s is not None and p}
        self.by_words = all(float(s).is_integer() for s in scored.values()) and not any(MARK in p.lstrip(MARK) for p in scored)
        self.automaton = ahocorasick.Automaton()
        for p, s in scored.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(scored.values(), default=0.0) - UNKNOWN_PENALTY
        self.fallback, self.known = fallback, {}

    def viterbi(self, text: str) -> int:
        """Pieces on the best path of one stretch of text.

        The automaton gives matches by their ends, and those of one end by their beginnings.
        """
        n = len(text)
        best, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, found, pieces, single = 0, None, 0, False  # the character that ends what is being compared

        def close() -> None:
            """The best way to the place behind ``at``: a match, or the unknown piece if the character has none of its own."""
            to = at + 1
            if not single and (found is None or best[at] + self.unknown > found):
                best[to], open_[to] = best[at] + self.unknown, True
                count[to] = count[at] + (len(text[at].encode()) if self.fallback else int(not open_[at]))
            else:
                best[to], count[to] = found, pieces

        for last, (size, score) in self.automaton.iter(text):
            while at < last:
                close()
                at, found, single = at + 1, None, False
            begin = last + 1 - size
            total = best[begin] + score
            if size == 1:
                single = True
            if found is None or total > found:
                found, pieces = total, count[begin] + 1
        while at < n:
            close()
            at, found, single = at + 1, None, False
        return count[n]

    def __call__(self, text: str | None) -> int:
        """Pieces of a text: blanks become word marks, one is put in front."""
        if not text:
            return 0
        if not self.by_words:
            return self.viterbi(MARK + text.replace(" ", MARK))
        total, known = 0, self.known
        for word in _WORD.findall(MARK + text.replace(" ", MARK)):
            n = known.get(word)
            if n is None:
                n = self.viterbi(word)
                if len(word) <= _LONGEST:
                    if len(known) >= _MEMO:
                        known.clear()
                    known[word] = n
            total += n
        return total


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@cache
def counter(model_path: str) -> PieceCounter:
    """One for each worker process, so that tasks share what it remembers."""
    pieces, _, fallback = vocabulary(model_path)
    return PieceCounter(pieces, fallback)


def piece_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_chars, n_pieces) of every whole text under the vocabulary of a SentencePiece model file, as a unigram model."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for part in parts:
            texts = part.column(1).to_pylist()
            chars, counts = [len(t or "") for t in texts], [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chars, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_pieces"])

    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(batches, "doc_id long, n_chars long, n_pieces long")
