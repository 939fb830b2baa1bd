"""Grammars as documents: what grammar analysis finds in each of many grammar texts, as rows.

For corpora of grammars, such as a folder of them read by ``sources.files``: one stateless pass of the workers, no shuffle. A
text that is no grammar gives one row of kind ``error`` for each problem.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from ..frames import per_document
from ..grammar.analysis import EMPTY, Sets, check
from ..grammar.dsl import read_grammar
from ..grammar.model import GrammarError
from ..grammar.tables import TableLL

SETS = "doc_id long, kind string, rule string, symbol string, n int"
#: What can be asked for: FIRST, FIRST past water, FOLLOW, all terminals below, left recursion, the LL(1) table's cells (``n`` alternatives each), messages.
#: Beside these ``reachable_count``: how many terminals are below a rule (``n``), a row for each rule instead of one for each terminal of each.
KINDS = ("first", "water_first", "follow", "reachable", "left_recursive", "ll_cell", "message")

_SETS = {"first": "firsts", "water_first": "water_firsts", "follow": "follows", "reachable": "terminals_of"}


def _found(text: str, kinds: frozenset[str], kind: str, only: Callable[[str], bool] | None = None) -> Iterator[tuple[str, str, str | None, int]]:
    try:
        grammar, messages = read_grammar(text, kind)
    except GrammarError as e:
        yield from (("error", "", line, 1) for line in str(e).split("\n"))
        return
    sets = Sets(grammar)
    rules = list(grammar.rules) if only is None else [r for r in grammar.rules if only(r)]
    for name, of in _SETS.items():
        if name in kinds:
            found = getattr(sets, of)
            yield from [(name, rule, s, 1) for rule in rules for s in sorted(found[rule]) if s != EMPTY]
    if "reachable_count" in kinds:
        yield from (("reachable_count", rule, None, n) for rule in rules if (n := len(sets.terminals_of[rule])))
    if "left_recursive" in kinds:
        yield from (("left_recursive", rule, rule, 1) for rule in rules if rule in sets.left_recursive)
    if "ll_cell" in kinds:
        yield from [("ll_cell", rule, terminal, len(own)) for (rule, terminal), own in TableLL(grammar, sets, only).cells.items()]
    if "message" in kinds:
        yield from (("message", m.kind, m.text, 1) for m in [*messages, *check(grammar, sets)])


def analysis(docs: DataFrame, kinds: Iterable[str] = KINDS, kind: str = "LL", only: Callable[[str], bool] | None = None) -> DataFrame:
    """(doc_id, kind, rule, symbol, n) for the grammar in each text of (doc_id, text); of a message, ``rule`` is its kind and ``symbol`` its text.

    ``only``: the rules whose rows leave the workers, where not all are wanted; messages and errors stay.
    """
    wanted = frozenset(kinds)
    return per_document(docs, lambda doc, text: ((doc, *row) for row in _found(text, wanted, kind, only)), SETS)
