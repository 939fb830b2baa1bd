"""Parse tables: LL(1), and canonical LR(1) with the markers that a wildcard's emptiness provokes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .analysis import EMPTY, Sets
from .model import ANY, EOF, Alternative, Entry, Grammar, Message

START = "start__"


class TableLL:
    """(rule, terminal) -> alternatives, the first of which is taken."""

    def __init__(self, grammar: Grammar, sets: Sets, only: Callable[[str], bool] | None = None):
        """``only``: the rules that cells are wanted of, where not all are."""
        self.grammar = grammar
        self.cells: dict[tuple[str, str], list[Alternative]] = {}
        for rule in grammar.rules.values() if only is None else [r for r in grammar.rules.values() if only(r.name)]:
            for a in rule.alternatives:
                first = sets.first(a.symbols)
                # of an empty branch: what follows the rule, unless a branch that isn't empty (or this one) begins with it
                taken = sets.firsts[rule.name] if rule.greedy else first
                for t in (first - {EMPTY}) | (sets.follows[rule.name] - taken if EMPTY in first else set()):
                    self.cells.setdefault((rule.name, t), []).append(a)

    def expected(self, rule: str) -> list[str]:
        return [t for r, t in self.cells if r == rule]

    def check(self) -> list[Message]:
        shown = self.grammar.shown
        return [
            Message("error", f"not LL(1): {shown(r)} on {shown(t)} allows " + ", ".join(map(self.grammar.shown_alternative, own)), self.grammar.rules[r].line)
            for (r, t), own in self.cells.items() if len(own) > 1
        ]

    def rows(self) -> list[tuple[str, str, str]]:
        """(rule, terminal, alternatives joined by /)."""
        return [(r, t, "/".join(map(self.grammar.shown_alternative, own))) for (r, t), own in sorted(self.cells.items())]


#: A marker: (alternative's number, place of the dot, lookahead).
Marker = tuple[int, int, str]


@dataclass
class State:
    markers: frozenset[Marker]
    #: Markers that hold only because a wildcard may match nothing; they never make actions, but tell what to stop at.
    provoked: frozenset[Marker]
    moves: dict[str, int] = field(default_factory=dict)


class TableLR:
    """States found from the augmented start rule, by a map from kernels; actions are ("shift", state), ("reduce", alternative) or ("accept",)."""

    def __init__(self, grammar: Grammar, sets: Sets):
        self.grammar, self.sets = grammar, sets
        self.alternatives = [Alternative(START, (Entry(grammar.start),))]
        self.of: dict[str, list[int]] = {}
        for rule in grammar.rules.values():
            self.of[rule.name] = range(len(self.alternatives), len(self.alternatives) + len(rule.alternatives))
            self.alternatives += rule.alternatives
        self.bodies = [a.symbols for a in self.alternatives]
        self.states: list[State] = []
        self.actions: list[dict[str, list[tuple]]] = []
        self.after_water: list[frozenset[str]] = []
        self._build()

    def _next(self, m: Marker) -> str | None:
        body = self.bodies[m[0]]
        return body[m[1]] if m[1] < len(body) else None

    def _closure(self, kernel: set[Marker], provoked: set[Marker]) -> tuple[frozenset[Marker], frozenset[Marker]]:
        plain, extra = set(kernel), set(provoked)
        todo = [(m, False) for m in kernel] + [(m, True) for m in provoked]
        while todo:
            m, from_extra = todo.pop()
            rule = self._next(m)
            if rule not in self.of:
                continue
            after = (*self.bodies[m[0]][m[1] + 1 :], m[2])
            usual = self.sets.first(after)
            beyond = self.sets.first(after, past_water=True) - {EMPTY}
            for a in self.of[rule]:
                if not from_extra:
                    for t in usual:
                        if (n := (a, 0, t)) not in plain:
                            plain.add(n)
                            todo.append((n, False))
                for t in beyond if from_extra else beyond - usual:
                    if (n := (a, 0, t)) not in extra:
                        extra.add(n)
                        todo.append((n, True))
        return frozenset(plain), frozenset(extra - plain)

    def _build(self) -> None:
        numbers: dict[tuple, int] = {}

        def state(kernel: frozenset[Marker], provoked: frozenset[Marker]) -> int:
            closed = self._closure(set(kernel), set(provoked))
            if closed not in numbers:
                numbers[closed] = len(self.states)
                self.states.append(State(*closed))
            return numbers[closed]

        state(frozenset({(0, 0, EOF)}), frozenset())
        at = 0
        while at < len(self.states):
            own = self.states[at]
            kernels: dict[str, tuple[set, set]] = {}
            for k, markers in enumerate((own.markers, own.provoked)):
                for m in markers:
                    if (s := self._next(m)) is not None:
                        kernels.setdefault(s, (set(), set()))[k].add((m[0], m[1] + 1, m[2]))
            for s in sorted(kernels):
                if kernels[s][0]:
                    own.moves[s] = state(*map(frozenset, kernels[s]))
            at += 1
        for own in self.states:
            cells: dict[str, list[tuple]] = {}
            for m in sorted(own.markers):
                s = self._next(m)
                if s is None:
                    action = ("accept",) if not m[0] else ("reduce", m[0])
                    if action not in cells.setdefault(m[2], []):
                        cells[m[2]].append(action)
                elif s not in self.of and ("shift", own.moves[s]) not in cells.setdefault(s, []):
                    cells[s].append(("shift", own.moves[s]))
            self.actions.append(cells)
        for own in self.states:
            ends = {m[2] for m in own.provoked if self._next(m) is None} | {s for m in own.provoked if (s := self._next(m)) is not None and s not in self.of}
            past = {s for m in own.markers | own.provoked if self._next(m) == ANY for s in self.sets.first((*self.bodies[m[0]][m[1] + 1 :], m[2]), past_water=True)}
            self.after_water.append(frozenset(ends | past) - {ANY, EMPTY})

    def action(self, state: int, token: str) -> tuple | None:
        """A shift if there is one, else the first."""
        own = self.actions[state].get(token)
        return next((a for a in own if a[0] == "shift"), own[0]) if own else None

    def expected(self, state: int) -> frozenset[str]:
        return frozenset(self.actions[state]) | self.after_water[state]

    def water_entry(self, state: int) -> Entry | None:
        found = [self.alternatives[m[0]].entries[m[1]] for m in sorted(self.states[state].markers) if self._next(m) == ANY]
        return found[0] if found else None

    def check(self) -> list[Message]:
        out, shown = [], self.grammar.shown
        for nr, cells in enumerate(self.actions):
            for t, own in cells.items():
                kinds = [a[0] for a in own]
                if "shift" in kinds and "reduce" in kinds and t != ANY:
                    out.append(Message("warning", f"shift and reduce on {shown(t)} in state {nr}; shift is taken"))
                if kinds.count("reduce") > 1:
                    out.append(Message("error", f"two reductions on {shown(t)} in state {nr}"))
            water = {e.arguments for m in self.states[nr].markers if self._next(m) == ANY for e in [self.alternatives[m[0]].entries[m[1]]]}
            if len(water) > 1:
                out.append(Message("error", f"different arguments of {ANY} in state {nr}"))
        return out

    def rows(self) -> list[tuple[str, str, str]]:
        say = lambda a: a[0] if len(a) == 1 else f"{a[0]} {a[1]}" if a[0] == "shift" else f"reduce {self.grammar.shown(self.alternatives[a[1]].rule)}"
        return [(str(nr), t, "/".join(map(say, own))) for nr, cells in enumerate(self.actions) for t, own in sorted(cells.items())]
