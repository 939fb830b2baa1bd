"""Symbol sets (FIRST, FIRST that looks past water, FOLLOW, reachable terminals) and the checks of a grammar."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

from .model import ANY, EOF, UNDEFINED, Alternative, Entry, Grammar, Message

#: Stands for the empty string in FIRST sets.
EMPTY = ""


def _components(edges: dict[str, Iterable[str]]) -> Iterator[list[str]]:
    """Strongly connected components of what has edges, each after all that it leads to (Tarjan's algorithm, without recursion)."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    done: set[str] = set()
    for root in edges:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        path = [(root, iter(edges[root]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in number:
                    if other not in edges:
                        continue
                    number[other] = low[other] = len(number)
                    held.append(other)
                    path.append((other, iter(edges[other])))
                    break
                if other not in done and number[other] < low[node]:
                    low[node] = number[other]
            else:
                path.pop()
                if path and low[node] < low[path[-1][0]]:
                    low[path[-1][0]] = low[node]
                if low[node] == number[node]:
                    at = len(held) - 1
                    while held[at] != node:
                        at -= 1
                    own = held[at:]
                    del held[at:]
                    done.update(own)
                    yield own


def _gathered(start: dict[str, set[str]], edges: dict[str, Iterable[str]]) -> dict[str, frozenset[str]]:
    """What each name starts with and all that those start with which it leads to, near or far; each is looked at once."""
    out = {name: frozenset(own) for name, own in start.items() if not edges[name]}
    for own in _components({name: to for name, to in edges.items() if to}):
        if len(own) == 1 and len(edges[own[0]]) == 1 and own[0] not in edges[own[0]]:
            (other,) = edges[own[0]]
            out[own[0]] = out[other] | start[own[0]]
            continue
        found: set[str] = set()
        for name in own:
            found |= start[name]
            for other in edges[name]:
                if other in out:
                    found |= out[other]
        out.update(dict.fromkeys(own, frozenset(found)))
    return {name: out[name] for name in start}


class Sets:
    """All sets of one grammar, each computed when first asked for, in one walk over the rules in the order in which they lead to each other."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self._runs: dict[tuple, frozenset[str]] = {}

    def _empty(self, past_water: bool) -> set[str]:
        """Rules that may match nothing."""
        rules = self.grammar.rules
        out: set[str] = set()
        waiting: dict[str, list[list]] = {}
        todo: list[str] = []
        for r in rules.values():
            for a in r.alternatives:
                left = [s for s in a.symbols if s != ANY] if past_water else a.symbols
                if not left:
                    todo.append(r.name)
                elif left[0] in rules and all(s in rules for s in left):
                    state = [r.name, len(left)]
                    for s in left:
                        waiting.setdefault(s, []).append(state)
        while todo:
            if (name := todo.pop()) not in out:
                out.add(name)
                for state in waiting.get(name, ()):
                    state[1] -= 1
                    if not state[1]:
                        todo.append(state[0])
        return out

    def _chain(self, firsts: dict, symbols: Iterable[str], past_water: bool) -> set[str]:
        out: set[str] = set()
        for s in symbols:
            own = firsts.get(s, {s})
            out |= own
            out.discard(EMPTY)
            if EMPTY not in own and not (past_water and s == ANY):
                return out
        return out | {EMPTY}

    def _firsts(self, past_water: bool) -> dict[str, frozenset[str]]:
        rules, empty = self.grammar.rules, self._empty(past_water)
        start: dict[str, set[str]] = {}
        edges: dict[str, list[str]] = {}
        for r in rules.values():
            own, to = start[r.name], edges[r.name] = set(), []
            for a in r.alternatives:
                for s in a.symbols:
                    if s in rules:
                        to.append(s)
                    else:
                        own.add(s)
                    if s not in empty and not (past_water and s == ANY):
                        break
        return {r: own | {EMPTY} if r in empty else own for r, own in _gathered(start, edges).items()}

    @cached_property
    def firsts(self) -> dict[str, frozenset[str]]:
        return self._firsts(False)

    @cached_property
    def water_firsts(self) -> dict[str, frozenset[str]]:
        return self._firsts(True)

    def first(self, symbols: Iterable[str], past_water: bool = False) -> frozenset[str]:
        """FIRST of a sequence; ``past_water``: does not stop at a wildcard, which may match nothing."""
        key = (past_water, *symbols)
        if key not in self._runs:
            if len(self._runs) > 50_000:
                self._runs.clear()
            self._runs[key] = frozenset(self._chain(self.water_firsts if past_water else self.firsts, key[1:], past_water))
        return self._runs[key]

    def nullable(self, symbol: str) -> bool:
        return EMPTY in self.firsts.get(symbol, ())

    @cached_property
    def follows(self) -> dict[str, frozenset[str]]:
        rules, firsts = self.grammar.rules, self.firsts
        start: dict[str, set[str]] = {r: set() for r in rules}
        edges: dict[str, set[str]] = {r: set() for r in rules}
        if self.grammar.start in start:
            start[self.grammar.start].add(EOF)
        for r in rules.values():
            for a in r.alternatives:
                after, ends = frozenset(), True  # what can stand behind within the alternative, and whether that may be nothing
                for s in reversed(a.symbols):
                    own = firsts.get(s)
                    if own is None:
                        after, ends = {s}, False
                        continue
                    start[s] |= after
                    if ends:
                        edges[s].add(r.name)
                    if EMPTY in own:
                        after = after | own - {EMPTY}
                    else:
                        after, ends = own, False
        return _gathered(start, edges)

    @cached_property
    def terminals_of(self) -> dict[str, frozenset[str]]:
        """Terminals in whatever a rule derives."""
        rules = self.grammar.rules
        below = {r.name: {s for a in r.alternatives for s in a.symbols} for r in rules.values()}
        return _gathered({r: {s for s in own if s not in rules} for r, own in below.items()}, {r: [s for s in own if s in rules] for r, own in below.items()})

    @cached_property
    def _beginning(self) -> dict[str, set[str]]:
        """Rules that a rule can begin with, behind nullable symbols, at once."""
        rules, firsts = self.grammar.rules, self.firsts
        out: dict[str, set[str]] = {r: set() for r in rules}
        for r in rules.values():
            for a in r.alternatives:
                for s in a.symbols:
                    if s not in rules:
                        break
                    out[r.name].add(s)
                    if EMPTY not in firsts[s]:
                        break
        return out

    @cached_property
    def begins(self) -> dict[str, frozenset[str]]:
        """Rules that a rule can begin with, behind nullable symbols (itself only if it is left-recursive)."""
        return _gathered(self._beginning, self._beginning)

    @cached_property
    def left_recursive(self) -> frozenset[str]:
        """Rules that can begin with themselves."""
        return frozenset(r for own in _components({r: to for r, to in self._beginning.items() if to}) if len(own) > 1 or own[0] in self._beginning[own[0]] for r in own)

    def water_entry(self, rule: str) -> tuple[Entry, tuple[str, ...]] | None:
        """The wildcard that ``rule`` can begin with, and the symbols that then follow it within the rule."""
        seen, todo = set(), [(rule, ())]
        while todo:
            name, rest = todo.pop(0)
            if name in seen:
                continue
            seen.add(name)
            for a in self.grammar.rules[name].alternatives:
                for k, e in enumerate(a.entries):
                    if e.symbol == ANY:
                        return e, a.symbols[k + 1 :] + rest
                    if e.symbol in self.grammar.rules:
                        todo.append((e.symbol, a.symbols[k + 1 :] + rest))
                    if not self.nullable(e.symbol):
                        break
        return None


def _entries(grammar: Grammar) -> Iterable[tuple[Alternative, int, Entry]]:
    for rule in grammar.rules.values():
        for a in rule.alternatives:
            for k, e in enumerate(a.entries):
                yield a, k, e


def check(grammar: Grammar, sets: Sets | None = None) -> list[Message]:
    """Errors and warnings of a grammar that was read; fills in a bare ``recovery`` option."""
    sets = sets or Sets(grammar)
    rules, terminals = grammar.rules, grammar.terminals
    out: list[Message] = []
    say = lambda kind, text, rule=None: out.append(Message(kind, text, rules[rule].line if rule in rules else grammar.lines.get(rule)))
    known = {ANY, EOF, UNDEFINED, *rules, *terminals}
    if not grammar.start:
        say("error", "no start symbol is given")
    elif grammar.start not in rules:
        say("error", f"the start symbol {grammar.start} is not a rule")
    for a, _, e in _entries(grammar):
        if e.symbol not in known:
            say("error", f"unknown symbol {e.symbol} in {grammar.shown(a.rule)}", a.rule)
        seen: set[str] = set()
        for name, symbols in e.arguments:
            if unknown := symbols - known:
                say("error", f"unknown symbols {', '.join(sorted(unknown))} in {name} of {grammar.shown(a.rule)}", a.rule)
            if seen & symbols:
                say("error", f"arguments of {ANY} share {', '.join(sorted(map(grammar.shown, seen & symbols)))}", a.rule)
            seen |= symbols
    aliases: dict[str, str] = {}
    for r in rules.values():
        for alias in {a.alias for a in r.alternatives if a.alias}:
            if alias in rules or alias in terminals or aliases.setdefault(alias, r.name) != r.name and not r.shown:
                say("error", f"alias {alias} is the name of something else", r.name)
            if grammar.kind == "LR":
                say("warning", f"alias {alias} has no effect in an LR grammar", r.name)
    roles: dict[str, str] = {}
    for p in grammar.pairs.values():
        for name in p.left | p.right:
            if name not in terminals:
                say("warning", f"pair {p.name} uses the unknown terminal {name}", p.name)
            elif roles.setdefault(name, p.name) != p.name:
                say("error", f"{grammar.shown(name)} belongs to two pairs", p.name)
    for group in ("parsing", "nodes", "customblock"):
        for option, own in grammar.options.data.get(group, {}).items():
            for s in own:
                if s and s not in known and s not in aliases:
                    say("error", f"unknown symbol {s} in option {option}")
    for s in grammar.options.symbols("parsing", "skip"):
        if s not in terminals:
            say("error", f"{s} is no terminal and cannot be skipped")
        elif s in roles:
            say("error", f"{grammar.shown(s)} belongs to a pair and cannot be skipped")
    if any(m.kind == "error" for m in out):
        return out
    watery = [r for r in rules if ANY in sets.firsts[r]]
    if grammar.recovers():
        given = grammar.options.symbols("parsing", "recovery")
        for s in given:
            if s not in rules or s not in watery:
                say("error", f"recovery is only for rules that can begin with {ANY}, not for {s}")
        if not given:
            grammar.options.set("parsing", "recovery", watery)
    if grammar.kind == "LL":
        for r in rules:
            if r in sets.left_recursive:
                say("error", f"{grammar.shown(r)} is left-recursive", r)
            if rules[r].shown and rules[r].shown[-1] in "*+" and (a := rules[r].alternatives[0]).entries and sets.nullable(a.symbols[0]):
                say("error", f"{grammar.shown(r)} repeats what may be empty", r)
    out += consecutive_water(grammar, sets)
    return out


def consecutive_water(grammar: Grammar, sets: Sets) -> list[Message]:
    """Warnings for wildcards that another may follow at once; what the first stops at is then unclear.

    Each wildcard stands for itself here: FIRST and FOLLOW are found once, over places instead of names.
    """
    places = {(id(a), k): f"{ANY}@{n}" for n, (a, k, e) in enumerate((a, k, e) for a, k, e in _entries(grammar) if e.symbol == ANY)}
    if not places:
        return []
    where: dict[str, tuple[Alternative, Entry]] = {}
    split = Grammar(grammar.kind, options=grammar.options)
    for r in grammar.rules.values():
        own = []
        for a in r.alternatives:
            entries = []
            for k, e in enumerate(a.entries):
                if e.symbol == ANY:
                    where[places[id(a), k]] = (a, e)
                    e = Entry(places[id(a), k], e.options, e.arguments)
                entries.append(e)
            own.append(Alternative(r.name, tuple(entries), a.alias))
        split.rules[r.name] = type(r)(r.name, own)
    found = Sets(split)
    out = []
    for r in split.rules.values():
        for a in r.alternatives:
            for k, e in enumerate(a.entries):
                if e.symbol not in where or e.argument("Except") is not None:
                    continue
                after = found.first(a.symbols[k + 1 :])
                if EMPTY in after:
                    after = after | found.follows[r.name]
                for other in sorted(s for s in after if s in where):
                    out.append(Message("warning", f"{ANY} in {grammar.shown(r.name)} may be followed by {ANY} in {grammar.shown(where[other][0].rule)}", grammar.rules[r.name].line))
    return out
