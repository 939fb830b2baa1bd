"""A tolerant grammar as data: terminals, nesting pairs, rules with wildcard entries, options."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

ANY, EOF, ERROR, UNDEFINED = "Any", "EOF", "ERROR", "UNDEFINED"
#: Names of generated rules and of terminals for literals inside rules.
AUTO_RULE, AUTO_TOKEN = "auto__", "AUTO__"
BLOCK = "custom_block"

#: What a wildcard may be told, and the options by group.
ANY_ARGUMENTS = ("Include", "Except", "Avoid", "IgnorePairs", "Error")
OPTION_GROUPS = {
    "parsing": ("start", "skip", "ignorecase", "fragment", "ignoreundefined", "recovery", "userify"),
    "nodes": ("ghost", "list", "leaf", "void"),
    "customblock": ("start", "end", "basetoken"),
}


class GrammarError(ValueError):
    """A grammar text that cannot be read, or that did not pass its checks."""


@dataclass(frozen=True)
class Message:
    """One diagnostic; ``kind`` is error, warning or trace."""

    kind: str
    text: str
    line: int | None = None
    column: int | None = None
    offset: int | None = None
    source: str = "grammar"
    unexpected_token: str | None = None
    unexpected_lexeme: str | None = None
    expected: tuple[str, ...] = ()


@dataclass(frozen=True)
class Terminal:
    name: str
    pattern: str
    line_start: bool = False


@dataclass(frozen=True)
class Pair:
    name: str
    left: frozenset[str]
    right: frozenset[str]


@dataclass(frozen=True)
class Entry:
    """A symbol in an alternative, with local node options and the wildcard's arguments."""

    symbol: str
    options: tuple[tuple[str, tuple[str, ...]], ...] = ()
    arguments: tuple[tuple[str, frozenset[str]], ...] = ()

    def argument(self, name: str) -> frozenset[str] | None:
        return next((v for k, v in self.arguments if k == name), None)


@dataclass(frozen=True)
class Alternative:
    rule: str
    entries: tuple[Entry, ...]
    alias: str | None = None

    @cached_property
    def symbols(self) -> tuple[str, ...]:
        return tuple([e.symbol for e in self.entries])

    @cached_property
    def backwards(self) -> tuple[Entry, ...]:
        return self.entries[::-1]


@dataclass
class Rule:
    name: str
    alternatives: list[Alternative] = field(default_factory=list)
    #: The quantified or grouped text that a generated rule stands for.
    shown: str | None = None
    #: Whether a non-empty branch wins where both could go on (LL only).
    greedy: bool = False
    line: int | None = None


@dataclass
class Options:
    """group -> option -> symbol ("" for the whole grammar) -> parameters."""

    data: dict[str, dict[str, dict[str, list]]] = field(default_factory=dict)

    def set(self, group: str, option: str, symbols: list[str] | None = None, parameters: list | None = None) -> None:
        own = self.data.setdefault(group.lower(), {}).setdefault(option.lower(), {})
        for s in symbols or [""]:
            own.setdefault(s, []).extend(parameters or [])

    def is_set(self, group: str, option: str, symbol: str | None = None) -> bool:
        own = self.data.get(group, {}).get(option)
        return own is not None and (symbol is None or symbol in own)

    def symbols(self, group: str, option: str) -> list[str]:
        return [s for s in self.data.get(group, {}).get(option, {}) if s]

    def parameters(self, group: str, option: str, symbol: str = "") -> list:
        return self.data.get(group, {}).get(option, {}).get(symbol, [])

    def clear(self, group: str, option: str | None = None) -> None:
        if option is None:
            self.data.pop(group, None)
        else:
            self.data.get(group, {}).pop(option, None)

    def clone(self) -> Options:
        return Options(json.loads(json.dumps(self.data)))


@dataclass
class Grammar:
    """What a grammar text says; ``kind`` is LL or LR and decides how quantifiers are expanded."""

    kind: str
    terminals: dict[str, Terminal] = field(default_factory=dict)
    pairs: dict[str, Pair] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    options: Options = field(default_factory=Options)
    lines: dict[str, int] = field(default_factory=dict)

    @property
    def start(self) -> str | None:
        return next(iter(self.options.symbols("parsing", "start")), None)

    @property
    def aliases(self) -> dict[str, str]:
        """alias -> rule."""
        return {a.alias: r.name for r in self.rules.values() for a in r.alternatives if a.alias}

    def is_rule(self, symbol: str) -> bool:
        return symbol in self.rules

    def shown(self, symbol: str) -> str:
        """A symbol as its author wrote it: quantified groups and literals instead of generated names."""
        if (named := self.options.parameters("parsing", "userify", symbol)) or self.options.is_set("parsing", "userify", symbol):
            return str(named[0]) if named else symbol
        rule = self.rules.get(symbol)
        if rule and rule.shown:
            return rule.shown
        if symbol.startswith(AUTO_TOKEN) and symbol in self.terminals:
            return self.terminals[symbol].pattern
        return symbol

    def shown_alternative(self, alternative: Alternative) -> str:
        return " ".join(map(self.shown, alternative.symbols)) or "ε"

    def skipped(self) -> frozenset[str]:
        return frozenset(self.options.symbols("parsing", "skip"))

    def recovery(self) -> frozenset[str]:
        return frozenset(self.options.symbols("parsing", "recovery"))

    def recovers(self) -> bool:
        return self.options.is_set("parsing", "recovery")

    def to_text(self) -> str:
        """The grammar in its own language; generated rules are written out under their names."""
        out = [f"{t.name} : {'%linestart ' * t.line_start}{t.pattern}" for t in self.terminals.values() if not t.name.startswith(AUTO_TOKEN)]
        border = lambda names: "(" + "|".join(sorted(map(self._literal, names))) + ")"
        out += [f"{p.name} : %left {border(p.left)} %right {border(p.right)}" for p in self.pairs.values()]
        for r in self.rules.values():
            alternatives = (" ".join(map(self._entry, a.entries)) + f" => {a.alias}" * bool(a.alias) for a in r.alternatives)
            out.append(f"{r.name} = " + " | ".join(alternatives))
        out.append("%%")
        for group, options in self.options.data.items():
            lines = []
            for option, symbols in options.items():
                for symbol, parameters in symbols.items():
                    given = "(" + ", ".join(json.dumps(p, ensure_ascii=False) for p in parameters) + ")" if parameters else ""
                    lines.append(f"\t{option}{given} {self._literal(symbol) if symbol else ''}".rstrip())
            out += [f"%{group} {{", *lines, "}"]
        return "\n".join(out) + "\n"

    def _literal(self, symbol: str) -> str:
        return self.terminals[symbol].pattern if symbol.startswith(AUTO_TOKEN) and symbol in self.terminals else symbol

    def _entry(self, entry: Entry) -> str:
        local = "".join(f"%nodes({', '.join(names)}) " for group, names in entry.options if group == "nodes")
        given = ", ".join(f"{name}({', '.join(sorted(map(self._literal, own)))})" for name, own in entry.arguments)
        return local + self._literal(entry.symbol) + f"({given})" * bool(given)

    def to_json(self) -> str:
        """The grammar as replayable steps: one object per definition."""
        steps: list[dict] = [{"step": "terminal", "name": t.name, "pattern": t.pattern, "line_start": t.line_start} for t in self.terminals.values()]
        steps += [{"step": "pair", "name": p.name, "left": sorted(p.left), "right": sorted(p.right)} for p in self.pairs.values()]
        for r in self.rules.values():
            own = [
                {"alias": a.alias, "entries": [{"symbol": e.symbol, "options": [[g, list(n)] for g, n in e.options], "arguments": {k: sorted(v) for k, v in e.arguments}} for e in a.entries]}
                for a in r.alternatives
            ]
            steps.append({"step": "rule", "name": r.name, "shown": r.shown, "greedy": r.greedy, "alternatives": own})
        return json.dumps({"kind": self.kind, "steps": steps, "options": self.options.data}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Grammar:
        data = json.loads(text)
        g = cls(data["kind"], options=Options(data["options"]))
        for s in data["steps"]:
            name = s["name"]
            if s["step"] == "terminal":
                g.terminals[name] = Terminal(name, s["pattern"], s["line_start"])
            elif s["step"] == "pair":
                g.pairs[name] = Pair(name, frozenset(s["left"]), frozenset(s["right"]))
            else:
                g.rules[name] = Rule(name, [
                    Alternative(name, tuple(Entry(e["symbol"], tuple((k, tuple(n)) for k, n in e["options"]), tuple((k, frozenset(v)) for k, v in e["arguments"].items())) for e in a["entries"]), a["alias"])
                    for a in s["alternatives"]
                ], s["shown"], s["greedy"])
        return g
