"""Lexing: terminal patterns as Python regular expressions, longest match, first definition on ties; nesting; custom blocks.

Patterns: ``'literal'``, ``[set]``, ``~[set]`` or ``~'x'``, ``.``, groups, ``|``, ``? * +`` with a lazy ``?`` behind them, and names
of other terminals. A pattern that uses itself once is unrolled ``DEEP`` times, one that does more often ``DEPTH`` times.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _parser

from ..grammar.model import AUTO_TOKEN, EOF, ERROR, UNDEFINED, Grammar, GrammarError, Message

DEPTH, DEEP = 4, 64
_PART = re.compile(r"'(?:\\(?:u[0-9a-fA-F]{4}|.)|[^'\\])*'|\[(?:\\.|[^\]\\])*\]|[A-Za-z_]\w*|[~.()|]|[*+?]\??|\s+|->.*", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
# What an escape stands for.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "b": "\b"}


def _uses(terminals: dict, name: str, wanted: str) -> bool:
    """Whether a terminal's pattern names another one, through others too."""
    seen, todo = set(), [name]
    while todo:
        now = todo.pop()
        if now not in seen:
            seen.add(now)
            todo += [p for p in _PART.findall(terminals[now].pattern) if p in terminals]
    return wanted in seen - {name} or wanted in _PART.findall(terminals[name].pattern)


def literal_text(quoted: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), quoted[1:-1])


def _set_body(text: str) -> str:
    """The inside of a ``[set]`` as that of a Python one; a dash is a range only between two characters."""
    units = [(chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), True) if (m := _ESCAPE.fullmatch(u)) else (u, False) for u in re.findall(r"\\u[0-9a-fA-F]{4}|\\.|.", text, re.S)]
    out = []
    for k, (c, escaped) in enumerate(units):
        out.append("-" if c == "-" and not escaped and 0 < k < len(units) - 1 else re.escape(c))
    return "".join(out)


class Patterns:
    """Translates the terminals of one grammar."""

    def __init__(self, grammar: Grammar):
        self.terminals = grammar.terminals
        self.ignore_case = grammar.options.is_set("parsing", "ignorecase")

    def _literal(self, text: str) -> str:
        if not self.ignore_case:
            return re.escape(text)
        return "".join(f"[{re.escape(c.lower())}{re.escape(c.upper())}]" if c.lower() != c.upper() and len(c.upper()) == 1 else re.escape(c) for c in text)

    def translate(self, pattern: str, depth: dict[str, int] | None = None) -> list[str]:
        """The pattern's top-level branches: they are tried apart, as the longest one counts."""
        depth, branches, stack, at, negate = depth or {}, [[]], [], 0, False
        put = lambda x: branches[-1].append(x)
        while at < len(pattern):
            m = _PART.match(pattern, at)
            if not m:
                raise GrammarError(f"cannot read {pattern[at:]!r} in the pattern {pattern}")
            part, at = m[0], m.end()
            if part.startswith("->"):
                break
            if part.isspace():
                continue
            if part == "~":
                negate = True
            elif part[0] == "'":
                text = literal_text(part)
                put(f"[^{re.escape(text)}]" if negate else f"(?:{self._literal(text)})" if len(text) != 1 else self._literal(text))
                negate = False
            elif part[0] == "[":
                put(f"[{'^' * negate}{_set_body(part[1:-1])}]")
                negate = False
            elif part == ".":
                put("(?s:.)")
            elif part == "(":
                stack.append((branches, negate))
                branches, negate = [[]], False
            elif part == ")":
                inner = sorted(("".join(b) for b in branches), key=lambda b: -len(b)) if all(self._plain(b) for b in branches) else ["".join(b) for b in branches]
                branches, negated = stack.pop()
                put(f"(?:(?!{'|'.join(inner)})(?s:.))" if negated else f"(?:{'|'.join(inner)})")
            elif part == "|":
                branches.append([])
            elif part[0] in "*+?":
                put(part)
            else:
                if part not in self.terminals:
                    raise GrammarError(f"the pattern {pattern} uses the unknown terminal {part}")
                used = depth.get(part, 0)
                inner = self.translate(self.terminals[part].pattern, depth | {part: used + 1}) if used < self._most(part) else ["(?!)"]
                put(f"(?:{'|'.join(inner)})")
        return ["".join(b) for b in branches]

    def _most(self, name: str) -> int:
        """How deep a terminal's own pattern may stand in itself, so that what it makes stays small."""
        uses = [p for p in _PART.findall(self.terminals[name].pattern) if p in self.terminals]
        return DEEP if uses.count(name) == 1 and all(u == name or not _uses(self.terminals, u, name) for u in uses) else DEPTH

    @staticmethod
    def _plain(branch: list[str]) -> bool:
        return all(not re.search(r"[*+?]$", x) and not x.startswith(("[^", "(?s")) for x in branch)


@dataclass(slots=True)
class Token:
    name: str
    text: str
    start: int
    #: The offset of the last character; a token's segment is closed.
    end: int
    line: int
    column: int
    direction: str = "forward"
    pair: str | None = None
    depth: int = 0


@dataclass
class Block:
    """A custom block: from a start lexeme to its end lexeme."""

    start: Token
    name: str
    end: Token | None = None
    children: list[Block] = field(default_factory=list)


@dataclass
class Lexed:
    """All tokens of a text with their nesting, the end of the file last, and what was noticed.

    Nesting depends on the tokens before alone, so it is found once; going back while parsing is going to an index.
    """

    tokens: list[Token]
    messages: list[Message]
    blocks: list[Block]


class Lexer:
    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        patterns = Patterns(grammar)
        fragments = set(grammar.options.symbols("parsing", "fragment"))
        self.drop_unknown = grammar.options.is_set("parsing", "ignoreundefined")
        ordered = sorted(grammar.terminals.values(), key=lambda t: not t.name.startswith(AUTO_TOKEN))
        self.rules = [(t.name, [re.compile(b) for b in patterns.translate(t.pattern)], t.line_start) for t in ordered if t.name not in fragments]
        self.roles = {n: (p.name, n in p.left, n in p.right) for p in grammar.pairs.values() for n in p.left | p.right}
        options = grammar.options
        self.base = next(iter(options.symbols("customblock", "basetoken")), None)
        self.begins = [str(x) for x in options.parameters("customblock", "start")] + ["", ""]
        self.ends = [str(x) for x in options.parameters("customblock", "end")] + ["", ""]
        self._first: dict[str, list] = {}
        self._tried: dict[str, tuple] = {}

    def _candidates(self, char: str) -> list:
        """Rules that can match a text beginning with ``char``; tried once for each character by what they refuse outright."""
        found = self._first.get(char)
        if found is None:
            found = self._first[char] = [(r[0], own, r[2]) for r in self.rules if (own := [b for b in r[1] if _may_begin(b.pattern, char)])]
        return found

    def _branches(self, char: str) -> tuple:
        """The candidates' branches for the scan: those of fixed lengths as one expression, the longest first, with (name, rank) of each; the others one by one."""
        own = [(name, b, line_start) for name, branches, line_start in self._candidates(char) for b in branches]
        widths = [_parser.parse(b.pattern).getwidth() for _, b, _ in own]
        fixed = sorted((-lo, k) for k, (lo, hi) in enumerate(widths) if lo == hi and not own[k][2] and not own[k][1].groups and not own[k][1].flags & ~re.U)
        one = re.compile("|".join(f"({own[k][1].pattern})" for _, k in fixed)).match if len(fixed) > 1 else None
        alone = {k for _, k in fixed} if one else set()
        rest = [(name, b.match, line_start, k) for k, (name, b, line_start) in enumerate(own) if k not in alone]
        self._tried[char] = found = (one, [("", 0), *((own[k][0], k) for _, k in fixed)], rest)
        return found

    def scan(self, text: str) -> list[Token]:
        out, at, n, known, drop = [], 0, len(text), self._tried, self.drop_unknown
        line, begin, stop = 1, 0, text.find("\n") % (n + 1)  # of the line at hand: its number, where it begins, and its line break or the text's end
        while at < n:
            best, size, rank, char = None, 0, 0, text[at]
            one, names, rest = known.get(char) or self._branches(char)
            if one is not None:
                if m := one(text, at):
                    best, rank = names[m.lastindex]
                    size = m.end() - at
            elif not rest and (drop or char in " \n\r\t\u00a0"):
                at += 1
                continue
            for name, match, line_start, k in rest:
                if line_start and at and text[at - 1] != "\n":
                    continue
                if (m := match(text, at)) and ((own := m.end() - at) > size or own == size > 0 and k < rank):
                    best, size, rank = name, own, k
            if best is None:
                size = 1
                if char not in " \n\r\t\u00a0" and not drop:
                    best = UNDEFINED
            elif size == 1 and char in " \n\r\t\u00a0" and best == UNDEFINED:
                best = None
            if best:
                while stop < at:
                    line, begin = line + 1, stop + 1
                    stop = text.find("\n", begin) % (n + 1)
                out.append(Token(best, text[at : at + size], at, at + size - 1, line, at - begin))
            at += size
        lines = text.count("\n")
        out.append(Token(EOF, "", n, n, lines + 1, n - 1 - text.rfind("\n")))
        return out

    @property
    def tells(self) -> tuple:
        """Lexers of which this is equal give the same for any text."""
        rules = tuple((name, tuple((b.pattern, b.flags) for b in branches), line_start) for name, branches, line_start in self.rules)
        pairs = tuple(sorted((p.name, p.left, p.right) for p in self.grammar.pairs.values()))
        return rules, pairs, self.drop_unknown, self.base, *self.begins, *self.ends

    def __call__(self, text: str) -> Lexed:
        tokens, messages = self.scan(text), []
        self.nest(tokens, messages)
        return Lexed(tokens, messages, self._blocks(tokens, messages))

    def nest(self, tokens: list[Token], messages: list[Message]) -> None:
        """Depths as before the token opens or after it closes nothing yet: an opener stands outside, its closer inside."""
        stack: list[tuple[str, Token]] = []
        roles = self.roles
        for k, t in enumerate(tokens):
            t.depth = len(stack)
            if t.name not in roles:
                continue
            pair, left, right = roles[t.name]
            t.pair = pair
            top = stack[-1][0] if stack else None
            if right and (not left or top == pair):
                if top != pair:
                    what = f"closes nothing: {self.grammar.shown(t.name)}" if top is None else f"{self.grammar.shown(t.name)} closes {pair} where {top} is open"
                    expected = tuple(sorted(self.grammar.pairs[top].right)) if top else ()
                    messages.append(Message("error", what, t.line, t.column, t.start, "nesting", t.name, t.text, expected))
                    del tokens[k:]
                    tokens.append(Token(ERROR, "", t.start, t.start, t.line, t.column, depth=len(stack)))
                    return
                t.direction = "up"
                stack.pop()
            else:
                t.direction = "down"
                stack.append((pair, t))
        for pair, t in stack:
            messages.append(Message("warning", f"{pair} is not closed", t.line, t.column, t.start, "nesting", t.name, t.text, tuple(sorted(self.grammar.pairs[pair].right))))

    def _blocks(self, tokens: list[Token], messages: list[Message]) -> list[Block]:
        """The forest of closed blocks; a block that is never closed is dropped with those inside it."""
        if not self.base:
            return []
        roots: list[Block] = []
        stack: list[Block] = []
        for t in tokens:
            if t.name != self.base:
                continue
            if t.text.startswith(self.begins[0]) and t.text.endswith(self.begins[1]):
                name = t.text[len(self.begins[0]) : len(t.text) - len(self.begins[1])].strip()
                stack.append(Block(t, name))
            elif t.text.startswith(self.ends[0]) and t.text.endswith(self.ends[1]):
                if not stack:
                    messages.append(Message("error", "a custom block ends that did not begin", t.line, t.column, t.start, "blocks", t.name, t.text))
                    continue
                block = stack.pop()
                block.end = t
                (stack[-1].children if stack else roots).append(block)
        return roots


def _may_begin(pattern: str, char: str) -> bool:
    """False only if no text that begins with ``char`` can match: a literal, or a first character or set that must be there.

    ``pattern`` is one branch: alternatives stand in groups.
    """
    if m := re.match(r"\(\?:(?=\[)((?:\[(?:\\.|[^\]\\])*\]|\\.|[^\\()|\[\].*+?{])+)\)", pattern, re.S):
        first = re.match(r"\[(?:\\.|[^\]\\])*\]", m[1], re.S)[0]  # a literal in either case
    elif m := re.match(r"\(\?:((?:\\.|[^\\()|\[\].*+?{])+)\)", pattern, re.S):
        first = re.match(r"\\.|.", m[1], re.S)[0]
    elif m := re.match(r"\[(?:\\.|[^\]\\])*\]|\\.|[^\\\[(.^$*+?{)]", pattern, re.S):
        first = m[0]
    else:
        return True
    return pattern[m.end() : m.end() + 1] in tuple("*?{") or bool(re.match(first, char, re.S))
