"""Lexers as one regular expression for Spark's own functions, where it can be proved to give the same tokens.

A lexer takes the longest match of all rules, and the first rule of equal ones; an expression takes the first alternative that matches. The
two are the same if of any two rules the earlier one, wherever both match, matches at least as much. That is so

* where the two can never match at the same place: some character of their fixed beginnings is of disjoint sets; or
* where the later rule is a fixed beginning, then all characters up to a certain one, and that one (``'<' ~[>]* '>'``), and the earlier one
  always ends in that character, behind the length of that beginning: the later rule stops at the first such character.

Besides, only single characters are repeated (Spark's expressions recurse over groups), no rule matches nothing or looks at the line's
start, and there are no pairs, whose errors end the tokens. Any other grammar stays with the worker.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser

from .lexer import Lexer

Ranges = list[tuple[int, int]]
_ALL: Ranges = [(0, 0x10FFFF)]
#: White space that no rule needs to match, as the lexer has it.
_BLANK = " \\n\\r\\t\\u00a0"


def _complement(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    return [*out, (at, 0x10FFFF)] if at <= 0x10FFFF else out


def _disjoint(a: Ranges, b: Ranges) -> bool:
    return all(x[1] < y[0] or y[1] < x[0] for x in a for y in b)


def _items(pattern: str) -> list | None:
    """(fewest, most, characters, whether lazily) of a pattern's parts, groups without alternatives opened; None where there is anything but characters and their repetitions."""

    def opened(parsed) -> list | None:
        out: list = []
        for kind, argument in parsed:
            if kind is sre.SUBPATTERN and argument[0] is None:
                inner = opened(argument[3])
                if inner is None:
                    return None
                out += inner
            elif kind in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
                if (own := _characters(kind, argument)) is None:
                    return None
                out.append((1, 1, own, False))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                inner = opened(argument[2])
                if inner is None or len(inner) != 1 or inner[0][:2] != (1, 1):
                    return None
                out.append((argument[0], argument[1], inner[0][2], kind is sre.MIN_REPEAT))
            else:
                return None
        return out

    return opened(_parser.parse(pattern))


def _characters(kind, argument) -> Ranges | None:
    if kind is sre.ANY:
        return _ALL
    if kind is sre.LITERAL:
        return [(argument, argument)]
    if kind is sre.NOT_LITERAL:
        return _complement([(argument, argument)])
    found: Ranges = []
    for k, a in argument:
        if k is sre.LITERAL:
            found.append((a, a))
        elif k is sre.RANGE:
            found.append(a)
        elif k is not sre.NEGATE:
            return None
    return _complement(found) if argument[0][0] is sre.NEGATE else found


def _fixed(items: list) -> list[Ranges]:
    """The characters' sets of a beginning of fixed length."""
    out = []
    for low, high, own, _ in items:
        if (low, high) != (1, 1):
            break
        out.append(own)
    return out


def _certain(items: list) -> list[Ranges]:
    """The characters' sets of a beginning that every match has."""
    out = []
    for low, high, own, _ in items:
        out += [own] * low
        if low != high:
            break
    return out


def _written(items: list) -> str:
    """The parts as an expression of character sets and counts alone."""
    point = lambda c: rf"\x{{{c:X}}}"
    out = []
    for low, high, own, lazy in items:
        out.append("[" + "".join(point(a) if a == b else f"{point(a)}-{point(b)}" for a, b in own) + "]")
        if (low, high) != (1, 1):
            out.append(f"{{{low},{'' if high is sre.MAXREPEAT else high}}}" + "?" * lazy)
    return "".join(out)


def _never_shorter(first: list, later: list) -> bool:
    """Whether ``first`` matches at least as much as ``later`` wherever both match."""
    if any(_disjoint(a, b) for a, b in zip(_certain(first), _certain(later), strict=False)):
        return True
    head = _fixed(later)
    rest = later[len(head) :]
    if len(rest) != 2 or rest[1][:2] != (1, 1) or len(rest[1][2]) != 1:
        return False
    stop = rest[1][2]
    ends = first[-1][:2] == (1, 1) and sorted(first[-1][2]) == sorted(stop) and stop[0][0] == stop[0][1]
    upto = rest[0][0] == 0 and rest[0][1] is sre.MAXREPEAT and sorted(rest[0][2]) == sorted(_complement(stop))
    return ends and upto and sum(x[0] for x in first) > len(head)


def alternatives(lexer: Lexer) -> list[tuple[str, str]] | None:
    """(token name, expression) in the order in which they are tried, or None where the proof above does not hold."""
    if lexer.grammar.pairs or any(line_start for _, _, line_start in lexer.rules):
        return None
    rules = [(name, b.pattern) for name, branches, _ in lexer.rules for b in branches]
    parsed = [_items(p) for _, p in rules]
    if not rules or any(p is None or sum(x[0] for x in p) == 0 for p in parsed):
        return None
    if not all(_never_shorter(a, b) for k, a in enumerate(parsed) for b in parsed[k + 1 :]):
        return None
    return [(name, _written(p)) for (name, _), p in zip(rules, parsed, strict=True)]


def expression(lexer: Lexer) -> str | None:
    """One expression whose matches in a text are the lexer's tokens."""
    rules = alternatives(lexer)
    if rules is None:
        return None
    rest = [] if lexer.drop_unknown else [f"[^{_BLANK}]"]
    return "|".join([*(f"(?:{p})" for _, p in rules), *rest])


def name_pattern(pattern: str) -> str:
    """An expression that a whole token of a rule matches."""
    return rf"\A(?:{pattern})\z"

