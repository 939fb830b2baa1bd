"""Visitors: steps that run after a tree's rewriting. Each takes the root and returns the new one.

    parser.rewriter.steps = (aggregate_routines,)      # or with_visitors(parser, aggregate_routines, mine)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from ..grammar.model import BLOCK
from .engine import Parser
from .tree import Node, Rewriter

Visitor = Callable[[Node], Node]


def with_visitors(parser: Parser, *visitors: Visitor) -> Parser:
    """The same parser, whose trees the visitors see after all rewriting."""
    out = replace(parser, messages=[])
    out.rewriter = Rewriter(out.grammar, out.single_pass, tuple(visitors))
    return out


def owners_by_stack(kinds: Sequence[str], opens: Callable[[int], bool], closes: Callable[[int], bool]) -> list[int | None]:
    """For each part of a flat sequence the innermost open routine before it.

    ``opens(i)``: part i is a routine header that more belongs to; ``closes(i)``: part i is the last of the innermost one.
    A routine within an open one belongs to it, and what follows belongs to the inner one until that is closed.
    """
    out: list[int | None] = []
    stack: list[int] = []
    for i in range(len(kinds)):
        out.append(stack[-1] if stack else None)
        if opens(i):
            stack.append(i)
        elif closes(i) and stack:
            stack.pop()
    return out


def aggregate_routines(
    root: Node, within: Sequence[str] = ("file",), routine: str = "routine", operator: str = "operator", closing: Sequence[str] = ("block", "tail"), bodiless: Sequence[str] = ("external", "forward"), complete: str = "routine_init",
) -> Node:
    """Pascal routines with their modifiers, declarations, blocks and tails below them; routines named by an operator get its symbol."""
    for node in list(root.walk()):
        if node.type == routine and any("operator" in v.lower() for c in node.children if c.type == "name" for v in c.value):
            node.symbol = node.shown = operator
            node.alias = None
        if node.type not in within:
            continue
        parts = node.children
        kinds = [c.type for c in parts]
        first = lambda n: next((v.lower() for v in n.text()), "")
        done = lambda i, own=parts: any(c.type == complete or first(c) in bodiless for c in own[i].children[1:])
        opens = lambda i, k=kinds, done=done: k[i] == routine and not done(i)
        closes = lambda i, k=kinds, own=parts: k[i] in closing or first(own[i]) in bodiless
        owner = owners_by_stack(kinds, opens, closes)
        for i, o in enumerate(owner):
            if o is not None:
                parts[o].children.append(parts[i])
                parts[i].parent = parts[o]
                if (span := parts[i].span()) and (own := parts[o].span()):
                    parts[o].place(min(span[0], own[0]), max(span[1], own[1]), own[2])
        node.adopt([c for c, o in zip(parts, owner, strict=True) if o is None])
    return root


def can_wrap(root: Node, start: int, end: int) -> bool:
    """Whether a custom block may take the segment: it holds whole children of one node, or lies between them."""
    within = lambda s: s is not None and start <= s[0] and s[1] <= end
    cuts = lambda s: s is not None and (start <= s[0] <= end) != (start <= s[1] <= end)
    holds = lambda s: s is not None and s[0] <= start and end <= s[1] and s[:2] != (start, end)
    if within(root.span()):
        return True
    node: Node | None = root
    while node is not None:
        spans = [(c, c.span()) for c in node.children]
        inner, cut, outer = ([c for c, s in spans if test(s)] for test in (within, cuts, holds))
        if len(outer) == 1:
            node = outer[0]
        elif len(cut) == 1 and not inner:
            node = cut[0]
        else:
            edges = any(c.symbol in ("custom_block_start", "custom_block_end") for c in inner)
            return not cut and not (inner and node.symbol == BLOCK and edges)
    return False
