"""Bundled grammars: name -> (kind, text)."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from ..parsing.engine import Parser, compile_grammar

#: What each grammar is compiled as.
KINDS = {
    "html_tags": "LL", "xml": "LL", "markdown": "LL", "csharp": "LL", "csharp_lr": "LR", "csharp_types": "LL", "csharp_branches": "LL", "csharp_branches_whole": "LL", "csharp_members": "LL", "csharp_operators_lr": "LR", "csharp_directives": "LL", "java": "LL", "java_lr": "LR",
    "java_plain_lr": "LR", "pascal": "LL", "pascal_routines": "LL", "pascal_statements": "LL", "pascal_directives": "LL", "typescript": "LL", "yacc": "LL", "lex": "LL", "consecutive_water": "LL", "braces_lr": "LR", "words": "LL", "lines": "LL",
}


def text(name: str) -> str:
    return (files(__package__) / f"{name}.grammar").read_text(encoding="utf-8")


@cache
def grammar(name: str) -> Parser:
    """A bundled grammar, compiled once per process."""
    return compile_grammar(text(name), KINDS[name])
