"""Grammars of tolerant parsers: reading, analysis, checks and parse tables, on the driver."""

from .model import Alternative, Entry, Grammar, GrammarError, Message, Options, Pair, Rule, Terminal

__all__ = ["Alternative", "Entry", "Grammar", "GrammarError", "Message", "Options", "Pair", "Rule", "Terminal"]
