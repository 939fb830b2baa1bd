"""Second extractors, independent of the grammars: plain patterns over texts without comments and literals.

They are what tolerant extraction is compared with (see ``compare.difference``); all is done by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C_LIKE = r'//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"
_PASCAL = r"//[^\n]*|\{[^}]*\}|'[^'\n]*'"
_FLAGS = r"(?:public|private|protected|internal|static|final|abstract|virtual|override|readonly|async|const|sealed|partial)"
_TYPE = r"[A-Za-z_][A-Za-z_0-9.]*(?:<[^<>;{}()]*>)?(?:\[\])*"
_NOT_TYPES = ("return", "new", "else", "throw", "in", "case", "package", "import", "using", "class", "interface", "struct", "enum", "namespace", "delegate", "operator")

#: language -> (what is no code, {entity type: pattern whose first group is the name}).
PATTERNS: dict[str, tuple[str, dict[str, str]]] = {
    "java": (_C_LIKE, {
        "class": r"\bclass\s+([A-Za-z_][A-Za-z_0-9]*)", "interface": r"(?<!@)\binterface\s+([A-Za-z_][A-Za-z_0-9]*)", "enum": r"\benum\s+([A-Za-z_][A-Za-z_0-9]*)",
        "method": rf"\b(?!(?:{'|'.join(_NOT_TYPES)})\b){_TYPE}\s+([A-Za-z_][A-Za-z_0-9]*)\s*\([^()]*\)\s*(?:throws [^;{{]*)?[;{{]",
        "field": rf"(?:^|[;{{}}])\s*(?:{_FLAGS}\s+)*(?!(?:{'|'.join((*_NOT_TYPES, *_FLAGS[3:-1].split('|')))})\b){_TYPE}\s+([A-Za-z_][A-Za-z_0-9]*)\s*[;=,]",
    }),
    "csharp": (_C_LIKE, {
        **{k: rf"\b{k}\s+([A-Za-z_][A-Za-z_0-9]*)" for k in ("class", "struct", "interface")}, "enum": r"\benum\s+([A-Za-z_][A-Za-z_0-9]*)",
        "method": rf"\b(?!(?:{'|'.join(_NOT_TYPES)})\b){_TYPE}\s+([A-Za-z_][A-Za-z_0-9]*)\s*\([^()]*\)\s*(?:where [^;{{]*)?(?:[;{{]|=>)",
        "property": rf"\b(?!(?:{'|'.join(_NOT_TYPES)})\b){_TYPE}\s+([A-Za-z_][A-Za-z_0-9]*)\s*(?:\{{\s*(?:{_FLAGS}\s+)?(?:get|set)\b|=>)",
        "field": rf"(?:^|[;{{}}])\s*(?:{_FLAGS}\s+)*(?!(?:{'|'.join((*_NOT_TYPES, *_FLAGS[3:-1].split('|')))})\b){_TYPE}\s+([A-Za-z_][A-Za-z_0-9]*)\s*(?:[;,]|=(?!>))",
    }),
    "pascal": (_PASCAL, {
        "routine": r"(?i)\b(?:procedure|function|constructor|destructor)\s+([A-Za-z_][A-Za-z_0-9.]*)", "property": r"(?i)\bproperty\s+([A-Za-z_][A-Za-z_0-9]*)", "class": r"(?i)\b([A-Za-z_][A-Za-z_0-9]*)\s*=\s*class\b",
    }),
}


def bare(text: Column, language: str) -> Column:
    """Code without comments and literals."""
    return F.regexp_replace(text, PATTERNS[language][0], " ")


def baseline(docs: DataFrame, language: str) -> DataFrame:
    """(doc_id, type, value) of the entities that plain patterns find."""
    code = docs.select("doc_id", bare(F.col("text"), language).alias("code"))

    def matches(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    found = [matches(*p) for p in PATTERNS[language][1].items()]
    return code.select("doc_id", F.explode(F.concat(*found)).alias("e")).select("doc_id", "e.type", "e.value")
