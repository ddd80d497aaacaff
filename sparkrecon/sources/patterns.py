"""Regular expressions of the dump grammar, assembled from a few rules.

What is left of a text is written ``(?s:.*)``, which the JVM skips to its end; a class of
all signs is looked up sign by sign. Every repetition of a group is possessive: the JVM then matches it in a loop
instead of recursing per repetition, so literals and tuples may be of any size.
"""

from __future__ import annotations

from sparkrecon.options import IngestOptions

# Tuples that nest no deeper are read by patterns, other ones by tokens.
NESTING = 16

# What a statement, its target and its column list look like, and
# what a tuple is in a document.
STATEMENT = r"(?iU)(INSERT\s+INTO[\s\S][^;]*+;)"
TARGET = r"(?iU)INSERT\s+INTO\s+(?:(\w+)\.)?(\w+)"
COLUMN_LIST = r"(?iU)INSERT\s+INTO\s+[\w\.]+\s*\(([^)]+)\)"
DOCX_TUPLE = r"\(([^)]+)\)"

# A statement whose semicolon the reader has taken off.
OPEN_STATEMENT = r"(?isU)(INSERT\s+INTO.++)"
# The values, with the semicolon, start after the target and its column list ...
VALUES = r"(?isU)^INSERT\s+INTO\s+[\w\.]+\s*(?:\([^)]+\))?.*?\bVALUES\s*(.*+)"
# ... or, in the historic reading, at the first such word of the statement.
FIRST_VALUES = r"(?isU)VALUES\s*(.*+)"

# A text that holds more than blanks, for sure.
PRINTED = r"[!-~]"

QUOTES = {"single": "'", "double": '"', "any": "'\""}

# Historic: any quote ends a literal that any quote began.
ANY_QUOTE = r"""(?<=\\)['"]|['"](?:[^'"]++|(?<=\\)['"])*+['"]"""

DOCX_ITEM = r"\G,((?:[^',]++|(?<=\\)'|'(?:[^']++|(?<=\\)')*+(?:'|\z))*+)"

# Historic items: a literal, or text that reaches up to a comma or the end.
HISTORIC_ITEM = (
    r"'[^']*+(?:''[^']*+)*+(?:'|\z)"
    r'|"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
    r"""|[^,'"]++(?=,|\z)"""
)


def literals(options: IngestOptions) -> dict[str, str]:
    """A literal by the kind of quotes around it; a doubled quote stands for itself."""
    if not options.mixed_quotes:
        return {"any": ANY_QUOTE}
    if options.backslash_escapes:
        return {
            "single": r"'[^'\\]*+(?:(?:''|\\[\s\S])[^'\\]*+)*+'",
            "double": r'"[^"\\]*+(?:(?:""|\\[\s\S])[^"\\]*+)*+"',
        }
    return {"single": r"'[^']*+(?:''[^']*+)*+'", "double": r'"[^"]*+(?:""[^"]*+)*+"'}


def literal_pattern(options: IngestOptions) -> str:
    return "|".join(literals(options).values())


def _tuple(literal: str, depth: int) -> str:
    nested = r"(?!)"
    for _ in range(depth):
        nested = rf"""\((?:[^()'"]++|{literal}|{nested})*+\)"""
    return nested


def statement_pattern(options: IngestOptions) -> str:
    """Group 1 is empty where a statement is still open at the end of the text."""
    if not options.quote_aware:
        return STATEMENT
    body = rf"""INSERT\s+INTO(?:[^;'"]++|{literal_pattern(options)}|['"])++"""
    return rf"(?iU)({body};)|{body}\z"


def tuple_pattern(options: IngestOptions) -> str:
    """Group 1 is a tuple, or empty for a literal outside of tuples."""
    literal = literal_pattern(options)
    return rf"{literal}|({_tuple(literal, NESTING)})"


def plain_pattern(options: IngestOptions) -> str:
    """Values that the patterns read to their end: every literal and every parenthesis
    is closed, and none is nested too deep."""
    literal = literal_pattern(options)
    return rf"""\A(?:[^()'"]++|{literal}|{_tuple(literal, NESTING)})*+\z"""


def token_pattern(options: IngestOptions, commas: bool) -> str:
    """Literals, parentheses, commas on request, and what is between them. A literal
    that is never closed takes the rest."""
    cut = "," if commas else ""
    return rf"""{literal_pattern(options)}|[(){cut}]|[^(){cut}'"]++|['"](?s:.*)"""


def item_pattern(options: IngestOptions) -> str:
    """One item of a tuple whose text starts with an added comma."""
    literal = literal_pattern(options)
    nested = _tuple(literal, NESTING - 1)
    return rf"""\G,((?:[^,()'"]++|{literal}|{nested})*+)"""


def closing_patterns(options: IngestOptions) -> dict[str, str]:
    """From inside a literal of each kind, up to its end; group 1 is what follows."""
    if not options.mixed_quotes:
        return {"any": r"""\A(?:[^'"]++|(?<=\\)['"])*+['"]((?s:.*))"""}
    found = {}
    for kind in ("single", "double"):
        quote = QUOTES[kind]
        if options.backslash_escapes:
            body = rf"[^{quote}\\]++|{quote}{quote}|\\(?:[\s\S]|\z)"
        else:
            body = rf"[^{quote}]++|{quote}{quote}"
        found[kind] = rf"\A(?:{body})*+{quote}((?s:.*))"
    return found


def closed_prefix(options: IngestOptions, without: str = "") -> str:
    """Text and closed literals from the start; group 1 is what follows. Quotes of the
    kind ``without`` are signs like any other."""
    held = {kind: p for kind, p in literals(options).items() if kind != without}
    signs = "".join(QUOTES[kind] for kind in held)
    return rf"\A(?:[^{signs}]++|{'|'.join(held.values())})*+((?s:.*))"
