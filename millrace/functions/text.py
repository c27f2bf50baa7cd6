"""Text primitives shared by all operators: one white-space class, portable patterns, tokens.

Patterns are written once in the form that RE2 accepts. ``java`` turns a pattern into its Java equivalent: ASCII word boundaries and a ``$`` that
only matches at the very end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters that ECMAScript's \s covers, as the inside of a character class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = f"[{WS}]+"
EDGES = f"^[{WS}]+|[{WS}]+$"
TERMINAL = r"""[.!?]["')\]]?$"""
_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Letters come in pieces of four, digits in pieces of three, anything else one by one: an additive stand-in for a BPE.
TOKEN = rf"[A-Za-z]{{1,4}}|[0-9]{{1,3}}|[^A-Za-z0-9{WS}]"


def java(pattern: str) -> str:
    """The Java form of an RE2 pattern."""
    out = pattern.replace(r"\b", _BOUNDARY)
    return out.replace(r"\$", "\0").replace("$", r"\z").replace("\0", r"\$")


def lit(pattern: str) -> str:
    """A raw SQL literal of a pattern's Java form, for both quote kinds."""
    return 'r"' + java(pattern).replace('"', r"\x22") + '"'


def duck(pattern: str) -> str:
    """A DuckDB literal of a pattern."""
    return "'" + pattern.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    """The Python form of an RE2 pattern, to be compiled with re.ASCII."""
    said = {"$": r"\Z", ".": r"[^\n\r\x85\u2028\u2029]"}  # what Java's dot leaves out
    inside, out = False, []
    for part in re.findall(r"\\x\{[0-9A-Fa-f]+\}|\\.|.", pattern, re.S):
        if part.startswith(r"\x{"):
            part = re.escape(chr(int(part[3:-1], 16)))
        elif part in ("[", "]"):
            inside = part == "["
        elif not inside:
            part = said.get(part, part)
        out.append(part)
    return "".join(out)


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``, also inside lambdas.

    A projected column would not do: the optimizer inlines one that is named once, even where a lambda evaluates it for every element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def exploded(df: DataFrame, keep: list, array: Column | str, at: str, item: str) -> DataFrame:
    """``keep``, and the place and value of each element of an array. An inner explode would do, but the filter that Spark infers for it evaluates the array twice more."""
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())


def has(x: str, pattern: str) -> str:
    return f"({x} rlike {lit(pattern)})"


def any_of(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(has(x, p) for p in patterns) + ")"


def duck_has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {duck(pattern)})"


def duck_any(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(duck_has(x, p) for p in patterns) + ")"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {lit(EDGES)}, '')"


def duck_trimmed(x: str) -> str:
    return f"regexp_replace({x}, {duck(EDGES)}, '', 'g')"


def n_words(x: str) -> str:
    """Words of a trimmed, non-empty text: 1 + its white-space runs, as splitting on them gives."""
    return f"(1 + regexp_count({x}, {lit(SPACES)}))"


def duck_words(x: str) -> str:
    return f"(1 + len(regexp_extract_all({x}, {duck(SPACES)})))"


def count_tokens(x: str) -> str:
    return f"regexp_count({x}, {lit(TOKEN)})"


def duck_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {duck(TOKEN)}))"


def tokens(text: Column) -> Column:
    """Token count of a text; 0 for null and empty."""
    return F.coalesce(F.regexp_count(text, F.lit(java(TOKEN))), F.lit(0)).cast("int")


def truncated(text: Column, most: int) -> Column:
    """The text up to the end of its token number ``most``; unchanged if it has no more."""
    head = rf"(?s)\A(?:[{WS}]*(?:{java(TOKEN)})){{0,{most}}}"
    return F.when(tokens(text) > most, F.regexp_extract(text, head, 0)).otherwise(text)
