"""Column helpers that carry Python's text rules (Unicode classes, strip, indent) to the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in a Python str.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_WORD = r"[\p{L}\p{N}_]"

# Indent given to blank lines: they never end a block.
BLANK_INDENT = 2147483647
_ALL = 2147483647


def jre(pattern: str, *, dotall: bool = False, ignore_case: bool = False) -> str:
    """A Python pattern in Java's dialect: Unicode classes, and '.' that stops at newline only."""
    any_char = r"[\s\S]" if dotall else r"[^\n]"
    pattern = re.sub(r"(?<!\\)\.(?=[*+])", lambda _: any_char.replace(r"\s\S", "\0"), pattern)
    pattern = pattern.replace(r"\w", _WORD).replace(r"\s", _SPACE).replace("\0", r"\s\S")
    return ("(?iu)" if ignore_case else "") + pattern


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def py_lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def has(text: Column, literal: str) -> Column:
    return F.contains(text, F.lit(literal))


def matches(text: Column, pattern: Column) -> Column:
    """Whether a pattern from a column is found. Unlike ``rlike``, which compiles such a pattern for every row,
    this keeps the last one."""
    return F.regexp_instr(text, pattern) > 0


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(text, F.lit(re.escape(literal))).cast("long")


def odd_case(text: Column) -> Column:
    """True for texts with one of the few letters whose case folds to ASCII outside lower()."""
    return has(text, "ſ") | has(text, "ı") | has(text, "İ")


def count_ignoring_case(text: Column, low: Column, odd: Column, pattern: str) -> Column:
    """Matches of a pattern in any case. ``low`` is the lower-cased text: searching it with the
    lower-cased pattern is many times faster than a search that ignores case."""
    folded = F.regexp_count(low, F.lit(jre(pattern.lower().replace(r"\g", r"\G"))))
    return F.when(odd, F.regexp_count(text, F.lit(jre(pattern, ignore_case=True)))).otherwise(folded)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(condition: Column, row: Column) -> Column:
    """A generator that yields ``row`` where the condition holds. A filter over computed columns
    would be pushed below their projection and compute them a second time."""
    return F.inline(F.array_compact(F.array(F.when(condition, row))))


def split_lines(code: Column) -> Column:
    return F.split(code, "\n", -1)


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(py_lstrip(line))


def block_indents(lines: Column) -> Column:
    """Indent of every line, BLANK_INDENT for blank ones."""

    def one(line: Column) -> Column:
        return let(
            F.length(py_lstrip(line)),
            lambda rest: F.when(rest == 0, F.lit(BLANK_INDENT)).otherwise(F.length(line) - rest),
        )

    return F.transform(lines, one)


def _first_position(flags: Column) -> Column:
    position = F.array_position(flags, F.lit(True))
    return F.when(position > 0, position - 1)


def first_index(items: Column, test: Callable[[Column], Column]) -> Column:
    """0-based index of the first item that passes, null when none does."""
    return _first_position(F.transform(items, test))


def block_end(indents: Column, start: Column) -> Column:
    """Last line of the block opened at ``start``: the line before the next non-blank line that
    is not indented deeper, or the last line of the file.

    The search widens step by step, so its cost follows the length of the block and not the
    length of the file; a file full of short blocks stays linear.
    """
    base = F.get(indents, start)

    def look(skip: int, width: int) -> Column:
        window = F.slice(indents, (start + 2 + skip).cast("int"), width)
        return start + skip + first_index(window, lambda depth: depth <= base)

    steps, skip = [], 0
    for width in (16, 512, 16384, 524288, _ALL):
        steps.append(look(skip, width))
        skip += width if width != _ALL else 0
    return F.coalesce(*steps, F.size(indents) - 1).cast("int")
