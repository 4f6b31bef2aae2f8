"""Literal texts that a match of a Python pattern has to hold.

``required_literals`` returns alternatives: whatever matches holds at least one of them, in any case
of its letters. An empty list means that nothing is required. Folding is that of ``folded``: lower
case, and the three letters that a search ignoring case also takes for ASCII ones.
"""

from __future__ import annotations

from collections.abc import Iterable
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusaudit.functions.text import odd_case

MOST = 32  # alternatives of a pattern; more of them require nothing
GRAM = 3
# Letters that fold to ASCII beyond lower().
ODD_LETTERS, THEIR_FOLDS = "ſıİ", "sii"


def folded(text: Column) -> Column:
    """``translate`` looks every character up, so only the few texts with such a letter pay for it."""
    return F.lower(F.when(odd_case(text), F.translate(text, ODD_LETTERS, THEIR_FOLDS)).otherwise(text))


def grams_in(text: Column, pattern: str) -> Column:
    """The distinct strings of a folded text that ``pattern``, made by ``grams_pattern``, is for."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def grams_pattern(grams: Iterable[str]) -> str:
    """A pattern that finds each of the three-character strings wherever it begins. They are grouped by their first and
    second characters, so that a place of a text costs little more for thousands of them than for a few."""
    tree: dict[str, dict[str, list[str]]] = {}
    for first, second, third in sorted(grams):
        tree.setdefault(first, {}).setdefault(second, []).append(third)

    def one_of(options: Iterable[str]) -> str:
        return "[" + "".join(f"\\x{ord(c):02x}" for c in options) + "]"

    branches = []
    for first, rest in tree.items():
        same_end: dict[tuple[str, ...], list[str]] = {}
        for second, thirds in rest.items():
            same_end.setdefault(tuple(thirds), []).append(second)
        tails = "|".join(one_of(seconds) + one_of(thirds) for thirds, seconds in same_end.items())
        branches.append(f"{one_of(first)}(?:{tails})")
    return f"(?=({'|'.join(branches)}))" if branches else "(?!)(.)"


def grams_of(literal: str) -> list[str]:
    return sorted({literal[i : i + GRAM] for i in range(len(literal) - GRAM + 1)})


def _strength(options: list[str]) -> tuple[int, int]:
    return min(map(len, options)), -len(options)


def _usable(char: int) -> bool:
    return char < 128


def _options(nodes) -> list[str]:
    """The strongest set of alternatives that the parts of a sequence require."""
    found: list[list[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= GRAM:
            found.append([run])
        run = ""

    def walk(items) -> None:
        nonlocal run
        for kind, value in items:
            if kind is kinds.LITERAL and _usable(value):
                run += chr(value).lower()
            elif kind is kinds.SUBPATTERN:
                walk(value[-1])  # what a group holds follows what stands before it
            elif kind is kinds.ATOMIC_GROUP:
                walk(value)
            elif kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
                continue  # takes no characters
            else:
                close()
                if kind is kinds.BRANCH:
                    branches = [_options(b) for b in value[1]]
                    if all(branches) and sum(map(len, branches)) <= MOST:
                        found.append(sorted({o for b in branches for o in b}))
                elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0]:
                    own = _options(value[2])
                    if own:
                        found.append(own)
        return None

    walk(nodes)
    close()
    return max(found, key=_strength, default=[])


def required_literals(pattern: str) -> list[str]:
    return _options(parser.parse(pattern))
