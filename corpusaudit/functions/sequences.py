"""Parts of code that follow each other, found in one pass over a text.

The whole-text patterns say: a word, something on its line, a colon, more words. Searched as written,
every word is a new start and every colon a new choice, which takes the square or cube of a line.
Here a colon is marked first where the words that must follow it do, by looking ahead; then each line
is read once from its beginning, and each part takes its earliest place, since a part that fits later
fits there too. What may run over the end of a line is marked as well.

Marks are private-use characters; a text's own ones are replaced first by one that no part looks for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusaudit.functions.text import _SPACE, _WORD

COLON, ELSE, OPENED, BROKEN, CLOSED, OTHER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue00f"
S, W = _SPACE, _WORD
BLANK = rf"[{_SPACE}&&[^\n]]"  # white space within a line
LINE = rf"[^\n{BROKEN}]"


def _free(code: Column) -> Column:
    return F.translate(code, COLON + ELSE + OPENED + BROKEN + CLOSED, OTHER * 5)


def _mark(text: Column, pattern: str, mark: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(mark))


def _opened(text: Column, word: str) -> Column:
    """Marks a line if the word and white space lead into it."""
    return _mark(text, rf"({word}{S}*\n)", f"$1{OPENED}")


def _head(word: str) -> str:
    """From the beginning of a line past the first place where the word has been said."""
    return rf"(?:\A|[\n{BROKEN}])(?>{OPENED}|{LINE}*?{word}{BLANK})"


# if\s+.+:\s*return\s+.+\s*else:\s*return, where COLON stands for the first colon with its return, BROKEN
# behind it if they are on different lines, and ELSE for an else with its colon and return.
_VALUE = rf"(?:(?>{LINE}+?{ELSE})|{LINE}++\n[{S}{OPENED}]*+{ELSE})"
_FIRST_COLON = rf"(?>{LINE}+?{COLON}){BROKEN}?+{BLANK}{_VALUE}"
_LAST_COLON = (
    rf"(?>{LINE}+{COLON}){BROKEN}?+(?:{BLANK}{_VALUE}|(?={S}++{ELSE}){S}\n*+{BLANK}"
    rf"|{BLANK}*+\n(?:{BLANK}*+\n)*+{_VALUE})"
)
TERNARY = rf"{_head('if')}(?:{_FIRST_COLON}|{_LAST_COLON})"


def has_ternary(code: Column) -> Column:
    """Whether if\\s+.+:\\s*return\\s+.+\\s*else:\\s*return matches."""
    text = _mark(_free(code), rf":(?={S}*+return{S})", COLON)
    text = _mark(text, rf"else(?=[:{COLON}]{S}*+return)", ELSE)
    text = _mark(text, rf"{COLON}{BLANK}*+\n{S}*+return(?={S})", COLON + BROKEN)
    text = _mark(text, rf"{COLON}{BLANK}*+return(?={S})", COLON)
    return F.rlike(_opened(text, "if"), F.lit(TERNARY))


CONCAT = rf"{_head('for')}{LINE}+?{COLON}"


def has_concat_in_loop(code: Column) -> Column:
    """Whether for\\s+.+:\\s*\\w+\\s*\\+=\\s* matches."""
    text = _mark(_free(code), rf":(?={S}*+{W}++{S}*+\+=)", COLON)
    return F.rlike(_opened(text, "for"), F.lit(CONCAT))


# The words before the rest of the line are on that line, or a line break is between them.
FILTER = (
    rf"(?:\A|\n)(?>[^\n]*?for{BLANK}++{W}++{BLANK}++in)[^\n]*?{COLON}"
    rf"|for(?>{BLANK}*+\n{S}*+{W}++{S}++|{BLANK}++{W}++{BLANK}*+\n{S}*+)in[^\n]*?{COLON}"
)


def has_filter_loop(code: Column) -> Column:
    """Whether for\\s+\\w+\\s+in.*:\\s*if\\s+ matches."""
    return F.rlike(_mark(_free(code), rf":(?={S}*+if{S})", COLON), F.lit(FILTER))


# subprocess\.[^(]*\([^)]*\+ in a text whose parentheses without a plus before they close are marked:
# what begins between two opening ones shares the second, so the first decides.
CALL = rf"(?:\G|(?<=[({CLOSED}]))(?>[^({CLOSED}]*?(?=subprocess\.))(subprocess\.[^({CLOSED}]*+\([^)]*\+)"


def open_calls(text: Column) -> Column:
    """Marks every opening parenthesis that no plus follows before the next closing one. A closing one ends the
    stretch in which that is the same question for all, so each stretch is cut at its last plus."""

    def one(stretch: Column) -> Column:
        good = F.regexp_extract(stretch, r"(?s)\A.*\+", 0)
        rest = F.substring(stretch, F.length(good) + 1, F.length(stretch))
        return F.concat(good, F.translate(rest, "(", CLOSED))

    return F.array_join(F.transform(F.split(text, r"\)", -1), one), ")")


def restored(text: Column) -> Column:
    return F.translate(text, CLOSED, "(")
