"""Patterns and replacements that users write in Python's ``re`` dialect, for Java's engine.

What cannot be carried over exactly is refused with an error that names it.
"""

from __future__ import annotations

import re

from corpusaudit.functions.text import WHITESPACE

WORD = r"\p{L}\p{N}_"
SPACE = "".join(rf"\x{{{ord(c):x}}}" for c in WHITESPACE)
DIGIT = r"\p{Nd}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# not a place in an empty text, as in Python up to 3.13
INSIDE = rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}])(?!\A\z))"
SETS = {"w": WORD, "s": SPACE, "d": DIGIT}
CONTROLS = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "a": 7}
GROUPS = re.compile(r"\(\?(?:[:=!>]|<[=!])")
REPEAT = re.compile(r"\{(?!\})(\d*)(?:(,)(\d*))?\}")
HEX = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))")


def _refuse(pattern: str, what: str) -> ValueError:
    return ValueError(f"pattern {pattern!r}: {what} cannot be carried over")


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and (c.isalnum() or c == "_") else rf"\x{{{code:x}}}"


def _escaped_char(pattern: str, at: int, in_set: bool) -> tuple[int, int]:
    """Code point of the escape at ``at`` and the position after it."""
    c = pattern[at + 1]
    found = HEX.match(pattern, at)
    if found:
        return int(found[1] or found[2] or found[3], 16), found.end()
    if c in CONTROLS:
        return CONTROLS[c], at + 2
    if c == "b" and in_set:
        return 8, at + 2
    if c.isalnum() and c.isascii():
        raise _refuse(pattern, rf"\{c}")
    return ord(c), at + 2


def _set(pattern: str, at: int) -> tuple[str, int]:
    """The character set that begins at ``at``, and the position after it."""
    at += 1
    negated = pattern.startswith("^", at)
    at += negated
    begin, plain, without = at, "", []

    def one(at: int) -> tuple[int, int]:
        if pattern[at] == "\\":
            return _escaped_char(pattern, at, True)
        return ord(pattern[at]), at + 1

    while pattern[at] != "]" or at == begin:
        c = pattern[at : at + 2]
        if c[0] == "\\" and c[1].lower() in SETS:
            if c[1].islower():
                plain += SETS[c[1]]
            else:
                without.append(SETS[c[1].lower()])
            at += 2
            continue
        low, at = one(at)
        plain += _char(low)
        if pattern[at] == "-" and pattern[at + 1] != "]":
            high, at = one(at + 1)
            plain += "-" + _char(high)
    if not negated:
        return "[" + plain + "".join(f"[^{s}]" for s in without) + "]", at + 1
    parts = [f"[{s}]" for s in without] + ([f"[^{plain}]"] if plain else [])
    return parts[0] if len(parts) == 1 else "[" + "&&".join(parts) + "]", at + 1


def java_pattern(pattern: str) -> str:
    """Finds in Java what ``pattern`` finds in Python. Global flags ``i`` and ``s`` are taken."""
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise ValueError(f"pattern {pattern!r}: {e}") from e
    # only \n ends a line, as in Python
    out, at = "(?d)", 0
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags:
        if set(flags[1]) - set("isu"):
            raise _refuse(pattern, flags[0])
        at = flags.end()
        out += ("(?iu)" if "i" in flags[1] else "") + ("(?s)" if "s" in flags[1] else "")
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            found, at = _set(pattern, at)
            out += found
        elif c == "\\":
            n = pattern[at + 1]
            reference = re.compile(r"\\([1-9]\d?)(?!\d)").match(pattern, at)
            if n.lower() in SETS:
                out += f"[{'' if n.islower() else '^'}{SETS[n.lower()]}]"
                at += 2
            elif n in "bBAZ":
                out += {"b": BOUNDARY, "B": INSIDE, "A": r"\A", "Z": r"\z"}[n]
                at += 2
            elif reference:
                out += rf"(?:\{reference[1]})"
                at = reference.end()
            else:
                code, at = _escaped_char(pattern, at, False)
                out += _char(code)
        elif pattern.startswith("(?", at):
            group = GROUPS.match(pattern, at)
            named = re.compile(r"\(\?P<(\w+)>").match(pattern, at)
            again = re.compile(r"\(\?P=(\w+)\)").match(pattern, at)
            if group:
                out, at = out + group[0], group.end()
            elif named:
                out, at = out + "(", named.end()
            elif again:
                out, at = out + rf"(?:\{compiled.groupindex[again[1]]})", again.end()
            else:
                raise _refuse(pattern, pattern[at : at + 4])
        elif c == "{":
            repeat = REPEAT.match(pattern, at)
            if repeat:
                out += "{" + (repeat[1] or "0") + (repeat[2] or "") + (repeat[3] or "") + "}"
                at = repeat.end()
            else:
                out, at = out + r"\{", at + 1
        elif c in "()|*+?.^$":
            out, at = out + c, at + 1
        else:
            out, at = out + _char(ord(c)), at + 1
    return out


def java_replacement(replacement: str, pattern: str) -> str:
    """The replacement template of Python's ``sub`` in Java's form."""
    compiled = re.compile(pattern)
    out, at, after_group = "", 0, False
    token = re.compile(r"\\(?:g<(\w+)>|([1-9]\d?)|(.))", re.DOTALL)
    while at < len(replacement):
        found = token.match(replacement, at)
        name = found and (found[1] or found[2])
        if name:
            number = int(name) if name.isdecimal() else compiled.groupindex.get(name, -1)
            if not 0 <= number <= compiled.groups or (found[2] and re.match(r"\d", replacement[found.end() :])):
                raise ValueError(f"replacement {replacement!r}: no group {name} in {pattern!r}")
            out, at, after_group = out + f"${number}", found.end(), True
            continue
        if found:
            c, at = found[3], found.end()
            if c in CONTROLS:
                c = chr(CONTROLS[c])
            elif c.isascii() and c.isalnum():
                raise ValueError(f"replacement {replacement!r}: \\{c} cannot be carried over")
            elif c != "\\":
                c = "\\" + c  # Python keeps the backslash of an unknown escape
        else:
            c, at = replacement[at], at + 1
        for x in c:
            out += "\\" + x if x in "\\$" or (after_group and x.isdigit()) else x
        after_group = False
    return out
