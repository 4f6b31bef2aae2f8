"""Boolean trigram queries derived from regular expressions.

A query says which three-character strings a text must hold if the expression matches anywhere in
it: a trigram, ``("and", parts)``, ``("or", parts)``, or ``True`` where nothing is mandatory. It is a
necessary condition only; what it lets through has to be verified with the expression itself.

For every part of the expression four facts are kept: the strings it can match, while they are few;
the strings its matches can begin and end with; and a query. Joining two parts adds the trigrams that
span the border between them. All is folded to lower case, as the index is. Trigrams with white space
or characters beyond ASCII are taken to be present, which only weakens a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as kinds
from re import _parser as parser

FEW = 64  # strings kept per part of an expression before they are turned into a query
CLASS = 8  # characters of a class that are told apart
EMPTY = frozenset({""})


@dataclass(frozen=True)
class Facts:
    exact: frozenset | None  # all strings that can match, if few
    prefixes: frozenset  # every match begins with one of these
    suffixes: frozenset
    query: object = True


UNKNOWN = Facts(None, EMPTY, EMPTY)


def all_of(*parts):
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def any_of(parts):
    flat = []
    for p in parts:
        if p is True:
            return True
        flat += p[1] if isinstance(p, tuple) and p[0] == "or" else [p]
    flat = list(dict.fromkeys(flat))
    needs = [frozenset(p[1]) if isinstance(p, tuple) else frozenset({p}) for p in flat]
    # what needs more than another option adds nothing
    flat = [p for p, n in zip(flat, needs) if not any(m < n for m in needs)]
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_string(text: str):
    grams = [text[i : i + 3] for i in range(len(text) - 2)]
    return all_of(*[g for g in grams if g.isascii() and not re.search(r"\s", g)])


def of_strings(texts: frozenset):
    return any_of([of_string(t) for t in sorted(texts)]) if texts else True


def _exactly(texts) -> Facts:
    texts = frozenset(texts)
    return Facts(texts, texts, texts) if len(texts) <= FEW else _loose(texts)


def _loose(texts: frozenset) -> Facts:
    """The facts on a set of strings that is too large to be carried on."""
    return Facts(None, _short({t[:2] for t in texts}), _short({t[-2:] for t in texts}), of_strings(texts))


def _short(texts) -> frozenset:
    return frozenset(texts) if len(texts) <= FEW else EMPTY


def _loosened(f: Facts) -> Facts:
    return f if f.exact is None else _loose(f.exact)


def _join(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= FEW:
        return _exactly(x + y for x, y in product(a.exact, b.exact))
    left, right = a.exact or a.suffixes, b.exact or b.prefixes
    border = True
    if len(left) * len(right) <= FEW * FEW:
        border = of_strings(frozenset(x + y for x, y in product(left, right)))
    loose_a, loose_b = _loosened(a), _loosened(b)
    first, last = loose_a.prefixes, loose_b.suffixes
    if a.exact is not None and len(a.exact) * len(loose_b.prefixes) <= FEW:
        first = _short({(x + y)[:2] for x, y in product(a.exact, loose_b.prefixes)})
    if b.exact is not None and len(b.exact) * len(loose_a.suffixes) <= FEW:
        last = _short({(x + y)[-2:] for x, y in product(loose_a.suffixes, b.exact)})
    return Facts(None, first, last, all_of(loose_a.query, border, loose_b.query))


def _either(options: list[Facts]) -> Facts:
    if all(f.exact is not None for f in options):
        return _exactly(frozenset().union(*[f.exact for f in options]))
    loose = [_loosened(f) for f in options]
    return Facts(
        None, _short(frozenset().union(*[f.prefixes for f in loose])),
        _short(frozenset().union(*[f.suffixes for f in loose])), any_of([f.query for f in loose]),
    )


def _characters(items) -> Facts:
    found = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            found.add(chr(value).lower())
        elif kind is kinds.RANGE and value[1] - value[0] < 2 * CLASS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return UNKNOWN
        if len(found) > CLASS:
            return UNKNOWN
    return _exactly(found)


def _repeated(least: int, most, body: Facts) -> Facts:
    if least == 0:
        return _either([_exactly({""}), body]) if most == 1 and body.exact is not None else UNKNOWN
    if least == most and least <= 16:
        return reduce(_join, [body] * least)
    first = reduce(_join, [body] * min(least, 4))
    loose = _loosened(first)
    return Facts(None, loose.prefixes, loose.suffixes, loose.query)


def _facts(node) -> Facts:
    kind, value = node
    if kind is kinds.LITERAL:
        return _exactly({chr(value).lower()})
    if kind is kinds.IN:
        return _characters(value)
    if kind is kinds.SUBPATTERN:
        return _sequence(value[-1])
    if kind is kinds.ATOMIC_GROUP:
        return _sequence(value)
    if kind is kinds.BRANCH:
        return _either([_sequence(option) for option in value[1]])
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        return _repeated(value[0], value[1], _sequence(value[2]))
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return _exactly({""})
    return UNKNOWN


def _sequence(nodes) -> Facts:
    return reduce(_join, [_facts(n) for n in nodes], _exactly({""}))


def trigram_query(pattern: str):
    """The query of a regular expression, whatever the case of its letters."""
    return _loosened(_sequence(parser.parse(pattern))).query


def grams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[grams_of(p) for p in query[1]])


def holds(query, grams: set[str]) -> bool:
    """Whether a text with these trigrams passes the query."""
    if query is True or isinstance(query, str):
        return query is True or query in grams
    return (all if query[0] == "and" else any)(holds(p, grams) for p in query[1])
