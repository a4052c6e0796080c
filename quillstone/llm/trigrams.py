"""Boolean trigram queries derived from regular expressions.

A query is a set of conjunctions, each a set of trigrams; a text may hold a match only if it holds all trigrams of some conjunction.
``ALL``, the one empty conjunction, says nothing: any text may match. Trigrams are of ASCII characters in lower case, to
be looked up in texts in lower case. Python's own parser gives the expression's tree; whatever a step can't bound becomes ALL, so a query may
let too many texts pass but never too few. Defined results: an expression without three fixed characters in a row
is ALL; an invalid one raises re.error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

Query = frozenset[frozenset[str]]
ALL: Query = frozenset({frozenset()})
#: Strings of a set, characters of a class and conjunctions of a query that are told apart at most.
MOST = 64
CLASS = 16


def least(found: set[frozenset[str]]) -> Query:
    """Without conjunctions that another one implies; ALL if too many are left."""
    kept = frozenset(c for c in found if not any(other < c for other in found))
    return kept if len(kept) <= MOST else ALL


def both(p: Query, q: Query) -> Query:
    if len(p) * len(q) > MOST:
        return min(p - ALL or ALL, q - ALL or ALL, key=lambda x: (x == ALL, len(x)))
    return least({a | b for a, b in product(p, q)})


def held_by(strings: frozenset[str]) -> Query:
    """What a text with one of these strings holds."""
    return least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


@dataclass(frozen=True)
class Part:
    """What is known of the matches of a part of an expression: all of them, if they are few; else how they begin and end; and a
    query for what is inside."""

    exact: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    inside: Query = ALL

    @classmethod
    def of(cls, strings: set[str]) -> Part:
        known = frozenset(strings)
        return cls(known, known, known, held_by(known))

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return Part.of({a + b for a, b in product(self.exact, other.exact)})
        inside = both(self.inside, other.inside)
        if len(self.ends) * len(other.begins) <= MOST:
            inside = both(inside, held_by(frozenset(a + b for a, b in product(self.ends, other.begins))))
        begins, ends = self.begins, other.ends
        if self.exact is not None and len(self.exact) * len(other.begins) <= MOST:
            begins = frozenset(a + b for a, b in product(self.exact, other.begins))
        if other.exact is not None and len(self.ends) * len(other.exact) <= MOST:
            ends = frozenset(a + b for a, b in product(self.ends, other.exact))
        return Part(None, begins, ends, inside)

    def either(self, other: Part) -> Part:
        exact = None if self.exact is None or other.exact is None else self.exact | other.exact
        begins, ends = self.begins | other.begins, self.ends | other.ends
        if len(begins) > MOST or len(ends) > MOST:
            return ANY
        return Part(exact, begins, ends, least(self.inside | other.inside))


EMPTY = Part.of({""})
ANY = Part(None, frozenset({""}), frozenset({""}))


def one_of(codes: list[int]) -> Part:
    """A character of a class; only ASCII has one lower case on all sides."""
    if len(codes) > 8 * CLASS or any(c >= 128 for c in codes):
        return ANY
    folded = {chr(c).lower() for c in codes}
    return Part.of(folded) if len(folded) <= CLASS else ANY


def members(items: list[tuple]) -> list[int] | None:
    """The characters of a class; None if it is negated or has categories."""
    out: list[int] = []
    for kind, value in items:
        if kind is C.LITERAL:
            out.append(value)
        elif kind is C.RANGE and value[1] - value[0] < 8 * CLASS:
            out += range(value[0], value[1] + 1)
        else:
            return None
    return out


def part(nodes: list[tuple]) -> Part:
    done = EMPTY
    for kind, value in nodes:
        if kind is C.LITERAL:
            found = one_of([value])
        elif kind is C.IN:
            found = one_of(codes) if (codes := members(value)) is not None else ANY
        elif kind is C.SUBPATTERN:
            # with flags of its own a group may match what its characters do not say
            found = ANY if value[1] or value[2] else part(value[3])
        elif kind is C.BRANCH:
            found = part(value[1][0])
            for way in value[1][1:]:
                found = found.either(part(way))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            fewest, most, inner = value
            one = part(inner)
            found = EMPTY
            for _ in range(min(fewest, 4)):
                found = found.then(one)
            if fewest == 0 and most == 1:
                found = EMPTY.either(one)
            elif most > min(fewest, 4):
                found = found.then(ANY)
                if 0 < fewest:
                    found = Part(None, found.begins, one.ends, found.inside)
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            found = EMPTY
        elif kind is C.ATOMIC_GROUP:
            found = part(value)
        else:
            found = ANY
        done = done.then(found)
    return done


def query_of(pattern: str) -> Query:
    """The trigram query of an expression without flags."""
    tree = _parser.parse(pattern)
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE | re.LOCALE):
        return ALL
    return part(list(tree)).inside
