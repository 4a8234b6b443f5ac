"""Boolean trigram queries of regular expressions.

A text that a pattern matches must hold certain trigrams: for each node of the pattern we track the strings it can match
when these are few, else what its matches begin and end with, and the trigrams that any match must hold. Queries are
trees of ("any",), ("tri", t), ("and", parts) and ("or", parts) over lower-cased trigrams, so they are a superset for
patterns in either case.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from dataclasses import dataclass

ANY = ("any",)
#: Sets of strings larger than this are given up for the trigrams that they share.
MOST = 40


def both(*parts):
    """All parts hold."""
    flat = [q for p in parts for q in (p[1] if p[0] == "and" else (p,)) if q != ANY]
    flat = list(dict.fromkeys(flat))
    return ANY if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def either(*parts):
    """One part holds."""
    flat = list(dict.fromkeys(q for p in parts for q in (p[1] if p[0] == "or" else (p,))))
    needs = [frozenset(q[1] if q[0] == "and" else (q,)) for q in flat]
    flat = [q for q, n in zip(flat, needs, strict=True) if not any(m < n for m in needs)]  # a part that needs more tells nothing
    return ANY if ANY in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_strings(strings):
    """A text holds one of the strings: all trigrams of it."""
    return either(*(both(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass(frozen=True)
class Found:
    exact: frozenset | None
    begins: frozenset
    ends: frozenset
    must: tuple

    @classmethod
    def only(cls, strings):
        strings = frozenset(strings)
        return cls(strings, strings, strings, ANY)

    def loose(self):
        """Without exact strings: what they tell is kept in must, begins and ends."""
        if self.exact is None:
            return self
        return Found(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), both(self.must, of_strings(self.exact)))


OPEN = Found(None, frozenset({""}), frozenset({""}), ANY)


def joined(x: Found, y: Found) -> Found:
    cross = lambda a, b: frozenset(s + t for s in a for t in b)
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return Found(*[cross(x.exact, y.exact)] * 3, both(x.must, y.must))
    over = of_strings(cross(x.ends, y.begins)) if len(x.ends) * len(y.begins) <= MOST * MOST else ANY
    a, b = x.loose(), y.loose()
    begins = frozenset(s[:2] for s in cross(x.exact, b.begins)) if x.exact is not None else a.begins
    ends = frozenset(s[-2:] for s in cross(a.ends, y.exact)) if y.exact is not None else b.ends
    return Found(None, begins, ends, both(a.must, over, b.must))


def other(x: Found, y: Found) -> Found:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST:
        return Found(*[x.exact | y.exact] * 3, either(both(x.must), both(y.must)) if ANY not in (x.must, y.must) else ANY)
    a, b = x.loose(), y.loose()
    return Found(None, a.begins | b.begins, a.ends | b.ends, either(a.must, b.must))


def characters(items) -> frozenset | None:
    """The lower-cased characters of a class, or None if there are many."""
    found = set()
    for op, value in items:
        if op is kind.LITERAL:
            found.add(chr(value).lower())
        elif op is kind.RANGE and value[1] - value[0] < 6:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 6 else None


def walk(nodes) -> Found:
    total = Found.only({""})
    for op, value in nodes:
        if op is kind.LITERAL:
            one = Found.only({chr(value).lower()})
        elif op is kind.IN:
            one = Found.only(c) if (c := characters(value)) else OPEN
        elif op is kind.BRANCH:
            one = walk(value[1][0])
            for branch in value[1][1:]:
                one = other(one, walk(branch))
        elif op is kind.SUBPATTERN:
            one = walk(value[3])
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            least, most, inner = value
            part = walk(inner)
            if least == 0:
                one = other(Found.only({""}), part) if most == 1 else OPEN
            else:
                one = Found.only({""})
                for _ in range(min(least, 3)):
                    one = joined(one, part)
                one = one if most == least <= 3 else one.loose()
        elif op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
            one = Found.only({""})
        else:
            one = OPEN
        total = joined(total, one)
    return total


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern; ("any",) if it has no mandatory trigram."""
    return walk(parser.parse(pattern)).loose().must


def trigrams(query) -> set[str]:
    """The trigrams that a query names."""
    if query[0] == "tri":
        return {query[1]}
    return set().union(*map(trigrams, query[1])) if len(query) > 1 else set()
