"""Boolean trigram queries of regular expressions.

``query_of(regex)`` is a condition on the trigrams (of lower-cased text) that every text with a match satisfies. It is derived from the syntax tree, part by part:
what a part matches exactly as long as these are few strings, else with which strings its matches begin and end, and the condition its matches satisfy. Concatenation
joins the ends of one part with the beginnings of the next, alternation unites, optional parts may be empty, and classes of many characters say nothing.

A query is TRUE, a trigram, or ("and" | "or", queries). Only ASCII letters are folded; a character beyond ASCII counts as any character.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as kinds
from re import _parser as syntax

TRUE = ("and", ())
Query = str | tuple

FEW = 64
CLASS = 8
COPIES = 4


def trigrams(s: str) -> list[str]:
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def both(a: Query, b: Query) -> Query:
    return joined("and", [a, b])


def joined(how: str, parts: list[Query]) -> Query:
    """The conjunction or disjunction without repeats and needless levels."""
    flat: list[Query] = []
    for p in parts:
        if how == "or" and p == TRUE:
            return TRUE
        for x in p[1] if p[0] == how and not isinstance(p, str) else [p]:
            if x not in flat and x != TRUE:
                flat.append(x)
    if how == "or":  # what another alternative implies adds nothing
        sets = [frozenset(x[1]) if isinstance(x, tuple) and x[0] == "and" else frozenset([x]) for x in flat]
        flat = [x for x, s in zip(flat, sets, strict=True) if not any(t < s for t in sets)]
    return flat[0] if len(flat) == 1 else (how, tuple(flat)) if flat else TRUE


def of_strings(strings: frozenset[str]) -> Query:
    """One of these strings occurs."""
    return joined("or", [joined("and", list(trigrams(s))) for s in sorted(strings)])


@dataclass(frozen=True)
class Part:
    """exact: all strings it matches, or None; else begins and ends: one of these stands at either end of every match. match: the condition."""

    exact: frozenset[str] | None
    begins: frozenset[str] = frozenset({""})
    ends: frozenset[str] = frozenset({""})
    match: Query = TRUE

    def heads(self) -> frozenset[str]:
        return self.begins if self.exact is None else self.exact

    def tails(self) -> frozenset[str]:
        return self.ends if self.exact is None else self.exact

    def open(self) -> Part:
        """The same without exact strings; what they say moves to the condition, and two characters at either end are kept."""
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), both(self.match, of_strings(self.exact)))


EMPTY, ANY = Part(frozenset({""})), Part(None)


def cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= FEW else None


def then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and (whole := cross(a.exact, b.exact)) is not None:
        return Part(whole, match=both(a.match, b.match))
    met = cross(a.tails(), b.heads())
    match = both(both(a.open().match, b.open().match), TRUE if met is None else of_strings(met))
    begins = (cross(a.exact, b.heads()) if a.exact is not None else a.begins) or a.open().begins
    ends = (cross(a.tails(), b.exact) if b.exact is not None else b.ends) or b.open().ends
    return Part(None, frozenset(s[:2] for s in begins), frozenset(s[-2:] for s in ends), match)


def either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        union = frozenset().union(*(p.exact for p in parts))
        if len(union) <= FEW:
            return Part(union, match=joined("or", [p.match for p in parts]))
    opened = [p.open() for p in parts]
    return Part(None, frozenset().union(*(p.begins for p in opened)), frozenset().union(*(p.ends for p in opened)), joined("or", [p.match for p in opened]))


def repeated(p: Part, least: int, most: int) -> Part:
    if most == 0:
        return EMPTY
    if least == 0:
        return either([p, EMPTY]) if most == 1 else ANY
    copies = min(least, COPIES)
    out = reduce(then, [p] * copies)
    if least == most == copies:
        return out
    whole, end = out.open(), p.open()
    return Part(None, whole.begins, end.ends, whole.match)


def folded(code: int) -> str | None:
    c = chr(code)
    return None if code > 127 else c.lower()


def one_of(items: list) -> Part:
    """A class of characters."""
    found: set[str] = set()
    for kind, value in items:
        codes = [value] if kind is kinds.LITERAL else range(value[0], value[1] + 1) if kind is kinds.RANGE else None
        if codes is None or len(codes) > 2 * CLASS or any(folded(c) is None for c in codes):
            return ANY
        found.update(folded(c) for c in codes)
    return Part(frozenset(found)) if len(found) <= CLASS else ANY


def part_of(tree) -> Part:
    out = EMPTY
    for kind, value in tree:
        if kind is kinds.LITERAL:
            c = folded(value)
            p = ANY if c is None else Part(frozenset({c}))
        elif kind is kinds.IN:
            p = one_of(value)
        elif kind is kinds.SUBPATTERN:
            p = part_of(value[3])
        elif kind is kinds.ATOMIC_GROUP:
            p = part_of(value)
        elif kind is kinds.BRANCH:
            p = either([part_of(x) for x in value[1]])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            p = repeated(part_of(value[2]), value[0], 2**31 if value[1] is kinds.MAXREPEAT else value[1])
        elif kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            p = EMPTY  # no characters of its own
        else:
            p = ANY  # any character, a back reference: nothing is known
        out = then(out, p)
    return out


def query_of(regex: str) -> Query:
    """TRUE if there is no mandatory trigram: then every text is scanned."""
    return part_of(syntax.parse(regex)).open().match


def grams_of(query: Query) -> list[str]:
    return [query] if isinstance(query, str) else sorted({g for q in query[1] for g in grams_of(q)})


def holds(query: Query, held) -> bool:
    """Whether a set of trigrams satisfies a query."""
    if isinstance(query, str):
        return query in held
    return (all if query[0] == "and" else any)(holds(q, held) for q in query[1])
