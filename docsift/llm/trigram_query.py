"""Boolean trigram queries derived from regular expressions.

A query says which three-character sequences a text must hold to match: ``ALL`` (nothing is mandatory), a trigram, or
an AND or OR of queries. Texts and trigrams are compared with A-Z lower-cased, which only admits more candidates.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

# Sets of alternatives longer than this are not spelled out.
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Query:
    """``operator`` is 'all', 'gram', 'and' or 'or'."""

    operator: str
    parts: tuple = ()

    def grams(self) -> set[str]:
        if self.operator == "gram":
            return {self.parts[0]}
        return set().union(*(part.grams() for part in self.parts)) if self.operator != "all" else set()

    def matches(self, postings: Callable[[str], object], everything: object) -> object:
        """The texts that may match: ``postings`` gives the set (or bitmap) of texts that hold a trigram."""
        if self.operator == "all":
            return everything
        if self.operator == "gram":
            return postings(self.parts[0])
        found = self.parts[0].matches(postings, everything)
        for part in self.parts[1:]:
            other = part.matches(postings, everything)
            found = found & other if self.operator == "and" else found | other
        return found


ALL = Query("all")


def both(*queries: Query) -> Query:
    parts = tuple(dict.fromkeys(query for query in queries if query != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else Query("and", parts)


def either(queries: list[Query]) -> Query:
    parts = tuple(dict.fromkeys(queries))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else Query("or", parts)


def _of_literals(literals: set[str]) -> Query:
    """One of the literals is in the text."""
    return either([
        both(*[Query("gram", (word[at : at + 3],)) for at in range(len(word) - 2)]) for word in sorted(literals)
    ])


def _class_members(items) -> set[str] | None:
    """The characters of a class, or None if they are many."""
    members: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            members.add(chr(value).lower())
        elif kind is kinds.RANGE and value[1] - value[0] < MAX_ALTERNATIVES:
            members |= {chr(code).lower() for code in range(value[0], value[1] + 1)}
        else:
            return None
    return members if len(members) <= 8 else None


def _joined(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MAX_ALTERNATIVES else None


def _walk(pattern) -> tuple[set[str] | None, Query]:
    """All texts the pattern can match, if they are few; else None and the query."""
    exact: set[str] | None = {""}
    required: list[Query] = []
    whole = True

    def append(literals: set[str] | None, query: Query) -> None:
        nonlocal exact, whole
        together = _joined(exact, literals) if literals is not None else None
        if together is None:
            whole = False
            required.append(_of_literals(exact))
            exact = literals if literals is not None else {""}
        else:
            exact = together
        required.append(query)

    for kind, value in pattern:
        if kind is kinds.LITERAL:
            append({chr(value).lower()}, ALL)
        elif kind is kinds.IN:
            append(_class_members(value), ALL)
        elif kind is kinds.SUBPATTERN:
            append(*_walk(value[3]))
        elif kind is kinds.BRANCH:
            found = [_walk(branch) for branch in value[1]]
            if all(literals is not None for literals, _ in found):
                append(set().union(*(literals for literals, _ in found)), ALL)
            else:
                append(None, either([
                    both(_of_literals(literals), query) if literals is not None else query for literals, query in found
                ]))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            least, most, inner = value
            literals, query = _walk(inner)
            if (least, most) == (0, 1) and literals is not None:
                append(literals | {""}, ALL)
            elif least == most and literals is not None and len(literals) == 1 and least <= 64:
                append({next(iter(literals)) * least}, ALL)
            else:
                if least and literals is not None:
                    append(literals, ALL)  # the first round; what comes between it and the rest is open
                append(None, query if least else ALL)
        elif kind is kinds.AT or kind is kinds.ASSERT_NOT:
            continue
        elif kind is kinds.ATOMIC_GROUP:
            append(*_walk(value))
        else:  # any character, look-around, back reference: nothing is mandatory
            append(None, ALL)
    if whole:
        return exact, ALL
    return None, both(*required, _of_literals(exact))


def trigram_query(pattern: str) -> Query:
    """The mandatory trigrams of a regular expression; ``ALL`` if there are none."""
    literals, query = _walk(parser.parse(pattern, re.ASCII))
    return _of_literals(literals) if literals is not None else query
