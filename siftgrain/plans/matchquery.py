"""Boolean search expressions, compiled to predicates over token arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS, MAX_DEPTH = 512, 64, 16

_PIECE = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')


@dataclass
class Node:
    """A phrase of tokens, or ``and``, ``or``, ``not`` over other nodes."""

    op: str
    parts: list = field(default_factory=list)


class MatchQueryError(ValueError):
    """An expression that cannot be read."""


def parse(text: str, implicit: str = "or") -> Node:
    """Reads quotes, AND, OR, NOT (binding as 2, 1, 3), parentheses; neighbours without an operator are joined by ``implicit``.

    Words are tokenised like texts, so ``hello_world`` is a phrase of two tokens.
    """
    if len(text) > MAX_CHARS:
        raise MatchQueryError("expression too long")
    pieces = []
    for quoted, bracket, word in _PIECE.findall(text):
        if bracket or word in ("AND", "OR", "NOT"):
            pieces.append(bracket or word)
        elif terms := re.findall(r"[^\W_]+", (quoted or word).lower()):
            pieces.append(Node("phrase", terms))
    if len(pieces) > MAX_TOKENS:
        raise MatchQueryError("too many tokens")
    node, rest = _either(pieces, 0, implicit, 0)
    if rest != len(pieces) or node is None:
        raise MatchQueryError("unbalanced or empty expression")
    return node


def _either(p, i, implicit, depth):
    if depth > MAX_DEPTH:
        raise MatchQueryError("nested too deeply")
    parts = []
    while True:
        node, i = _both(p, i, implicit, depth)
        parts.append(node)
        if i < len(p) and p[i] == "OR":
            i += 1
        elif not (implicit == "or" and i < len(p) and p[i] not in (")", "AND")):
            break
    if None in parts:
        raise MatchQueryError("an operator lacks its side")
    return (parts[0] if len(parts) == 1 else Node("or", parts)), i


def _both(p, i, implicit, depth):
    parts = []
    while True:
        node, i = _single(p, i, implicit, depth)
        parts.append(node)
        if i < len(p) and p[i] == "AND":
            i += 1
        elif not (i < len(p) and (p[i] == "NOT" or implicit == "and" and p[i] not in (")", "OR"))):
            break
    if None in parts:
        raise MatchQueryError("an operator lacks its side")
    return (parts[0] if len(parts) == 1 else Node("and", parts)), i


def _single(p, i, implicit, depth):
    if i >= len(p) or p[i] in (")", "AND", "OR"):
        return None, i
    if p[i] == "NOT":
        node, i = _single(p, i + 1, implicit, depth + 1)
        if node is None:
            raise MatchQueryError("NOT lacks its side")
        return Node("not", [node]), i
    if p[i] == "(":
        node, i = _either(p, i + 1, implicit, depth + 1)
        if i >= len(p) or p[i] != ")":
            raise MatchQueryError("unbalanced parentheses")
        return node, i + 1
    return p[i], i + 1


def positive_terms(node: Node) -> list[str]:
    """The terms that count for the score: those not under a NOT, each once, in order."""
    if node.op == "phrase":
        return list(dict.fromkeys(node.parts))
    if node.op == "not":
        return []
    return list(dict.fromkeys(t for part in node.parts for t in positive_terms(part)))


def predicate(node: Node, tokens: Column) -> Column:
    """Whether a token array matches; a phrase needs its tokens next to each other."""
    if node.op == "phrase":
        if len(node.parts) == 1:
            return F.array_contains(tokens, node.parts[0])
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(node.parts) + " ")
    if node.op == "not":
        return ~predicate(node.parts[0], tokens)
    join = (lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b)
    return reduce(join, [predicate(part, tokens) for part in node.parts])
