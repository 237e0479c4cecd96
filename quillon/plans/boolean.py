"""Conditions as trees: their clauses, names with their tables, and what is left once some clauses are known.

Catalyst simplifies what it runs; these are for callers that look at a statement before it runs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from ..sql import ast
from .select import Scope


def clauses(node: ast.Condition) -> list[ast.Condition]:
    """The comparisons of a condition, from left to right."""
    return clauses(node.left) + clauses(node.right) if node.op in ("and", "or") else [node]


def qualified(node: ast.Condition, scope: Scope) -> ast.Condition:
    """The same with every column under its table's name; unknown and ambiguous names raise."""

    def side(x):
        if isinstance(x, ast.Condition):
            return qualified(x, scope)
        if isinstance(x, ast.Aggregate):
            return replace(x, of=side(x.of))
        return ast.Name(x.column, scope.find(x).table) if isinstance(x, ast.Name) else x

    return replace(node, left=side(node.left), right=side(node.right))


def simplified(node: ast.Condition, known: Mapping[ast.Condition, bool]) -> ast.Condition | bool:
    """The condition that is left when some clauses are known to be true or false, or what it then is."""
    if node.op not in ("and", "or"):
        return known.get(node, node)
    deciding = node.op == "or"  # a side with this value decides the whole; one with the other value falls away
    a, b = simplified(node.left, known), simplified(node.right, known)
    if a is deciding or b is deciding:
        return deciding
    if isinstance(a, bool):
        return b
    return a if isinstance(b, bool) else replace(node, left=a, right=b)
