"""Rewrites that need the algebra's knowledge, which Catalyst lacks."""

from __future__ import annotations

from functools import reduce

from . import nodes as N

#: Additions for which a row at its default adds nothing.
_SAFE = frozenset(["+", "null +", "any", "only"])


def discard_defaults(plan: N.Node) -> N.Node:
    """Rows whose values are all defaults are filtered before an aggregation that they cannot change.

    With an aggregation to fewer keys a group of only such rows vanishes, which is what its default means; so this
    is used where the result is read as a table with defaults. A filter that writes defaults becomes a true one.
    """

    def one(node: N.Node) -> N.Node:
        if isinstance(node, N.Aggregate) and node.schema.vals and all(p.name in _SAFE for p in node.plus.values()):
            vals = node.input.schema.vals
            some = lambda row: reduce(lambda a, b: a | b, [~row[v.name].eqNullSafe(v.default_column()) for v in vals])
            return N.Aggregate(N.Where(node.input, some), node.keys, node.plus)
        return node

    return plan.transform(one)


def symmetric_product(plan: N.Node, a: str, b: str) -> N.Node:
    """In a product of a table with its renamed self only the rows with a <= b; the join keeps its equality on the other keys."""

    def one(node: N.Node) -> N.Node:
        if isinstance(node, N.Join) and {a, b} <= set(node.schema.key_names) and isinstance(node.right, N.Rename) and node.right.input is node.left:
            return N.Join(node.left, node.right, node.times, (a, b))
        return node

    return plan.transform(one)
