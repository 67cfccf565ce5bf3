"""Edit scripts between nested schemas.

A schema is a tree of named, typed fields. The distance is a constrained
unordered tree edit distance: a field is kept or renamed onto one of the same
parent's counterpart, its children are paired by a least-cost assignment, and
what is left over is added or deleted with all that hangs below it. A subtree
deleted in one place and added unchanged in another is then one move, which
costs no more than both. Pairs of one name take part in the assignment at no
cost of their own, so a script is the cheapest there is under this constraint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from tradespan.functions.assign import least_cost_assignment


@dataclass(frozen=True)
class Field:
    name: str
    type: str | None = None
    children: tuple[Field, ...] = ()
    key: object = None

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def same_as(self, other: Field) -> bool:
        return self.name == other.name and self.type == other.type and len(self.children) == len(other.children) and all(
            a.same_as(b) for a, b in zip(sorted(self.children, key=lambda c: c.name), sorted(other.children, key=lambda c: c.name))
        )


@dataclass(frozen=True)
class Edit:
    """``change``: added, removed, renamed, retyped, moved or reordered; paths are tuples of names from the root."""

    change: str
    old: tuple[str, ...] | None
    new: tuple[str, ...] | None
    old_field: Field | None = field(default=None, compare=False)
    new_field: Field | None = field(default=None, compare=False)


#: What a kept name is worth when two pairings cost the same.
SAME_NAME = 1e-6
#: (old, new) -> cost of taking one for the other, None where it may not be
RenameCost = Callable[[Field, Field], "float | None"]


def _pair_cost(a: Field, b: Field, rename: RenameCost) -> float:
    if a.name == b.name:
        own = 0.0
    else:
        known = rename(a, b)
        if known is None:
            return np.inf
        own = known
    if not a.children and not b.children:
        return own
    return own + _children(a, b, rename)[0]


def _children(a: Field, b: Field, rename: RenameCost) -> tuple[float, list[tuple[Field, Field]]]:
    """Cost and pairs of the cheapest pairing of the children of ``a`` and ``b``."""
    old, new = a.children, b.children
    gain = np.zeros((len(old), len(new)))
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            # what pairing the two saves against deleting one and adding the other; of equal savings the same name goes first
            saved = min(0.0, _pair_cost(x, y, rename) - x.size() - y.size())
            gain[i, j] = saved - SAME_NAME if x.name == y.name and saved < 0 else saved
    chosen = [(i, j) for i, j in least_cost_assignment(gain) if gain[i, j] < 0]
    pairs = [(old[i], new[j]) for i, j in chosen]
    total = sum(c.size() for c in old) + sum(c.size() for c in new)
    total += sum(_pair_cost(x, y, rename) - x.size() - y.size() for x, y in pairs)
    return total, pairs


def edit_script(old: Field, new: Field, rename: RenameCost, kept: bool = False) -> list[Edit]:
    """The cheapest edits that turn ``old`` into ``new``, roots taken for each other. ``kept`` also gives a ``kept`` for every field that lives on, whatever else befalls it."""

    def walk(a: Field, b: Field, at_a: tuple[str, ...], at_b: tuple[str, ...]) -> Iterator[Edit]:
        _, pairs = _children(a, b, rename)
        by_old, by_new = {id(x): y for x, y in pairs}, {id(y) for _, y in pairs}
        order = [b.children.index(by_old[id(x)]) for x in a.children if id(x) in by_old]
        for x in a.children:
            here = (*at_a, x.name)
            if id(x) not in by_old:
                yield Edit("removed", here, None, x, None)
                continue
            y = by_old[id(x)]
            there = (*at_b, y.name)
            if kept:
                yield Edit("kept", here, there, x, y)
            if x.name != y.name:
                yield Edit("renamed", here, there, x, y)
            if x.type is not None and y.type is not None and x.type != y.type:
                yield Edit("retyped", here, there, x, y)
            yield from walk(x, y, here, there)
        for y in b.children:
            if id(y) not in by_new:
                yield Edit("added", None, (*at_b, y.name), None, y)
        if order != sorted(order):
            yield Edit("reordered", at_a, at_b, a, b)

    edits = list(walk(old, new, (), ()))
    gone = [e for e in edits if e.change == "removed"]
    moved: dict[int, Edit] = {}
    for e in [e for e in edits if e.change == "added"]:
        match = next((g for g in gone if g.old_field.same_as(e.new_field) and g.old[:-1] != e.new[:-1]), None)
        if match is not None:
            gone.remove(match)
            moved[id(e)] = Edit("moved", match.old, e.new, match.old_field, e.new_field)
            moved[id(match)] = None
    return [moved.get(id(e), e) for e in edits if moved.get(id(e), e) is not None]


def edit_distance(old: Field, new: Field, rename: RenameCost) -> float:
    return _children(old, new, rename)[0]
