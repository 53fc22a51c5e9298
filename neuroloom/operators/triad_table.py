"""The 64 codes of a triple's arcs: triad type, edge orders for canonical signs, and node roles.

A triple (v, u, w) has six possible arcs, in slots 1 to 6: v>u, u>v, v>w, w>v, u>w, w>u; slot k
counts 2**(k-1) in the code.  All that follows is derived by rule from the reference orders.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

SLOTS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))

# The order in which a type's edges carry the signs of its name.
EDGE_ORDER = {
    "021D": ((0, 1), (0, 2)),
    "021U": ((0, 1), (2, 1)),
    "021C": ((0, 1), (1, 2)),
    "111D": ((0, 1), (1, 2), (2, 1)),
    "111U": ((0, 1), (0, 2), (2, 0)),
    "030T": ((0, 1), (1, 2), (0, 2)),
    "030C": ((0, 1), (1, 2), (2, 0)),
    "201": ((0, 1), (1, 0), (0, 2), (2, 0)),
    "120D": ((0, 1), (0, 2), (1, 2), (2, 1)),
    "120U": ((0, 2), (1, 2), (0, 1), (1, 0)),
    "120C": ((0, 1), (1, 2), (0, 2), (2, 0)),
    "210": ((0, 1), (1, 2), (2, 1), (0, 2), (2, 0)),
    "300": ((0, 1), (1, 0), (1, 2), (2, 1), (2, 0), (0, 2)),
}

#: The nodes of EDGE_ORDER that play P, X and O, and which of the three areas are put in order.
ROLES = {
    "021D": ((0, 1, 2), "xo"), "021U": ((1, 0, 2), "xo"), "021C": ((0, 1, 2), ""), "111D": ((2, 1, 0), ""), "111U": ((2, 0, 1), ""),
    "030T": ((0, 1, 2), ""), "030C": ((0, 1, 2), "turn"), "201": ((0, 1, 2), "xo"), "120D": ((0, 1, 2), "xo"), "120U": ((0, 1, 2), "px"),
    "120C": ((0, 1, 2), ""), "210": ((0, 1, 2), ""), "300": ((0, 1, 2), "all"),
}


def arcs(code: int) -> frozenset[tuple[int, int]]:
    return frozenset(a for k, a in enumerate(SLOTS) if code >> k & 1)


@cache
def table() -> list[tuple]:
    """(code, type, order number, slot of each sign or 7, P, X, O as 1 to 3, what is sorted): a row for each way the type maps onto the code."""
    out = []
    for code in range(64):
        have = arcs(code)
        for kind, order in EDGE_ORDER.items():
            ways = [m for m in permutations(range(3)) if {(m[a], m[b]) for a, b in order} == have]
            for n, m in enumerate(ways):
                slots = [SLOTS.index((m[a], m[b])) + 1 for a, b in order]
                # Roles are read off the first mapping alone.
                out.append((code, kind, n, *(slots + [7] * (6 - len(slots))), *(m[r] + 1 for r in ROLES[kind][0]), ROLES[kind][1]))
    return out


@cache
def vocabulary() -> list[str]:
    """All signed types: a type and the least of its equivalent sign strings."""
    names = []
    for kind, order in EDGE_ORDER.items():
        same = [m for m in permutations(range(3)) if {(m[a], m[b]) for a, b in order} == set(order)]
        turns = [[order.index((m[a], m[b])) for a, b in order] for m in same]
        found = {min("".join(s[i] for i in t) for t in turns) for s in (format(k, f"0{len(order)}b").replace("0", "+").replace("1", "-") for k in range(1 << len(order)))}
        names += [kind + s for s in sorted(found)]
    return names


def table_sql() -> str:
    rows = ", ".join(f"({c}, '{k}', {n}, {a}, {b}, {d}, {e}, {f}, {g}, {p}, {x}, {o}, '{s}')" for c, k, n, a, b, d, e, f, g, p, x, o, s in table())
    return f"(SELECT * FROM (VALUES {rows}) AS t(code, kind, ord, s1, s2, s3, s4, s5, s6, p, x, o, sorts))"


def vocabulary_sql() -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in vocabulary()) + ") AS t(smt))"
