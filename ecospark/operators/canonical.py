"""Canonical codes of small labelled graphs: the helper that one packed molecule goes through.

Classes of atoms are refined by their neighbourhoods until nothing splits. Where atoms still share a class, each member of the
first such class is singled out in turn and refinement goes on, so that every way to order the atoms that the classes
allow ends in a complete order, whose bond list is a code; the smallest code is the molecule's. Two orders with one
code are a symmetry, and members that a symmetry maps to one already tried (with all earlier choices fixed) are skipped, which keeps
symmetric molecules cheap.
"""

from __future__ import annotations

from collections.abc import Sequence


def _refine(colours: list[int], near: list[list[tuple]]) -> list[int]:
    count = len(set(colours))
    while True:
        keys = [(c, tuple(sorted((o, colours[v]) for v, o in near[i]))) for i, c in enumerate(colours)]
        order = {k: r for r, k in enumerate(sorted(set(keys)))}
        colours = [order[k] for k in keys]
        if len(order) == count:
            return colours
        count = len(order)


def _orbit(symmetries: list[list[int]], fixed: list[int], n: int) -> list[int]:
    """Smallest atom that each atom maps to under the symmetries that keep ``fixed`` in place."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for g in symmetries:
        if all(g[p] == p for p in fixed):
            for i, j in enumerate(g):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def canonical_order(labels: Sequence, edges: Sequence[tuple[int, int, float]]) -> list[int]:
    """The place of each atom in the molecule's canonical order; ``labels`` sort, ``edges`` are (a, b, order) of different atoms."""
    n = len(labels)
    near: list[list[tuple]] = [[] for _ in range(n)]
    for a, b, o in edges:
        near[a].append((b, o))
        near[b].append((a, o))
    rank = {k: r for r, k in enumerate(sorted(set(labels)))}
    best: list = [None, None]
    symmetries: list[list[int]] = []

    def code(colours: list[int]) -> list[tuple]:
        return sorted((min(colours[a], colours[b]), max(colours[a], colours[b]), o) for a, b, o in edges)

    # frames: colours, atoms singled out, members still to try, members tried
    def frame(colours: list[int], fixed: list[int]) -> list | None:
        cells: dict[int, list[int]] = {}
        for i, c in enumerate(colours):
            cells.setdefault(c, []).append(i)
        shared = [c for c in sorted(cells) if len(cells[c]) > 1]
        if shared:
            return [colours, fixed, list(cells[shared[0]]), []]
        found = code(colours)
        if best[0] is None or found < best[0]:
            best[:] = [found, colours]
        elif found == best[0]:
            back = {c: i for i, c in enumerate(colours)}
            symmetries.append([back[best[1][i]] for i in range(n)])
        return None

    stack = [f for f in [frame(_refine([rank[x] for x in labels], near), [])] if f]
    while stack:
        colours, fixed, todo, tried = stack[-1]
        if not todo:
            stack.pop()
            continue
        v = todo.pop(0)
        if tried:
            orbit = _orbit(symmetries, fixed, n)
            if any(orbit[v] == orbit[u] for u in tried):
                continue
        tried.append(v)
        single = [2 * c + 1 for c in colours]
        single[v] -= 1
        child = frame(_refine(single, near), [*fixed, v])
        if child:
            stack.append(child)
    return best[1] if best[1] is not None else []


def canonical_code(labels: Sequence, edges: Sequence[tuple[int, int, float]]) -> str:
    """Text of the graph in canonical order: the labels, then the bonds."""
    place = canonical_order(labels, edges)
    atoms = [str(x) for _, x in sorted(zip(place, labels, strict=True))]
    bonds = sorted((min(place[a], place[b]), max(place[a], place[b]), o) for a, b, o in edges)
    return ",".join(atoms) + ";" + ",".join(f"{a}-{b}:{o:g}" for a, b, o in bonds)
