"""What one task can settle of a least spanning forest by itself.

Nodes lie in cells, and tasks hold the nodes of a cell, or of cells that lie
together, and all edges that end in them. The least edge that leaves a part
belongs to the forest. Where it ends in the same task, the parts are joined
there; else they wait for a task that holds more cells. So each step leaves
little more than the parts along the borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SETTLED = "kind string, src long, dst long, w double, a long, b long, ra double, rb double, ca long, cb long, sc long, dc long"


def united(part: np.ndarray, a: np.ndarray, b: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(part, kept)`` after the ``chosen`` edges, in order, without those that close a ring; a part is named by its least node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for e, x, y in zip(chosen.tolist(), part[a[chosen]].tolist(), part[b[chosen]].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(e)
    names = np.arange(len(part))
    names[list(parent)] = [find(x) for x in list(parent)]
    return names[part], np.array(kept, np.int64)


def first_out(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first edge that leaves each part, the number of edges where none does."""
    live = np.flatnonzero(part[a] != part[b])[::-1]
    out = np.full((2, len(part)), len(a))
    # Of the edges of one part the last that is written stays, which is the first in order.
    out[0, part[a[live]]] = live
    out[1, part[b[live]]] = live
    return out.min(axis=0)


def _lists(group: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, d)``: positions and distances of listed neighbours that are in the group."""
    near = group["near"].combine_chunks()
    i = np.repeat(np.arange(len(ids)), pc.list_value_length(near).to_numpy(zero_copy_only=False))
    flat = near.flatten()
    nb, d = pc.struct_field(flat, "nb").to_numpy(zero_copy_only=False), pc.struct_field(flat, "d").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    j = order[np.minimum(np.searchsorted(ids[order], nb), len(ids) - 1)]
    here = ids[j] == nb
    return i[here], j[here], d[here]


def around_cell(closest):
    """The edges of a least forest of one cell ``g`` and what is around it, up to the length ``h`` of the cell.

    Rows are ``g, id, v, core, last, cell, h, near``: vectors, the radius ``last``
    within which ``near`` lists all others, and ``h``, the length up to which the
    rows around a cell are complete. Edges between vectors of other cells are left out.
    """
    def run(group: pa.Table) -> pa.Table:
        ids, cell, core, last, h = (group[c].to_numpy() for c in ("id", "cell", "core", "last", "h"))
        own, n, last = cell == group["g"][0].as_py(), len(ids), last.copy()
        limit = float(h[own][0])
        i, j, d = _lists(group, ids)
        w = np.maximum(np.maximum(d, core[i]), core[j])
        a, b = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        _, once = np.unique(a * n + b, return_index=True)
        once = once[w[once] <= limit]
        a, b, w = a[once], b[once], w[once]
        part, kept, rows = np.arange(n), [], None
        while True:
            order = np.lexsort((ids[b], ids[a], w))
            a, b, w = a[order], b[order], w[order]
            while True:
                first, radius = first_out(part, a, b), np.full(n, np.inf)
                np.minimum.at(radius, part, last)
                least = np.append(w, np.inf)[first]
                chosen = np.unique(first[(first < len(w)) & (least <= radius)])
                if not len(chosen):
                    break
                part, new = united(part, a, b, chosen)
                kept.append((a[new], b[new], w[new]))
            # All parts but the largest look for their least edge among all vectors.
            size = np.bincount(part, minlength=n)
            open_ = (size > 0) & (radius < limit)
            open_[np.argmax(size)] = False
            if not open_.any():
                break
            bound = np.minimum(least, limit)[part]
            asked = np.flatnonzero(open_[part] & (last < bound))
            if rows is None:
                rows = group.select(["v", "core"]).append_column("id", pa.array(np.arange(n)))
            table = rows.append_column("component", pa.array(part))
            found = closest(table.take(pa.array(asked)).append_column("bound", pa.array(bound[asked])), table)
            near = found["w"].to_numpy() <= np.minimum(least, limit)[found["a"].to_numpy()]
            x, y, z = (found[c].to_numpy()[near] for c in ("src", "dst", "w"))
            shown = least.copy()
            np.minimum.at(shown, found["a"].to_numpy()[near], z)
            last = np.where(open_[part], np.maximum(last, np.minimum(shown, limit)[part]), last)
            swap = ids[x] > ids[y]
            a, b, w = np.append(a, np.where(swap, y, x)), np.append(b, np.where(swap, x, y)), np.append(w, z)
        a, b, w = (np.concatenate([k[c] for k in kept] or [np.zeros(0)]) for c in range(3))
        a, b = a.astype(np.int64), b.astype(np.int64)
        mine = own[a] | own[b]
        a, b, w = a[mine], b[mine], w[mine]
        return pa.table({"src": ids[a], "dst": ids[b], "w": w.astype(np.float64), "a": ids[a], "b": ids[b], "ra": h[a], "rb": h[b], "ca": cell[a], "cb": cell[b],
                         "sc": cell[a], "dc": cell[b]})
    return run


def settled(shift: int, mask: int):
    """Join the parts of one group of cells, ``g``, by the edges that are sure to be in the forest.

    Rows are edges between parts ``a`` and ``b`` in the cells ``ca`` and ``cb`` (and
    vectors ``src`` and ``dst`` in ``sc`` and ``dc``); no edge that is not given leaves ``a`` below the length ``ra``. Out come edges of the
    ``tree``, the ``name`` of each part afterwards (``b`` of ``a``, with its ``ra``),
    and the edges that are left: ``edge`` between parts of the group, and one
    ``half`` of those that leave it.
    """
    def run(group: pa.Table) -> pa.Table:
        g = group["g"][0].as_py()
        src, dst, w, ca, cb, sc, dc = (group[c].to_numpy() for c in ("src", "dst", "w", "ca", "cb", "sc", "dc"))
        order = np.lexsort((dst, src, w))
        src, dst, w, ca, cb, sc, dc = (c[order] for c in (src, dst, w, ca, cb, sc, dc))
        names, at = np.unique(np.concatenate([group["a"].to_numpy()[order], group["b"].to_numpy()[order]]), return_inverse=True)
        a, b = at[:len(w)], at[len(w):]
        cell, start = np.zeros(len(names), np.int64), np.full(len(names), np.inf)
        cell[a], cell[b] = ca, cb
        np.minimum.at(start, a, group["ra"].to_numpy()[order])
        np.minimum.at(start, b, group["rb"].to_numpy()[order])
        here = ((cell & mask) >> shift) == g
        start[~here] = -1.0
        part, tree, whole = np.arange(len(names)), [np.zeros(0, np.int64)], here[a] & here[b]
        while True:
            first, radius = first_out(part, a, b), np.full(len(names), np.inf)
            np.minimum.at(radius, part, start)
            chosen = np.unique(first[(first < len(w)) & (np.append(w, np.inf)[first] <= radius)])
            chosen = chosen[whole[chosen]]
            if not len(chosen):
                break
            part, new = united(part, a, b, chosen)
            tree.append(new)
        none = np.zeros(0, np.int64)
        t, i = np.concatenate(tree), np.flatnonzero(here)
        x, y = part[a], part[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        e = np.flatnonzero(whole & (x != y))
        e = e[np.unique(lo[e] * len(names) + hi[e], return_index=True)[1]] if len(e) else none
        p, q = np.flatnonzero(here[a] & ~here[b]), np.flatnonzero(here[b] & ~here[a])

        def table(kind: str, of: np.ndarray, end_a: np.ndarray | None, end_b: np.ndarray | None) -> pa.Table:
            def side(v: np.ndarray, end: np.ndarray | None, of_kind: pa.DataType) -> pa.Array:
                return pa.nulls(len(of), of_kind) if end is None else pa.array(v[end], of_kind)
            return pa.table({"kind": pa.array([kind] * len(of), pa.string()), "src": src[of], "dst": dst[of], "w": w[of],
                             "a": side(names, end_a, pa.int64()), "b": side(names, end_b, pa.int64()),
                             "ra": side(radius, end_a, pa.float64()), "rb": side(radius, end_b, pa.float64()),
                             "ca": side(cell, end_a, pa.int64()), "cb": side(cell, end_b, pa.int64()), "sc": sc[of], "dc": dc[of]})

        out = [table("tree", t, None, None), table("edge", e, x[e], y[e]), table("half", p, x[p], None), table("half", q, None, y[q])]
        named = pa.table({"kind": pa.array(["name"] * len(i), pa.string()), "a": names[i], "b": names[part[i]], "ra": radius[part[i]]})
        return pa.concat_tables([*out, named], promote_options="default").select(out[0].column_names)
    return run
