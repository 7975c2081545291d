"""Greedy matching of boxes and rows of words inside photos: one Arrow batch holds whole photos, pairs come in blocks.

A dense photo has as many pairs as the square of its boxes, so pairs are never a table: they are listed from a grid a
block at a time and dropped when the block is settled. What a task holds grows with the boxes of a photo, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIDES = ["x0", "y0", "x1", "y1"]
BLOCK = 1 << 20


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables that hold every group whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = _codes(batch.column(k))
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and [batch.column(k)[0].as_py() for k in keys] != last
        last = [batch.column(k)[-1].as_py() for k in keys]
        at = np.flatnonzero(new)
        if len(at):
            held.append(batch.slice(0, at[-1]))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(at[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(c):
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _codes(c) -> np.ndarray:
    """A number per value in order of appearance; null is -1."""
    c = _one(c).dictionary_encode()
    return pc.fill_null((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(c) -> np.ndarray:
    """Dense ranks of values; null comes first."""
    return pc.rank(_one(c), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _boxes(t: pa.Table) -> np.ndarray:
    return np.array([_one(t.column(c)).to_numpy(zero_copy_only=False) for c in SIDES])


def usable(box: np.ndarray) -> np.ndarray:
    return np.isfinite(box).all(0) & (box[2] > box[0]) & (box[3] > box[1])


def overlaps(ga: np.ndarray, a: np.ndarray, unit: np.ndarray, gb: np.ndarray, b: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks ``(i, j, intersection)`` of the boxes ``a[:, i]`` and ``b[:, j]`` of one group that overlap, each pair once.

    ``ga`` and ``gb`` number the groups. Blocks follow the order of ``a``, and boxes of one ``unit`` (a number that never
    falls) are in one block. The grid of a group has cells of the mean size of its ``b``, at most 256 a side.
    """
    if not len(ga) or not len(gb):
        return
    n = int(max(ga.max(), gb.max())) + 1
    few = np.bincount(gb, minlength=n)
    low, step, cells = [], [], []
    for d in (0, 1):
        lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(lo, gb, b[d])
        np.maximum.at(hi, gb, b[d + 2])
        span = np.where(few > 0, hi - lo, 1.0)
        mean = np.bincount(gb, b[d + 2] - b[d], n) / np.maximum(few, 1)
        s = np.where(few > 64, np.maximum(mean, span / 256), span * 2)
        low.append(np.where(few > 0, lo, 0.0))
        step.append(s)
        cells.append(np.floor(span / s).astype(np.int64) + 1)
    at = lambda g, v, d: np.clip(np.floor((v - low[d][g]) / step[d][g]), 0, cells[d][g] - 1).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(cells[0] * cells[1])])
    bx, by = at(gb, b[0], 0), at(gb, b[1], 1)
    wide = at(gb, b[2], 0) - bx + 1
    n_b = wide * (at(gb, b[3], 1) - by + 1)
    j = np.repeat(np.arange(len(gb)), n_b)
    k = np.arange(len(j)) - np.repeat(np.cumsum(n_b) - n_b, n_b)
    x, y = bx[j] + k % wide[j], by[j] + k // wide[j]
    cell = first[gb[j]] + y * cells[0][gb[j]] + x
    o = np.argsort(cell, kind="stable")
    j, x, y = j[o], x[o].astype(np.int32), y[o].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=first[-1]))])
    bx, by = bx.astype(np.int32), by.astype(np.int32)
    use = np.flatnonzero(few[ga] > 0)
    g = ga[use]
    ax, ay = at(g, a[0, use], 0), at(g, a[1, use], 1)
    lines = at(g, a[3, use], 1) - ay + 1
    who = np.repeat(np.arange(len(use)), lines)
    row = ay[who] + np.arange(len(who)) - np.repeat(np.cumsum(lines) - lines, lines)
    left = first[g[who]] + row * cells[0][g[who]]
    lo, hi = begin[left + ax[who]], begin[left + at(g, a[2, use], 0)[who] + 1]
    size = hi - lo
    ax, ay = ax.astype(np.int32), ay.astype(np.int32)
    total = np.concatenate([[0], np.cumsum(size)])
    u = unit[use][who]
    starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    p = 0
    while p < len(starts):
        q = max(p + 1, int(np.searchsorted(total[starts], total[starts[p]] + block, "right")) - 1)
        q = len(starts) if total[-1] - total[starts[p]] <= block else q
        r0, r1 = starts[p], starts[q] if q < len(starts) else len(who)
        p = q
        c = size[r0:r1]
        m = int(c.sum())
        if not m:
            continue
        at_j = np.repeat(lo[r0:r1] - (np.cumsum(c) - c), c) + np.arange(m)
        w, jj = np.repeat(who[r0:r1], c), j[at_j]
        once = (x[at_j] == np.maximum(ax[w], bx[jj])) & (y[at_j] == np.maximum(ay[w], by[jj]))
        i, jj = use[w[once]], jj[once]
        dx = np.minimum(a[2, i], b[2, jj]) - np.maximum(a[0, i], b[0, jj])
        ok = dx > 0
        i, jj, dx = i[ok], jj[ok], dx[ok]
        dy = np.minimum(a[3, i], b[3, jj]) - np.maximum(a[1, i], b[1, jj])
        ok = dy > 0
        yield i[ok], jj[ok], dx[ok] * dy[ok]


def _pieces(t: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from t.combine_chunks().to_batches(max_chunksize=10_000)


def greedy(t: pa.Table, keys: list[str], threshold: float, near: bool = True, block: int = BLOCK) -> pa.Table:
    """Whole photos, or tiles of them, ``(*keys, a, b, box, conf, pred)`` as ``(key, a, b, iou, conf, status)`` with the
    first of ``keys``; see ``matching.match_boxes``.

    Predictions have their turn by falling ``conf`` (null first), then ``a``; the best truth that is still free and
    overlaps by ``threshold`` is theirs, of equal ones the first ``b``. A truth with an ``a`` is held by that prediction and
    its ``conf``: it is free for earlier turns only. Without ``near`` the IoU of FP rows is 0.
    """
    codes = [_codes(t.column(k)) for k in keys]
    group = np.cumsum(np.concatenate([[False], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))  # rows of a group stand together
    is_pred = _one(t.column("pred")).to_numpy(zero_copy_only=False).astype(bool)
    box, a, b = _boxes(t), _ranks(t.column("a")), _ranks(t.column("b"))
    valid = lambda c: pc.is_valid(_one(t.column(c))).to_numpy(zero_copy_only=False)
    conf, known, named = pc.fill_null(_one(t.column("conf")), 0.0).to_numpy(zero_copy_only=False), valid("conf"), valid("a")
    at_p, at_t = np.flatnonzero(is_pred), np.flatnonzero(~is_pred)
    of = lambda at, c: np.unique(group[at] * (len(c) + 1) + c[at], return_inverse=True)[1].reshape(-1)
    id_p, id_t = of(at_p, a), of(at_t, b)
    good = usable(box) & valid(keys[0])
    p = np.flatnonzero(good[at_p] & named[at_p])
    q = np.flatnonzero(good[at_t] & valid("b")[at_t])
    held = q[named[at_t[q]]]
    both = np.concatenate([at_p[p], at_t[held]])
    order = np.lexsort((a[both], -conf[both], known[both], group[both]))
    o = both[order]
    pair = lambda v: np.concatenate([[False], (v[1:] != v[:-1]) & ~((v[1:] != v[1:]) & (v[:-1] != v[:-1]))]) if len(v) else np.zeros(0, bool)
    turn = np.cumsum(pair(group[o]) | pair(known[o]) | pair(conf[o]) | pair(a[o]))
    never = len(turn) + 1
    taken = np.full(int(id_t.max()) + 1 if len(id_t) else 0, never)
    of_held = order >= len(p)
    taken[id_t[held[order[of_held] - len(p)]]] = turn[of_held]
    p, rows, turn = p[order[~of_held]], o[~of_held], turn[~of_held]
    truth = at_t[q]
    box_p, box_t = np.ascontiguousarray(box[:, rows]), np.ascontiguousarray(box[:, truth])
    area_p, area_t = ((v[2] - v[0]) * (v[3] - v[1]) for v in (box_p, box_t))
    who_p, who_t, rank = id_p[p], id_t[q], b[truth]
    used, best = np.zeros(int(id_p.max()) + 1 if len(id_p) else 0, bool), np.zeros(int(id_p.max()) + 1 if len(id_p) else 0)
    tp_p, tp_t, tp_iou = [], [], []
    at_group, of_group, start = group[rows], group[truth], 0
    while start < len(rows):
        rest, seen = np.flatnonzero(taken[who_t] > turn[start]), 0
        for i, j, inter in overlaps(at_group[start:], box_p[:, start:], turn[start:], of_group[rest], box_t[:, rest], block):
            if not len(i):
                continue
            i, j, seen = i + start, rest[j], seen + len(i)
            end = turn[i[-1]]
            free = taken[who_t[j]] > turn[i]
            i, j, inter = i[free], j[free], inter[free]
            iou = inter / (area_p[i] + area_t[j] - inter)
            c = np.flatnonzero(iou >= threshold)
            c = c[np.lexsort((rank[j[c]], -iou[c], turn[i[c]]))]
            wa, wb = who_p[i[c]], who_t[j[c]]
            got, seen_a, seen_b = [], set(), set()
            for k, (x, y) in enumerate(zip(wa.tolist(), wb.tolist())):
                if x not in seen_a and y not in seen_b:
                    if not used[x]:
                        got.append(k)
                        seen_b.add(y)
                    seen_a.add(x)
            c, wa, wb = c[got], wa[got], wb[got]
            used[wa] = True
            taken[wb] = turn[i[c]]
            tp_p.append(rows[i[c]])
            tp_t.append(truth[j[c]])
            tp_iou.append(iou[c])
            if near:
                free = (taken[who_t[j]] > turn[i]) & ~used[who_p[i]]
                np.maximum.at(best, who_p[i[free]], iou[free])
            if seen > 4 * len(rest) and 4 * np.count_nonzero(taken[who_t[rest]] <= end) > len(rest):
                start = int(np.searchsorted(turn, end, "right"))  # goes on without the truths that no later turn can have
                break
        else:
            break
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    tp, of_t, iou = flat(tp_p, np.int64), flat(tp_t, np.int64), flat(tp_iou, np.float64)
    fp, fn = at_p[~used[id_p]], at_t[taken[id_t] == never]
    n = [len(tp), len(fp), len(fn)]
    mine, kept = pa.array(np.concatenate([tp, fp, fn])), pa.array(np.concatenate([of_t, fp, fn]))
    out = [t.column(keys[0]).take(mine), t.column("a").take(mine), t.column("b").take(kept), pa.array(np.concatenate([iou, best[id_p[~used[id_p]]], np.zeros(n[2])])), t.column("conf").take(mine), pa.array(np.repeat(["TP", "FP", "FN"], n).tolist(), pa.string())]
    return pa.table(dict(zip([keys[0], "a", "b", "iou", "conf", "status"], out)))


def matcher(keys: list[str], threshold: float, only: str | None = None):
    """Batches for ``mapInArrow``: the rows of ``greedy``, of the status ``only`` if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            got = greedy(t, keys, threshold, only != "TP")
            yield from _pieces(got.filter(pc.equal(got.column("status"), only)) if only else got)

    return run


def liner(key: str, tol: float):
    """Batches ``(key, slot, b, id, box)``, words with a null ``b``, as ``(key, b, rows, words, order)`` of the lines."""

    def solve(t: pa.Table, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
        group = _codes(t.column(key)) * (1 << 20) + _one(t.column("slot")).to_numpy(zero_copy_only=False)
        group = np.unique(group, return_inverse=True)[1].reshape(-1)
        is_line = pc.is_valid(_one(t.column("b"))).to_numpy(zero_copy_only=False)
        box = _boxes(t)
        good = usable(box)
        line, word = np.flatnonzero(is_line & good), np.flatnonzero(~is_line & good)
        rank = _ranks(t.column("b"))[line]
        o = np.lexsort((rank, group[line]))
        line, rank = line[o], rank[o]
        if not len(line) or not len(word):
            return
        unit = np.cumsum(np.concatenate([[False], (group[line][1:] != group[line][:-1]) | (rank[1:] != rank[:-1])]))
        head = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        wb = np.ascontiguousarray(box[:, word])
        mid, high, ident = (wb[1] + wb[3]) / 2, wb[3] - wb[1], pc.fill_null(_one(t.column("id")), 0).to_numpy(zero_copy_only=False)[word]
        for i, j, _ in overlaps(group[line], np.ascontiguousarray(box[:, line]), unit, group[word], wb, block):
            if not len(i):
                continue
            u = unit[i]
            o = np.lexsort((ident[j], wb[0, j], mid[j], u))
            u, j = u[o], j[o]
            start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            n = np.diff(np.append(start, len(u)))
            row = rows_of(mid[j], start, n, np.add.reduceat(high[j], start) / n * tol)
            last = row[start + n - 1] + 1
            o = np.lexsort((ident[j], wb[0, j], row, u))
            ids = pa.ListArray.from_arrays(pa.array(np.append(start, len(u)).astype(np.int32)), pa.array(ident[j[o]]).cast(pa.string()))
            at = pa.array(line[head[u[start]]])
            t_out = pa.table({key: t.column(key).take(at), "b": t.column("b").take(at), "rows": pa.array(last.astype(np.int32)), "words": pa.array(n.astype(np.int64)), "order": pc.binary_join(ids, " ")})
            yield from t_out.combine_chunks().to_batches(max_chunksize=2_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [key, "slot"]):
            yield from solve(t)

    return run


def rows_of(y: np.ndarray, start: np.ndarray, n: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """The row, from 0, of each ``y`` of its line: the first row whose running mean is within ``tol``, else a new one.

    ``y`` rises inside a line, so only its last row can be near: those before lie further back than ``tol`` already. All
    lines take a step at a time, with the sums of the running mean in the order of one by one.
    """
    row = np.zeros(len(y), np.int64)
    o = np.argsort(-n, kind="stable")
    start, n, tol = start[o], n[o], tol[o]
    mean, held, at = y[start].copy(), np.ones(len(start)), np.zeros(len(start), np.int64)
    for step in range(1, int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -step, "left"))
        v = y[start[:k] + step]
        near = np.abs(mean[:k] - v) <= tol[:k]
        mean[:k] = np.where(near, (mean[:k] * held[:k] + v) / (held[:k] + 1), v)
        held[:k] = np.where(near, held[:k] + 1, 1)
        at[:k] += ~near
        row[start[:k] + step] = at[:k]
    return row
