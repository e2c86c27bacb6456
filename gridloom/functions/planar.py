"""Plane geometry with numpy: triangles, trees of boxes, clipping, measures."""

from __future__ import annotations

import numpy as np


def signed_area(ring: np.ndarray) -> float:
    """Area of a closed or open ring, positive if it turns left."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def open_ring(ring: np.ndarray, left: bool = True) -> np.ndarray:
    """The ring without its closing point and without repeats, turning left or
    right as asked; fewer than three points if it encloses nothing."""
    if len(ring) and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    if len(ring):
        keep = np.ones(len(ring), bool)
        keep[1:] = (ring[1:] != ring[:-1]).any(axis=1)
        ring = ring[keep]
    if len(ring) < 3:
        return ring[:0]
    a = signed_area(ring)
    if a == 0:
        return ring[:0]
    return ring if (a > 0) == left else ring[::-1]


def polygon_area(rings: list[np.ndarray]) -> float:
    return abs(signed_area(rings[0])) - sum(abs(signed_area(r)) for r in rings[1:] if len(r) > 2)


def _turn(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _touched(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The open ring with those of the points that lie on its sides as corners."""
    if not len(points):
        return ring
    a, b = ring, np.roll(ring, -1, axis=0)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    extra: dict[int, list[np.ndarray]] = {}
    points = points[(points >= lo.min(axis=0)).all(axis=1) & (points <= hi.max(axis=0)).all(axis=1)]
    for p in points:
        on = np.flatnonzero((lo <= p).all(axis=1) & (p <= hi).all(axis=1))
        on = on[_turn(a[on], b[on], p) == 0]
        if len(on) and not ((a[on] == p).all(axis=1) | (b[on] == p).all(axis=1)).any():
            extra.setdefault(int(on[0]), []).append(p)
    if not extra:
        return ring
    out = []
    for i, q in enumerate(ring):
        out.append(q)
        out += sorted(extra.get(i, ()), key=lambda p: float(((p - q) ** 2).sum()))
    return np.array(out)


def _opens(prev: np.ndarray, q: np.ndarray, nxt: np.ndarray, p: np.ndarray) -> bool:
    """Whether the way from corner ``q`` of a ring that turns left to ``p`` leaves
    into its inside."""
    if _turn(prev, q, nxt) > 0:
        return bool(_turn(q, nxt, p) > 0 and _turn(prev, q, p) > 0)
    return not bool(_turn(q, nxt, p) <= 0 and _turn(prev, q, p) <= 0)


def _spliced(shell: np.ndarray, hole: np.ndarray) -> np.ndarray | None:
    """Shell and hole as one ring if they have a corner in common."""
    where: dict[tuple, int] = {tuple(p): i for i, p in enumerate(hole.tolist())}
    for j, q in enumerate(shell.tolist()):
        h = where.get(tuple(q))
        if h is not None and _opens(shell[j - 1], shell[j], shell[(j + 1) % len(shell)], hole[(h + 1) % len(hole)]):
            return np.vstack([shell[: j + 1], hole[h + 1 :], hole[: h + 1], shell[j + 1 :]])
    return None


def _bridge(shell: np.ndarray, hole: np.ndarray) -> np.ndarray | None:
    """Shell and hole as one ring, joined at a corner they share or at a pair of
    corners that see each other; None if there are none."""
    joined = _spliced(shell, hole)
    if joined is not None:
        return joined
    h = int(np.lexsort((hole[:, 1], -hole[:, 0]))[0])  # the hole's rightmost point
    p = hole[h]
    a, b = shell, np.roll(shell, -1, axis=0)
    for j in np.argsort(((shell - p) ** 2).sum(axis=1), kind="stable"):
        q = shell[j]
        # no edge of either ring crosses the open segment p q
        blocked = False
        for s, e in ((a, b), (hole, np.roll(hole, -1, axis=0))):
            away = ~((s == q).all(1) | (e == q).all(1) | (s == p).all(1) | (e == p).all(1))
            s, e = s[away], e[away]
            d1, d2 = _turn(p, q, s), _turn(p, q, e)
            d3, d4 = _turn(s, e, p[None]), _turn(s, e, q[None])
            blocked = blocked or bool(((d1 * d2 <= 0) & (d3 * d4 <= 0) & ~((d1 == 0) & (d2 == 0))).any())
        # q may stand twice after earlier bridges; the segment must leave inside
        if not blocked and _opens(shell[j - 1], q, shell[(j + 1) % len(shell)], p):
            return np.vstack([shell[: j + 1], hole[h:], hole[: h + 1], shell[j:]])
    return None


def _ears(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Corners of the triangles of a ring that turns left, by ear clipping. A
    corner is an ear if no corner that turns right lies in its triangle; those are
    looked up in a grid, so a ring of n corners takes little more than n steps."""
    n = len(ring)
    x, y = ring[:, 0].tolist(), ring[:, 1].tolist()
    nxt, prv = [*range(1, n), 0], [n - 1, *range(n - 1)]

    def turn(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    side = max(1, int((n / 2) ** 0.5))
    x0, y0 = min(x), min(y)
    wx, wy = ((max(v) - lo) / side or 1.0 for v, lo in ((x, x0), (y, y0)))
    cell = lambda v, lo, w: min(side - 1, max(0, int((v - lo) / w)))
    inward = [turn(prv[i], i, nxt[i]) <= 0 for i in range(n)]
    grid: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        if inward[i]:
            grid.setdefault((cell(x[i], x0, wx), cell(y[i], y0, wy)), []).append(i)
    gone = [False] * n

    def free(a: int, b: int, c: int) -> bool:
        xs, ys = (x[a], x[b], x[c]), (y[a], y[b], y[c])
        lox, hix, loy, hiy = min(xs), max(xs), min(ys), max(ys)
        corners = {(x[a], y[a]), (x[b], y[b]), (x[c], y[c])}
        rows = range(cell(loy, y0, wy), cell(hiy, y0, wy) + 1)
        for i in range(cell(lox, x0, wx), cell(hix, x0, wx) + 1):
            for j in rows:
                for v in grid.get((i, j), ()):
                    if not gone[v] and inward[v] and v != a and v != c and lox <= x[v] <= hix and loy <= y[v] <= hiy and (x[v], y[v]) not in corners:
                        if turn(a, b, v) >= 0 and turn(b, c, v) >= 0 and turn(c, a, v) >= 0:
                            return False
        return True

    out, i, left, misses = [], 0, n, 0
    while left > 3 and misses <= left:
        a, c = prv[i], nxt[i]
        t = turn(a, i, c)
        if t == 0 or (t > 0 and free(a, i, c)):
            if t > 0:
                out.append((a, i, c))
            nxt[a], prv[c], gone[i] = c, a, True
            for v in (a, c):  # a corner only ever turns from inward to outward, or back by a spike
                now = turn(prv[v], v, nxt[v]) <= 0
                if now and not inward[v]:
                    grid.setdefault((cell(x[v], x0, wx), cell(y[v], y0, wy)), []).append(v)
                inward[v] = now
            left, misses, i = left - 1, 0, nxt[c]
        else:
            misses, i = misses + 1, c
    if left == 3 and turn(prv[i], i, nxt[i]) > 0:
        out.append((prv[i], i, nxt[i]))
    return out


def _slabs(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles of a polygon by the even-odd rule, cut at every height at which a
    side starts, ends or crosses another one. Takes any rings."""
    p = np.concatenate(rings)
    q = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    keep = p[:, 1] != q[:, 1]
    p, q = p[keep], q[keep]
    low = p[:, 1] < q[:, 1]
    a, b = np.where(low[:, None], p, q), np.where(low[:, None], q, p)
    heights = [a[:, 1], b[:, 1]]
    d = b - a
    for i in range(len(a) - 1):  # crossings
        j = np.arange(i + 1, len(a))
        j = j[(np.maximum(a[j, 1], a[i, 1]) < np.minimum(b[j, 1], b[i, 1])) & (np.minimum(a[j, 0], b[j, 0]) <= max(a[i, 0], b[i, 0])) & (np.maximum(a[j, 0], b[j, 0]) >= min(a[i, 0], b[i, 0]))]
        det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        w = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / det, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / det
        ok = (det != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1)
        heights.append(a[i, 1] + t[ok] * d[i, 1])
    out = [np.empty((0, 3, 2))]
    h = np.unique(np.concatenate(heights))
    for y0, y1 in zip(h[:-1], h[1:]):
        on = np.flatnonzero((a[:, 1] <= y0) & (b[:, 1] >= y1))
        at = lambda y: np.where(b[on, 1] == y, b[on, 0], a[on, 0] + (y - a[on, 1]) / d[on, 1] * d[on, 0])  # noqa: B023, E731
        lo, hi = at(y0), at(y1)
        order = np.lexsort((hi, lo + hi))
        lo, hi = lo[order], hi[order]
        for k in range(0, len(on) - 1, 2):
            c = np.array([[lo[k], y0], [lo[k + 1], y0], [hi[k + 1], y1], [hi[k], y1]])
            out.append(c[[[0, 1, 2], [0, 2, 3]]])
    t = np.concatenate(out)
    return t[_turn(t[:, 0], t[:, 1], t[:, 2]) > 0]


def triangulate(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles (n, 3, 2), turning left, of a polygon with holes, by ear clipping.

    Rings may start and turn anywhere; holes may touch the shell and each other in
    points. Rings without area are left out. Whether the ears cover the polygon
    is checked by its area; one that they do not cover, as its rings cross, lie
    apart or touch along a line, is cut into slabs by the even-odd rule instead.
    """
    shell = open_ring(np.asarray(rings[0], "f8")) if rings else np.empty((0, 2))
    if not len(shell):
        return np.empty((0, 3, 2))
    holes = [h for h in (open_ring(np.asarray(r, "f8"), left=False) for r in rings[1:]) if len(h)]
    whole = [shell, *holes]
    if holes:
        every = np.concatenate(whole)
        whole = [_touched(r, every) for r in whole]
    ring: np.ndarray | None = whole[0]
    for hole in sorted(whole[1:], key=lambda r: -r[:, 0].max()):
        ring = _bridge(ring, hole)
        if ring is None:
            break
    want = abs(signed_area(shell)) - sum(abs(signed_area(h)) for h in holes)
    if ring is not None:
        out = ring[np.array(_ears(ring), np.int64).reshape(-1, 3)]
        got = _turn(out[:, 0], out[:, 1], out[:, 2]).sum() / 2
        if abs(got - want) <= 1e-9 * abs(signed_area(shell)):
            return out
    return _slabs([shell, *holes])


def boxes_of(points: np.ndarray) -> np.ndarray:
    """Boxes (n, 4) as xmin, ymin, xmax, ymax of (n, k, 2)."""
    return np.concatenate([points.min(axis=1), points.max(axis=1)], axis=1)


class BoxTree:
    """A bounding-volume hierarchy over boxes, in arrays, level by level.

    Boxes are ordered by halving along the longer side of their centres; every
    node holds two of the level below. Many boxes are looked up at once.
    """

    LEAF = 8

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        order = np.arange(n)
        centre = (boxes[:, :2] + boxes[:, 2:]) / 2
        size = self.LEAF
        while size < n:
            size *= 2
        stack = [(0, n, size)]
        while stack:
            lo, hi, width = stack.pop()
            if hi - lo <= self.LEAF or width <= self.LEAF:
                continue
            part = centre[order[lo:hi]]
            axis = int(np.argmax(np.ptp(part, axis=0)))
            mid = lo + width // 2
            if mid < hi:
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid - lo)]
                stack += [(lo, mid, width // 2), (mid, hi, width // 2)]
            else:
                stack.append((lo, hi, width // 2))
        self.order, self.boxes = order, boxes[order]
        self.levels = []
        level = self.boxes
        step = self.LEAF
        while n:
            k = -(-len(level) // step)
            cut = np.arange(k) * step
            level = np.concatenate([np.minimum.reduceat(level[:, :2], cut), np.maximum.reduceat(level[:, 2:], cut)], axis=1)
            self.levels.append(level)
            if k == 1:
                break
            step = 2

    def query(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of the asked box, index of a box that meets it)."""
        none = np.empty(0, np.int64)
        if not len(self.order) or not len(boxes):
            return none, none

        def meets(q: np.ndarray, t: np.ndarray) -> np.ndarray:
            return (q[:, 0] <= t[:, 2]) & (t[:, 0] <= q[:, 2]) & (q[:, 1] <= t[:, 3]) & (t[:, 1] <= q[:, 3])

        ask, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            ok = meets(boxes[ask], level[node])
            ask, node = ask[ok], node[ok]
            fan = 2 if i else self.LEAF
            below = len(self.levels[i - 1]) if i else len(self.boxes)
            node = (node[:, None] * fan + np.arange(fan)).ravel()
            ask = np.repeat(ask, fan)
            ok = node < below
            ask, node = ask[ok], node[ok]
        ok = meets(boxes[ask], self.boxes[node])
        return ask[ok], self.order[node[ok]]


def clip_to_triangles(p: np.ndarray, q: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments ``p q`` (n, 2) and left-turning triangles (n, 3, 2), the
    range of the parameter that lies in the triangle, start >= end if none. A
    segment along a side counts if the side is the lower or left one, so that of
    two triangles sharing a side one has it."""
    d = q - p
    t0, t1 = np.zeros(len(p)), np.ones(len(p))
    for k in range(3):
        a, b = tri[:, k], tri[:, (k + 1) % 3]
        e = b - a
        side = e[:, 0] * (p[:, 1] - a[:, 1]) - e[:, 1] * (p[:, 0] - a[:, 0])  # at p; >= 0 inside
        rate = e[:, 0] * d[:, 1] - e[:, 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = -side / rate
        t0 = np.where(rate > 0, np.maximum(t0, t), t0)
        t1 = np.where(rate < 0, np.minimum(t1, t), t1)
        own = (e[:, 0] > 0) | ((e[:, 0] == 0) & (e[:, 1] < 0))
        out = (rate == 0) & ((side < 0) | ((side == 0) & ~own))
        t1 = np.where(out, t0 - 1, t1)
    return t0, t1


def points_in_triangles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """2 inside, 1 on a side, 0 outside; per row."""
    s = np.stack([_turn(tri[:, k], tri[:, (k + 1) % 3], p) for k in range(3)])
    low = s.min(axis=0)
    return np.where(low > 0, 2, np.where(low == 0, 1, 0))


def distance_to_triangles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Distance of points to triangles, 0 inside; per row."""
    best = np.full(len(p), np.inf)
    for k in range(3):
        a, e = tri[:, k], tri[:, (k + 1) % 3] - tri[:, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.nan_to_num(((p - a) * e).sum(axis=1) / (e * e).sum(axis=1))
        near = a + np.clip(t, 0, 1)[:, None] * e
        best = np.minimum(best, np.hypot(*(p - near).T))
    return np.where(points_in_triangles(p, tri) > 0, 0.0, best)
