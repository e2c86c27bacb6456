"""Exact overlay kernels on pairs of geometries, for Arrow batches."""

from __future__ import annotations

import numpy as np

from .planar import BoxTree, _turn, open_ring, polygon_area, signed_area, triangulate
from .wkb import EMPTY, Geometry, dumps, loads


def inside_rings(p: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd test of points (n, 2) against all rings of a polygon."""
    odd = np.zeros(len(p), bool)
    for r in rings:
        a, b = r[:-1], r[1:]
        x, y = p[:, :1], p[:, 1:]
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        odd ^= (spans & cross).sum(axis=1) % 2 == 1
    return odd


def on_rings(p: np.ndarray, rings: list[np.ndarray], tol: float = 1e-9) -> np.ndarray:
    """Whether points lie on a border, within a tolerance relative to its size."""
    hit = np.zeros(len(p), bool)
    for r in rings:
        a, e = r[:-1], np.diff(r, axis=0)
        l2 = np.maximum((e * e).sum(axis=1), 1e-300)
        t = np.clip(((p[:, None] - a) * e).sum(axis=2) / l2, 0, 1)
        gap = np.hypot(*np.moveaxis(p[:, None] - (a + t[..., None] * e), 2, 0))
        hit |= (gap <= tol * max(1.0, float(np.abs(r).max()))).any(axis=1)
    return hit


def clip_line(parts: list[np.ndarray], polygons: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Pieces of a line in closed polygons: a piece along a border counts."""
    pieces: list[np.ndarray] = []
    for part in parts:
        run: list[np.ndarray] = []
        for p, q in zip(part[:-1], part[1:]):
            d = q - p
            if not d.any():
                continue
            cuts = [0.0, 1.0]
            for rings in polygons:
                for r in rings:
                    a, e = r[:-1], np.diff(r, axis=0)
                    det = d[0] * e[:, 1] - d[1] * e[:, 0]
                    w = a - p
                    with np.errstate(divide="ignore", invalid="ignore"):
                        t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / det
                        s = (w[:, 0] * d[1] - w[:, 1] * d[0]) / det
                    ok = (det != 0) & (s >= -1e-12) & (s <= 1 + 1e-12) & (t > 0) & (t < 1)
                    cuts += t[ok].tolist()
                    # a parallel border has its ends as cuts
                    t = ((r - p) @ d) / (d @ d)
                    on = np.abs(d[0] * (r[:, 1] - p[1]) - d[1] * (r[:, 0] - p[0])) <= 1e-12 * max(1.0, np.abs(r).max()) * np.abs(d).max()
                    cuts += t[on & (t > 0) & (t < 1)].tolist()
            t = np.unique(cuts)
            keep = np.diff(t, append=2.0) > 1e-12
            t = t[keep]
            mid = p + ((t[:-1] + t[1:]) / 2)[:, None] * d
            held = np.zeros(len(mid), bool)
            for rings in polygons:
                held |= inside_rings(mid, rings) | on_rings(mid, rings)
            for k in np.flatnonzero(held):
                a = p if t[k] == 0 else p + t[k] * d
                b = q if t[k + 1] == 1 else p + t[k + 1] * d
                if run and (run[-1] == a).all():
                    run.append(b)
                else:
                    if len(run) > 1:
                        pieces.append(np.array(run))
                    run = [a, b]
        if len(run) > 1:
            pieces.append(np.array(run))
    return pieces


def line_in_polygon(line: Geometry, poly: Geometry) -> Geometry:
    if line[0] != "line" or poly[0] != "polygon":
        return EMPTY
    pieces = clip_line(line[1], poly[1])
    return ("line", pieces) if pieces else EMPTY


def is_convex(ring: np.ndarray) -> bool:
    r = open_ring(ring)
    return len(r) > 2 and bool((_turn(r, np.roll(r, -1, 0), np.roll(r, -2, 0)) >= 0).all())


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Intersection of two convex rings that turn left; empty if it has no area."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, after = np.roll(out, -1, axis=0), np.roll(side, -1)
        made = []
        for p, q, s, t in zip(out, nxt, side, after):
            if s >= 0:
                made.append(p)
            if (s > 0 > t) or (s < 0 < t):
                made.append(p + (q - p) * (s / (s - t)))
        out = np.array(made).reshape(-1, 2)
    out = open_ring(out) if len(out) > 2 else out[:0]
    return out


def _convex_parts(part: list[np.ndarray]) -> list[np.ndarray]:
    if len(part) == 1 and is_convex(part[0]):
        return [open_ring(part[0])]
    return list(triangulate(part))


def polygon_overlap(a: Geometry, b: Geometry) -> Geometry:
    """Intersection of polygons with area. Of convex ones it is one ring; else it
    is covered without overlap by convex parts."""
    if a[0] != "polygon" or b[0] != "polygon":
        return EMPTY
    out = []
    pb = [(q, q.min(axis=0), q.max(axis=0)) for part in b[1] for q in _convex_parts(part)]
    for part in a[1]:
        for p in _convex_parts(part):
            lo, hi = p.min(axis=0), p.max(axis=0)
            for q, qlo, qhi in pb:
                if (lo < qhi).all() and (qlo < hi).all():
                    r = clip_convex(p, q)
                    if len(r):
                        out.append([np.vstack([r, r[:1]])])
    return ("polygon", out) if out else EMPTY


def area(g: Geometry) -> float:
    return float(sum(polygon_area(p) for p in g[1])) if g[0] == "polygon" else 0.0


def length(g: Geometry) -> float:
    return float(sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in g[1])) if g[0] == "line" else 0.0


def _segments(g: Geometry) -> np.ndarray:
    rings = [r for p in g[1] for r in p] if g[0] == "polygon" else g[1]
    return np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings]) if rings else np.empty((0, 4))


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether two geometries share a point; borders count."""
    if "empty" in (a[0], b[0]):
        return False
    if "mixed" in (a[0], b[0]):
        m, o = (a, b) if a[0] == "mixed" else (b, a)
        return any(intersects(x, o) for x in m[1])
    if a[0] == "polygon" and b[0] != "polygon":
        a, b = b, a
    if b[0] == "polygon":
        first = a[1][0][0] if a[0] == "polygon" else a[1][0]
        if any((inside_rings(np.atleast_2d(first)[:1], r) | on_rings(np.atleast_2d(first)[:1], r))[0] for r in b[1]):
            return True
        if a[0] == "point":
            return any((inside_rings(p, r) | on_rings(p, r)).any() for p in a[1] for r in b[1])
        if a[0] == "polygon" and any(inside_rings(b[1][0][0][:1], r)[0] for r in a[1]):
            return True
    if a[0] == "point" or b[0] == "point":
        pts, other = (a, b) if a[0] == "point" else (b, a)
        return any(on_rings(p, [r]).any() for p in pts[1] for r in other[1]) if other[0] == "line" else any((p == q).all() for p in pts[1] for q in other[1])
    s, t = _segments(a), _segments(b)
    p, q, u, v = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    d1, d2, d3, d4 = _turn(u, v, p), _turn(u, v, q), _turn(p, q, u), _turn(p, q, v)
    cross = (d1 * d2 <= 0) & (d3 * d4 <= 0)
    overlap = (np.maximum(np.minimum(p, q), np.minimum(u, v)) <= np.minimum(np.maximum(p, q), np.maximum(u, v))).all(axis=2)
    return bool((cross & overlap).any())


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull as an open ring that turns left; fewer points if flat."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def centroid(g: Geometry) -> tuple[float, float] | None:
    if g[0] == "polygon":
        sx = sy = total = 0.0
        for part in g[1]:
            for i, r in enumerate(part):
                r = open_ring(r, left=i == 0)
                if len(r):
                    for t in triangulate([r]):
                        w = signed_area(t) * (1 if i == 0 else -1)
                        sx, sy, total = sx + w * t[:, 0].mean(), sy + w * t[:, 1].mean(), total + w
        return (sx / total, sy / total) if total else None
    if g[0] == "line":
        s = _segments(g)
        w = np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1])
        return (float(((s[:, 0] + s[:, 2]) / 2 * w).sum() / w.sum()), float(((s[:, 1] + s[:, 3]) / 2 * w).sum() / w.sum())) if w.sum() else None
    if g[0] == "point":
        p = np.concatenate(g[1]).mean(axis=0)
        return float(p[0]), float(p[1])
    return None


def buffer_convex(ring: np.ndarray, by: float, steps: int = 16) -> np.ndarray:
    """A convex ring widened by ``by``: the hull of circles around its points."""
    a = np.arange(4 * steps) * (np.pi / (2 * steps))
    circle = by * np.stack([np.cos(a), np.sin(a)], axis=1)
    return hull((ring[:, None] + circle).reshape(-1, 2))


def boundary(g: Geometry) -> Geometry:
    """The rings of polygons as lines, the ends of open lines as points."""
    if g[0] == "polygon":
        return ("line", [r for p in g[1] for r in p])
    if g[0] == "line":
        ends = [p[[k]] for p in g[1] if (p[0] != p[-1]).any() for k in (0, -1)]
        return ("point", ends) if ends else EMPTY
    return EMPTY


def representative_point(g: Geometry) -> tuple[float, float] | None:
    """A point that lies in the geometry: of polygons the middle of the widest
    stretch at half their height, of lines their middle corner."""
    if g[0] == "mixed":
        return representative_point(g[1][0])
    if g[0] == "polygon":
        part = max(g[1], key=polygon_area)
        y = np.sort(np.unique(part[0][:, 1]))
        at = (y[(len(y) - 1) // 2] + y[len(y) // 2]) / 2 if len(y) % 2 == 0 else (y[len(y) // 2 - 1] + y[len(y) // 2]) / 2 if len(y) > 1 else y[0]
        a, b = np.concatenate([r[:-1] for r in part]), np.concatenate([r[1:] for r in part])
        on = (a[:, 1] > at) != (b[:, 1] > at)
        x = np.sort(a[on, 0] + (at - a[on, 1]) / (b[on, 1] - a[on, 1]) * (b[on, 0] - a[on, 0]))
        if len(x) < 2:
            return float(part[0][0, 0]), float(part[0][0, 1])
        k = 2 * int(np.argmax(x[1::2] - x[: len(x) // 2 * 2 : 2]))
        return float((x[k] + x[k + 1]) / 2), float(at)
    if g[0] in ("line", "point"):
        p = max(g[1], key=len)
        return float(p[len(p) // 2][0]), float(p[len(p) // 2][1])
    return None


# -- union --------------------------------------------------------------------------


def _elementary(seg: np.ndarray, tol: float) -> np.ndarray:
    """The different parts of segments (n, 4) between the points where they meet."""
    boxes = np.concatenate([np.minimum(seg[:, :2], seg[:, 2:]) - tol, np.maximum(seg[:, :2], seg[:, 2:]) + tol], axis=1)
    i, j = BoxTree(boxes).query(boxes)
    i, j = i[i < j], j[i < j]
    p, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    size = np.hypot(*d.T)
    who, at = [np.arange(len(seg)), np.arange(len(seg))], [np.zeros(len(seg)), np.ones(len(seg))]
    det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    w = p[j] - p[i]
    across = np.abs(det) > 1e-12 * size[i] * size[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, s = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / det, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / det
    ok = across & (t > -tol / size[i]) & (t < 1 + tol / size[i]) & (s > -tol / size[j]) & (s < 1 + tol / size[j])
    who += [i[ok], j[ok]]
    at += [t[ok], s[ok]]
    for a, b in ((i, j), (j, i)):  # ends of one on the other
        for end in (seg[b, :2], seg[b, 2:]):
            v = end - p[a]
            along = (v * d[a]).sum(axis=1) / size[a] ** 2
            off = np.abs(v[:, 0] * d[a, 1] - v[:, 1] * d[a, 0]) / size[a]
            on = (off <= tol) & (along > 0) & (along < 1)
            who.append(a[on])
            at.append(along[on])
    who, at = np.concatenate(who), np.clip(np.concatenate(at), 0.0, 1.0)
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    pts = np.round((p[who] + at[:, None] * d[who]) / tol) * tol
    one = (who[1:] == who[:-1]) & (pts[1:] != pts[:-1]).any(axis=1)
    a, b = pts[:-1][one], pts[1:][one]
    back = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    return np.unique(np.concatenate([np.where(back[:, None], b, a), np.where(back[:, None], a, b)], axis=1), axis=0)


def union(polygons: list[Geometry]) -> Geometry:
    """The union of polygons, without overlaps and inner borders.

    All sides are cut where they meet; those with the union on one side only are
    its border and are chained into rings with the union on their left. Points
    closer than a thousand millionth of the extent are one.
    """
    parts = [[r for r in (open_ring(np.asarray(r, "f8")) for r in part) if len(r)] for g in polygons if g and g[0] == "polygon" for part in g[1]]
    parts = [p for p in parts if p]
    if not parts:
        return EMPTY
    points = np.concatenate([r for part in parts for r in part])
    extent = float(max(np.ptp(points, axis=0).max(), np.abs(points).max() * 1e-3, 1e-12))
    tol = 2.0 ** np.ceil(np.log2(extent * 1e-9))
    closed = [[np.vstack([r, r[:1]]) for r in part] for part in parts]
    e = _elementary(np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for part in closed for r in part]), tol)
    a, b = e[:, :2], e[:, 2:]
    d = b - a
    side = 8 * tol * np.stack([-d[:, 1], d[:, 0]], axis=1) / np.hypot(*d.T)[:, None]
    middle = (a + b) / 2
    covered = np.zeros((2, len(e)), bool)
    for part in closed:
        lo, hi = part[0].min(axis=0) - 16 * tol, part[0].max(axis=0) + 16 * tol
        near = np.flatnonzero(((middle >= lo) & (middle <= hi)).all(axis=1) & ~covered.all(axis=0))
        for k, sign in enumerate((1, -1)):
            for c in range(0, len(near), 2000):
                m = near[c : c + 2000]
                covered[k, m] |= inside_rings(middle[m] + sign * side[m], part)
    border = covered[0] != covered[1]
    flip = covered[1][border]
    a, b = np.where(flip[:, None], b[border], a[border]), np.where(flip[:, None], a[border], b[border])
    return _chained(a, b)


def _chained(a: np.ndarray, b: np.ndarray) -> Geometry:
    """Polygons of directed sides with the inside on their left. Where several
    leave a point, the first one clockwise of the way back is taken, so rings that
    touch in a point stay apart."""
    out: dict[tuple, list[int]] = {}
    for k, q in enumerate(a.tolist()):
        out.setdefault(tuple(q), []).append(k)
    angle = np.arctan2(b[:, 1] - a[:, 1], b[:, 0] - a[:, 0])
    left, rings = set(range(len(a))), []
    ends = [tuple(q) for q in b.tolist()]
    while left:
        k = first = min(left)
        ring = []
        while True:
            left.discard(k)
            ring.append(k)
            onward = [m for m in out.get(ends[k], ()) if m in left or m == first]
            if not onward:
                break
            back = angle[k] + np.pi
            k = min(onward, key=lambda m: (back - angle[m]) % (2 * np.pi) or 2 * np.pi)
            if k == first:
                break
        p = a[ring]
        keep = np.abs(_turn(np.roll(p, 1, axis=0), p, np.roll(p, -1, axis=0))) > 1e-12 * np.abs(np.ptp(p, axis=0)).max() ** 2
        p = p[keep]
        if len(p) > 2:
            rings.append(p)
    shells = [r for r in rings if signed_area(r) > 0]
    out_parts = [[np.vstack([r, r[:1]])] for r in shells]
    for h in (r for r in rings if signed_area(r) < 0):
        inside = [i for i, s in enumerate(out_parts) if (s[0].min(axis=0) <= h.min(axis=0)).all() and (s[0].max(axis=0) >= h.max(axis=0)).all() and inside_rings((h + np.roll(h, -1, axis=0)) / 2, s[:1]).mean() > 0.5]
        if inside:
            out_parts[min(inside, key=lambda i: signed_area(shells[i]))].append(np.vstack([h, h[:1]]))
    return ("polygon", out_parts) if out_parts else EMPTY


def buffer(g: Geometry, by: float, steps: int = 16) -> Geometry:
    """A polygon or line widened by ``by``, with round corners: the union of the
    polygon and of its widened sides."""
    if g[0] == "empty" or by <= 0:
        return g
    if g[0] == "mixed":
        return union([buffer(x, by, steps) for x in g[1]])
    if g[0] == "polygon" and len(g[1]) == 1 and len(g[1][0]) == 1 and is_convex(g[1][0][0]):
        r = buffer_convex(open_ring(g[1][0][0]), by, steps)
        return ("polygon", [[np.vstack([r, r[:1]])]])
    sides = _segments(g) if g[0] != "point" else np.concatenate([np.concatenate(g[1]), np.concatenate(g[1])], axis=1)
    wide = [buffer_convex(s.reshape(2, 2), by, steps) for s in sides]
    return union([("polygon", [[np.vstack([r, r[:1]])] for r in wide]), *([g] if g[0] == "polygon" else [])])


# -- whole batches ---------------------------------------------------------------

_LINE = b"\x01\x02\x00\x00\x00"
_POLYGON = b"\x01\x03\x00\x00\x00\x01\x00\x00\x00"


def _simple_line(w: bytes) -> np.ndarray | None:
    """Points of a little-endian two-dimensional line, the common case."""
    if w and w[:5] == _LINE and len(w) > 9:
        return np.frombuffer(w, "<f8", offset=9).reshape(-1, 2)
    return None


def bounds(g: Geometry | None) -> tuple[float, float, float, float] | None:
    if g is None or g[0] == "empty":
        return None
    if g[0] == "mixed":
        b = np.array([bounds(x) for x in g[1]])
        return (*b[:, :2].min(axis=0), *b[:, 2:].max(axis=0))
    p = np.concatenate([r for x in g[1] for r in (x if g[0] == "polygon" else [x])])
    return (*p.min(axis=0), *p.max(axis=0))


def wkb_boxes(wkb: list[bytes | None]) -> np.ndarray:
    """Boxes (n, 4) of geometries, NaN for those without a point. Plain lines and
    polygons of one ring are measured together."""
    out = np.full((len(wkb), 4), np.nan)
    at, size, flat, rest = [], [], [], []
    for i, w in enumerate(wkb):
        if w:
            if w[:5] == _LINE and len(w) > 9:
                at.append(i), size.append((len(w) - 9) // 16), flat.append(w[9:])
            elif w[:9] == _POLYGON and len(w) > 13 and len(w) == 13 + 16 * int.from_bytes(w[9:13], "little"):
                at.append(i), size.append((len(w) - 13) // 16), flat.append(w[13:])
            else:
                rest.append(i)
    if at:
        p = np.frombuffer(b"".join(flat), "<f8").reshape(-1, 2)
        cut = np.cumsum(size) - size
        box = np.concatenate([np.minimum.reduceat(p, cut), np.maximum.reduceat(p, cut)], axis=1)
        box[~np.isfinite(box).all(axis=1)] = np.nan
        out[at] = box
    for i in rest:
        got = bounds(loads(wkb[i]))
        if got is not None:
            out[i] = got
    return out


class Area:
    """A polygon made ready for many others: its convex ring if it is one, and a
    tree over its border."""

    def __init__(self, wkb: bytes):
        self.geometry = loads(wkb)
        self.ok = self.geometry is not None and self.geometry[0] == "polygon"
        only = self.geometry[1][0][0] if self.ok and len(self.geometry[1]) == 1 and len(self.geometry[1][0]) == 1 else None
        self.ring = open_ring(only) if only is not None and is_convex(only) else None
        self._border: BoxTree | None = None

    def crossed(self, boxes: np.ndarray) -> np.ndarray:
        """Which boxes meet the box of a side; others lie whole inside or outside."""
        if self._border is None:
            s = _segments(self.geometry)
            self._border = BoxTree(np.concatenate([np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])], axis=1))
        out = np.zeros(len(boxes), bool)
        for k in range(0, len(boxes), 1000):
            out[k + np.unique(self._border.query(boxes[k : k + 1000])[0])] = True
        return out

    def holds(self, points: np.ndarray) -> np.ndarray:
        odd = np.zeros(len(points), bool)
        for rings in self.geometry[1]:
            odd |= inside_rings(points, rings)
        return odd


class Areas:
    """Polygons by number; each is read when it is first met."""

    def __init__(self, wkb: list[bytes | None]):
        self.wkb = wkb
        self._read: dict[int, Area] = {}
        self.box, self.upright = _rectangles(wkb)

    def __getitem__(self, k: int) -> Area:
        return self._read.get(k) or self._read.setdefault(k, Area(self.wkb[k]))

    @classmethod
    def of(cls, wkb: list[bytes | None]) -> tuple[Areas, np.ndarray]:
        """The different ones, and the number of each."""
        seen: dict[bytes | None, int] = {}
        which = np.array([seen.setdefault(w, len(seen)) for w in wkb], np.int64)
        return cls(list(seen)), which


def _by_area(which: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(which, kind="stable")
    at = np.flatnonzero(np.diff(which[order])) + 1
    return [(int(which[m[0]]), m) for m in np.split(order, at)] if len(order) else []


Pieces = tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]


def lines_in_areas(lines: list[bytes | None], areas: Areas, which: np.ndarray) -> Pieces:
    """For pairs of a line and the number of an area: which have a piece, the
    pieces, the lengths of the lines and of the pieces. Lines that meet one convex
    polygon are clipped together; of other polygons the lines that come near no
    side are in or out as their first point is, and only the rest goes one by one.
    """
    n = len(lines)
    whole, part = np.zeros(n), np.zeros(n)
    piece: list[bytes | None] = [None] * n
    for k, members in _by_area(which):
        poly = areas[k]
        if not poly.ok:
            continue
        pts = {i: p for i in members.tolist() if (p := _simple_line(lines[i])) is not None and len(p) > 1}
        if poly.ring is not None and pts:
            size = np.array([len(p) - 1 for p in pts.values()])
            a, b = np.concatenate([p[:-1] for p in pts.values()]), np.concatenate([p[1:] for p in pts.values()])
            t0, t1 = _clip_convex_segments(a, b, poly.ring)
            seg = np.hypot(*(b - a).T)
            at = np.cumsum(size) - size
            inner = np.add.reduceat(np.maximum(t1 - t0, 0) * seg, at)
            total = np.add.reduceat(seg, at)
            s, e = a + t0[:, None] * (b - a), a + t1[:, None] * (b - a)
            s[t0 == 0], e[t1 == 1] = a[t0 == 0], b[t1 == 1]
            for j, i in enumerate(pts):
                whole[i] = total[j]
                if inner[j] > 0:
                    part[i] = inner[j]
                    lo, hi = at[j], at[j] + size[j]
                    if hi - lo == 1:
                        piece[i] = _TWO + np.array([s[lo], e[lo]]).tobytes()
                    else:
                        piece[i] = dumps(("line", _joined(s[lo:hi], e[lo:hi], (t1 - t0)[lo:hi] > 0)))
            members = np.array([i for i in members.tolist() if i not in pts], np.int64)
        elif poly.ring is None and pts:
            own = np.array(list(pts))
            clear = ~poly.crossed(wkb_boxes([lines[i] for i in own])) & np.array([bool(np.isfinite(p).all()) for p in pts.values()])
            held = np.zeros(len(own), bool)
            held[clear] = poly.holds(np.array([pts[i][0] for i in own[clear].tolist()]).reshape(-1, 2))
            for i in own[held].tolist():
                total = float(np.hypot(*np.diff(pts[i], axis=0).T).sum())
                if total > 0:
                    whole[i], part[i], piece[i] = total, total, bytes(lines[i])
            members = np.setdiff1d(members, own[clear])
        for i in members.tolist():
            line = loads(lines[i])
            if line is not None and line[0] == "line":
                got = line_in_polygon(line, poly.geometry)
                whole[i] = length(line)
                if got[0] != "empty":
                    part[i], piece[i] = length(got), dumps(got)
    keep = np.array([p is not None for p in piece], bool)
    return keep, [p for p in piece if p is not None], whole[keep], part[keep]


_TWO = _LINE + b"\x02\x00\x00\x00"
_RECTANGLE = _POLYGON + b"\x05\x00\x00\x00"


def _rectangles(wkb: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of upright rectangles among WKB polygons, and which those are."""
    ok = np.array([w is not None and len(w) == 93 and w[:13] == _RECTANGLE for w in wkb], bool)
    box = np.zeros((len(wkb), 4))
    if ok.any():
        ring = np.frombuffer(b"".join(w[13:] for w, o in zip(wkb, ok) if o), "<f8").reshape(-1, 5, 2)
        lo, hi = ring.min(axis=1), ring.max(axis=1)
        corner = ((ring == lo[:, None]) | (ring == hi[:, None])).all(axis=(1, 2))
        step = np.diff(ring, axis=1) != 0
        upright = corner & (step.sum(axis=2) == 1).all(axis=1) & (step[:, :-1, 0] != step[:, 1:, 0]).all(axis=1) & (hi > lo).all(axis=1)
        at = np.flatnonzero(ok)
        box[at] = np.concatenate([lo, hi], axis=1)
        ok[at] = upright
    return box, ok


def polygons_in_areas(left: list[bytes | None], areas: Areas, which: np.ndarray) -> Pieces:
    """As :func:`lines_in_areas`, by area. Pairs of upright rectangles, as grids
    are, are cut together; polygons that come near no side of the other are whole
    inside or outside; only the rest is cut one by one."""
    n = len(left)
    a, oka = _rectangles(left)
    b, okb = areas.box[which], areas.upright[which]
    both = oka & okb
    lo, hi = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:], b[:, 2:])
    whole = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])
    part = np.where(both & (hi > lo).all(axis=1), (hi - lo).prod(axis=1), 0.0)
    piece: list[bytes | None] = [None] * n
    at = np.flatnonzero(part > 0)
    x0, y0, x1, y1 = lo[at, 0], lo[at, 1], hi[at, 0], hi[at, 1]
    rings = np.ascontiguousarray(np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1), "<f8")
    for k, i in enumerate(at):
        piece[i] = _RECTANGLE + rings[k].tobytes()
    slow = np.flatnonzero(~both)
    for k, m in _by_area(which[slow]):
        poly, members = areas[k], slow[m]
        if not poly.ok:
            continue
        box = wkb_boxes([left[i] for i in members])
        clear = ~np.isnan(box[:, 0])
        clear[clear] = ~poly.crossed(box[clear])
        for i, free in zip(members.tolist(), clear):
            ga = loads(left[i])
            if ga is None or ga[0] != "polygon":
                continue
            if free:
                if poly.holds(ga[1][0][0][:1])[0] and area(ga) > 0:
                    whole[i] = part[i] = area(ga)
                    piece[i] = bytes(left[i])
                continue
            got = polygon_overlap(ga, poly.geometry)
            if got[0] != "empty":
                whole[i], part[i], piece[i] = area(ga), area(got), dumps(got)
    keep = np.array([p is not None for p in piece], bool)
    return keep, [p for p in piece if p is not None], whole[keep], part[keep]


def meeting_areas(left: list[bytes | None], areas: Areas, which: np.ndarray) -> np.ndarray:
    """Which pairs share a point, borders included. Plain lines against one convex
    polygon are tested together. The areas may also be lines or points."""
    hit = np.zeros(len(left), bool)
    for k, members in _by_area(which):
        if areas.wkb[k] is None:
            continue
        g = areas[k]
        if g.geometry is None:
            continue
        pts = [_simple_line(left[i]) if g.ring is not None else None for i in members]
        fast = [(i, p) for i, p in zip(members.tolist(), pts) if p is not None and len(p) > 1 and np.isfinite(p).all()]
        if fast:
            size = np.array([len(p) - 1 for _, p in fast])
            a, b = np.concatenate([p[:-1] for _, p in fast]), np.concatenate([p[1:] for _, p in fast])
            t0, t1 = _range_in_convex(a, b, g.ring)
            hit[[i for i, _ in fast]] = np.logical_or.reduceat(t1 >= t0, np.cumsum(size) - size)
        done = {i for i, _ in fast}
        for i in members.tolist():
            if i not in done and left[i]:
                other = loads(left[i])
                hit[i] = other is not None and intersects(other, g.geometry)
    return hit


def lines_in_polygons(lines: list[bytes | None], polygons: list[bytes | None]) -> Pieces:
    return lines_in_areas(lines, *Areas.of(polygons))


def polygons_in_polygons(left: list[bytes | None], right: list[bytes | None]) -> Pieces:
    return polygons_in_areas(left, *Areas.of(right))


def meeting(left: list[bytes | None], right: list[bytes | None]) -> np.ndarray:
    return meeting_areas(left, *Areas.of(right))


def _clip_convex_segments(p: np.ndarray, q: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the parameter of each segment within a closed convex ring, empty
    for touches, which have no length."""
    t0, t1 = _range_in_convex(p, q, ring)
    return t0, np.where(t1 - t0 > 1e-12, t1, t0)


def _range_in_convex(p: np.ndarray, q: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = q - p
    t0, t1 = np.zeros(len(p)), np.ones(len(p))
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        e = b - a
        side = e[0] * (p[:, 1] - a[1]) - e[1] * (p[:, 0] - a[0])
        rate = e[0] * d[:, 1] - e[1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = -side / rate
        t0 = np.where(rate > 0, np.maximum(t0, t), t0)
        t1 = np.where(rate < 0, np.minimum(t1, t), t1)
        t1 = np.where((rate == 0) & (side < 0), -1.0, t1)
    return t0, t1


def _joined(s: np.ndarray, e: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """Consecutive held pieces of a line put together."""
    out: list[list[np.ndarray]] = []
    for a, b, ok in zip(s, e, held):
        if ok:
            if out and (out[-1][-1] == a).all():
                out[-1].append(b)
            else:
                out.append([a, b])
    return [np.array(x) for x in out]
