"""Well-known binary and text of plane geometries.

A geometry is ``(kind, parts)``:

* ``point``: one array of shape (1, 2); ``line``: arrays of shape (n, 2), one per
  part; ``polygon``: per part a list of rings, the shell first, closed;
* ``empty``: an empty geometry of any type, with no parts;
* ``mixed``: a collection of several dimensions, as a list of geometries.
"""

from __future__ import annotations

import struct

import numpy as np

Geometry = tuple[str, list]
EMPTY: Geometry = ("empty", [])
#: An empty geometry collection, the geometry of rows that have none.
EMPTY_WKB = struct.pack("<BII", 1, 7, 0)


def loads(b: bytes | None) -> Geometry | None:
    """The geometry of WKB in either byte order; Z, M and SRID are read over.
    None for null, for no bytes and for what cannot be read."""
    if not b:
        return None
    try:
        return _read(bytes(b), 0)[0]
    except (struct.error, ValueError, LookupError, RecursionError):
        return None


def _read(b: bytes, o: int) -> tuple[Geometry, int]:
    e = "<" if b[o] == 1 else ">"
    code = struct.unpack_from(e + "I", b, o + 1)[0]
    o += 5
    dims = 2
    if code & 0x20000000:  # an SRID follows
        o += 4
    if code & 0x80000000:
        dims += 1
    if code & 0x40000000:
        dims += 1
    code &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    code %= 1000

    def points(n: int) -> np.ndarray:
        nonlocal o
        a = np.frombuffer(b, e + "f8", n * dims, o).reshape(n, dims)[:, :2].astype("f8")
        o += 8 * n * dims
        if code != 1 and not np.isfinite(a).all():
            raise ValueError("a coordinate is no number")
        return a

    def count() -> int:
        nonlocal o
        n = struct.unpack_from(e + "I", b, o)[0]
        o += 4
        return n

    if code == 1:
        p = points(1)
        return (EMPTY if np.isnan(p).any() else ("point", [p])), o
    if code == 2:
        p = points(count())
        return (("line", [p]) if len(p) else EMPTY), o
    if code == 3:
        rings = [points(count()) for _ in range(count())]
        rings = [r for r in rings if len(r)]
        return (("polygon", [rings]) if rings else EMPTY), o
    if code in (4, 5, 6, 7):
        members = []
        for _ in range(count()):
            g, o = _read(b, o)
            members.append(g)
        return collect(members), o
    raise ValueError(f"geometry type {code}")


def collect(members: list[Geometry]) -> Geometry:
    """One geometry of several: of one dimension if they all are."""
    members = [g for g in members if g[0] != "empty"]
    kinds = {g[0] for g in members}
    if not members:
        return EMPTY
    if len(kinds) == 1 and "mixed" not in kinds:
        return members[0][0], [p for g in members for p in g[1]]
    return "mixed", members


def _points(p: np.ndarray) -> bytes:
    return struct.pack("<I", len(p)) + np.ascontiguousarray(p, "<f8").tobytes()


def _one(kind: str, part) -> bytes:
    if kind == "point":
        return struct.pack("<BI", 1, 1) + np.ascontiguousarray(part, "<f8").tobytes()
    if kind == "line":
        return struct.pack("<BI", 1, 2) + _points(part)
    return struct.pack("<BII", 1, 3, len(part)) + b"".join(_points(r) for r in part)


def dumps(g: Geometry | None) -> bytes | None:
    """Little-endian WKB; several parts make a multi-geometry."""
    if g is None:
        return None
    kind, parts = g
    if kind == "empty":
        return EMPTY_WKB
    if kind == "mixed":
        return struct.pack("<BII", 1, 7, len(parts)) + b"".join(dumps(p) for p in parts)
    if len(parts) == 1:
        return _one(kind, parts[0])
    code = {"point": 4, "line": 5, "polygon": 6}[kind]
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(_one(kind, p) for p in parts)


def _num(x: float) -> str:
    return f"{x:.15g}"


def _seq(p: np.ndarray) -> str:
    return "(" + ", ".join(f"{_num(x)} {_num(y)}" for x, y in p) + ")"


def to_wkt(g: Geometry | None) -> str | None:
    if g is None:
        return None
    kind, parts = g
    if kind == "empty":
        return "GEOMETRYCOLLECTION EMPTY"
    if kind == "mixed":
        return "GEOMETRYCOLLECTION (" + ", ".join(to_wkt(p) for p in parts) + ")"
    texts = ["(" + ", ".join(_seq(r) for r in p) + ")" if kind == "polygon" else _seq(p) for p in parts]
    name = {"point": "POINT", "line": "LINESTRING", "polygon": "POLYGON"}[kind]
    return f"{name} {texts[0]}" if len(parts) == 1 else f"MULTI{name} ({', '.join(texts)})"


def from_rings(*rings) -> bytes:
    """WKB of one polygon from its rings, closed if they are not."""
    out = []
    for r in rings:
        r = np.asarray(r, "f8")
        out.append(r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]))
    return dumps(("polygon", [out]))


def from_line(*parts) -> bytes:
    return dumps(("line", [np.asarray(p, "f8") for p in parts]))


def line_parts(b: bytes | None) -> list[np.ndarray]:
    """Parts of a line geometry with at least two points; none otherwise."""
    g = loads(b)
    return [p for p in g[1] if len(p) > 1] if g and g[0] == "line" else []


def line_length(parts: list[np.ndarray]) -> float:
    return float(sum(np.hypot(*np.diff(p, axis=0).T).sum() for p in parts))


def open_polygons(rings: list[np.ndarray]) -> Geometry:
    """Polygons from loose rings: those that turn right are shells, the others
    holes of the shell whose box holds them."""
    def turn(r: np.ndarray) -> float:
        return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())

    shells = [[r] for r in rings if turn(r) <= 0]
    for h in (r for r in rings if turn(r) > 0):
        lo, hi = h.min(axis=0), h.max(axis=0)
        home = [s for s in shells if (s[0].min(axis=0) <= lo).all() and (s[0].max(axis=0) >= hi).all()]
        if home:
            min(home, key=lambda s: float(np.prod(np.ptp(s[0], axis=0)))).append(h)
        else:
            shells.append([h])
    return ("polygon", shells) if shells else EMPTY
