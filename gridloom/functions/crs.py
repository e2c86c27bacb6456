"""Reference systems: degrees, web Mercator and UTM, in closed form or series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wkb import Geometry, dumps, loads

# Ellipsoid GRS80/WGS84 and the transverse Mercator scale.
_A, _F, _K0 = 6378137.0, 1 / 298.257222101, 0.9996
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]


def _utm_zone(epsg: int) -> tuple[int, bool] | None:
    """Zone and whether it is southern, of UTM systems on WGS84 or NAD83."""
    base, zone = divmod(epsg, 100)
    if base in (326, 327) and 1 <= zone <= 60:
        return zone, base == 327
    return (zone, False) if base == 269 and 1 <= zone <= 23 else None


def known(epsg: int) -> bool:
    return epsg in (4326, 4269, 3857) or _utm_zone(epsg) is not None


def _to_degrees(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg in (4326, 4269):
        return x, y
    if epsg == 3857:
        return np.degrees(x / _A), np.degrees(2 * np.arctan(np.exp(y / _A)) - np.pi / 2)
    zone, south = _utm_zone(epsg)
    xi, eta = (y - (1e7 if south else 0)) / (_K0 * _RECT), (x - 5e5) / (_K0 * _RECT)
    xi1 = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    eta1 = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    e = np.sqrt(_F * (2 - _F))
    tau1 = np.sin(xi1) / np.hypot(np.sinh(eta1), np.cos(xi1))
    tau = tau1
    for _ in range(6):  # conformal to geographic latitude
        s = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        f = tau * np.hypot(1, s) - s * np.hypot(1, tau)
        tau = tau + (tau1 - f) / np.hypot(1, f) * (1 + (1 - e * e) * tau**2) / ((1 - e * e) * np.hypot(1, tau))
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(eta1), np.cos(xi1))), np.degrees(np.arctan(tau))


def _from_degrees(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg in (4326, 4269):
        return lon, lat
    if epsg == 3857:
        return _A * np.radians(lon), _A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    zone, south = _utm_zone(epsg)
    e = np.sqrt(_F * (2 - _F))
    phi, lam = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi1, eta1 = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    xi = xi1 + sum(a * np.sin(2 * j * xi1) * np.cosh(2 * j * eta1) for j, a in enumerate(_ALPHA, 1))
    eta = eta1 + sum(a * np.cos(2 * j * xi1) * np.sinh(2 * j * eta1) for j, a in enumerate(_ALPHA, 1))
    return 5e5 + _K0 * _RECT * eta, (1e7 if south else 0) + _K0 * _RECT * xi


def transform(x, y, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates from one system to another; datum shifts of less than two
    metres between WGS84 and NAD83 are left out."""
    for e in (source, target):
        if not known(e):
            raise ValueError(f"EPSG:{e} is not known; 4326, 4269, 3857 and UTM (326xx, 327xx, 269xx) are")
    x, y = np.asarray(x, "f8"), np.asarray(y, "f8")
    return (x, y) if source == target else _from_degrees(*_to_degrees(x, y, source), target)


def transform_geometry(g: Geometry | None, source: int, target: int) -> Geometry | None:
    if g is None or g[0] == "empty":
        return g
    if g[0] == "mixed":
        return "mixed", [transform_geometry(x, source, target) for x in g[1]]
    one = lambda p: np.stack(transform(p[:, 0], p[:, 1], source, target), axis=1)
    return g[0], [[one(r) for r in p] if g[0] == "polygon" else one(p) for p in g[1]]


def transform_column(df: DataFrame, source: int, target: int, column: str = "geometry") -> DataFrame:
    """``df`` with its WKB column in another system."""
    transform([0.0], [0.0], source, target)  # unknown systems fail here, at plan time
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved = pa.array([dumps(transform_geometry(loads(w), source, target)) for w in b.column(at).to_pylist()], pa.binary())
            yield b.set_column(at, b.schema.field(at).name, moved)

    return df.mapInArrow(run, df.schema)


def metres_to_degrees(lon: float, lat: float, utm: int, metres: float) -> float:
    """Mean of the steps east and north that ``metres`` make at a place."""
    x, y = transform([lon], [lat], 4326, utm)
    east, north = transform(x + metres, y, utm, 4326), transform(x, y + metres, utm, 4326)
    return float((abs(east[0][0] - lon) + abs(north[1][0] - lat)) / 2)
