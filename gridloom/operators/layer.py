"""Feature layers: a table with one geometry column and a reference system, and
the rules by which overlay results are named. All of it happens at plan time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Layer:
    """A DataFrame whose ``geometry`` is WKB in the system ``epsg``."""

    df: DataFrame
    epsg: int

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.df.columns if c != "geometry"]

    @property
    def geographic(self) -> bool:
        return self.epsg in GEOGRAPHIC


#: Systems in degrees that this engine knows.
GEOGRAPHIC = {4326, 4269, 4258}


def need_projected(layer: Layer, what: str) -> None:
    """Lengths and areas need a plane system in metres."""
    if layer.geographic:
        raise ValueError(f"{what} must be in a projected system, not EPSG:{layer.epsg}")


# Result columns that carry no further prefix.
METRIC_COLUMNS = {
    "zone_edge_proportion", "edge_link_length_m", "zone_link_length_m", "edge_surface_m2", "zone_surface_m2",
    "zone_piece_proportion", "piece_link_length_m", "zone_piece_length_m", "piece_surface_m2",
}

# Role -> result column, by kind of overlay.
METRICS = {
    "line": {"proportion": "zone_edge_proportion", "edge_length": "edge_link_length_m", "zone_length": "zone_link_length_m"},
    "polygon": {
        "proportion": "zone_edge_proportion", "edge_length": "edge_link_length_m", "zone_length": "zone_link_length_m",
        "edge_surface": "edge_surface_m2", "zone_surface": "zone_surface_m2",
    },
    "cascade": {
        "proportion": "zone_piece_proportion", "piece_length": "piece_link_length_m", "zone_length": "zone_piece_length_m",
        "piece_surface": "piece_surface_m2", "zone_surface": "zone_surface_m2",
    },
}


def label_prefix(label: str | None) -> str | None:
    return label.strip().lower() if label and label.strip() else None


def metric_names(kind: str, label: str | None = None) -> dict[str, str]:
    prefix = label_prefix(label)
    return {k: f"{prefix}_{v}" if prefix else v for k, v in METRICS[kind].items()}


def edge_name(column: str) -> str:
    """Attributes of the left layer get ``edge_`` once, however often chained."""
    return column if column.startswith(("edge_", "zone_")) or column in METRIC_COLUMNS else f"edge_{column}"


def zone_name(column: str, taken: set[str], prefix: str | None = None) -> str:
    """Attributes of the zones get the layer's prefix, numbered where a carried
    column has that name already."""
    prefix = prefix or "zone"
    if prefix != "zone" and column.startswith(f"{prefix}_") and column not in taken:
        return column
    n = 1
    while (name := f"{prefix}{n if n > 1 else ''}_{column}") in taken:
        n += 1
    return name


# Columns that hold lengths, and endings of those of earlier overlays.
LENGTH_COLUMNS = ("edge_link_length_m", "edge_length_m", "edge_length", "length")
PIECE_SUFFIXES = ("_zone_piece_length_m", "_piece_link_length_m", "_zone_link_length_m", "_edge_link_length_m")


def length_column(columns: list[str], asked: str | None = None, cascade: bool = False) -> str:
    """The column that holds link lengths: the one asked for, else the first
    known name, in a cascade also the first column with a known ending."""
    if asked is not None:
        if asked not in columns:
            raise ValueError(f"there is no length column {asked!r}")
        return asked
    known = (("zone_link_length_m",) if cascade else ()) + LENGTH_COLUMNS
    for c in known:
        if c in columns:
            return c
    if cascade:
        for ending in PIECE_SUFFIXES:
            for c in columns:
                if c.endswith(ending):
                    return c
    raise ValueError(f"a length column is needed: one of {', '.join(known)}")
