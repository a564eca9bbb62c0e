"""Fixed-degree grid cells and cluster counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid.
KM_PER_DEGREE = 111.0
MIN_CELL_KM = 0.1
CENTER_DECIMALS = 6

# Bounds of the number of clusters in a city.
MIN_CLUSTERS, MAX_CLUSTERS = 2, 12


class GridCell(NamedTuple):
    """Columns of a cell; all are null when a coordinate is null."""

    grid_id: Column
    latitude: Column
    longitude: Column


def cell_degrees(cell_size_km: float) -> float:
    return max(cell_size_km, MIN_CELL_KM) / KM_PER_DEGREE


def cell_index(coordinate: Column, cell_size_km: float) -> Column:
    return F.floor(coordinate / F.lit(cell_degrees(cell_size_km)))


def cell_center(index: Column, cell_size_km: float) -> Column:
    return F.round((index + F.lit(0.5)) * F.lit(cell_degrees(cell_size_km)), CENTER_DECIMALS)


def cell_at(lat_index: Column, lon_index: Column, cell_size_km: float = 2.0) -> GridCell:
    """Identifier and center of the cell with the given indices."""
    return GridCell(
        F.concat(lat_index.cast("string"), F.lit("_"), lon_index.cast("string")),
        cell_center(lat_index, cell_size_km),
        cell_center(lon_index, cell_size_km),
    )


def grid_cell(latitude: Column, longitude: Column, cell_size_km: float = 2.0) -> GridCell:
    """Cell holding a point. Cells are square in degrees: longitude is not corrected for latitude."""
    known = latitude.isNotNull() & longitude.isNotNull()
    cell = cell_at(cell_index(latitude, cell_size_km), cell_index(longitude, cell_size_km), cell_size_km)
    return GridCell(*(F.when(known, column) for column in cell))


def cluster_count(points: Column) -> Column:
    """Clusters for a city of ``points`` places: the whole part of the square root, within bounds; 1 for one place."""
    root = F.floor(F.sqrt(points)).cast("int")
    return F.when(points <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(MIN_CLUSTERS), F.least(F.lit(MAX_CLUSTERS), root))
    )


def cell_order(latitude: Column, longitude: Column) -> Column:
    """A number that is near for near points: both coordinates as 16-bit numbers, their bits taken in turn (Morton order).

    A missing coordinate counts as the lowest one.
    """

    def spread(value: Column, low: float, span: float) -> Column:
        bits = F.floor((F.least(F.greatest(value, F.lit(low)), F.lit(low + span)) - low) / span * 65535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = (bits.bitwiseOR(F.shiftleft(bits, shift))).bitwiseAND(mask)
        return bits

    return spread(latitude, -90.0, 180.0).bitwiseOR(F.shiftleft(spread(longitude, -180.0, 360.0), 1))
