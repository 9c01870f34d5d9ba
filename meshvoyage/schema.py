"""Column layouts and fixed values of the mesh model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight directions in the order of every directional array, as the
# files store them (NE, E, SE, S, SW, W, NW, N), and the headings of those directions.
CASES = [1, 2, 3, 4, -1, -2, -3, -4]
HEADINGS_DEG = [45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0, 0.0]

# Metres in a degree of longitude at the equator and of latitude, and the earth's radii.
M_PER_DEG_LON = 111_321.0
M_PER_DEG_LAT = 111_386.0
RHUMB_RADIUS_M = 6_371_100.0
SMOOTH_RADIUS_M = 6_371_000.0

CELL_FIELDS = ["uC", "vC", "SIC", "thickness", "density", "elevation", "swh", "u10", "v10"]
CELLS = "id string, cx double, cy double, dcx double, dcy double, " + ", ".join(f"{c} double" for c in CELL_FIELDS)
EDGES = "src string, case int, dst string, ord int"
WAYPOINTS = "Name string, Lat double, Long double, Source string, Destination string"
LEGS = "route_id string, seq int, start_lon double, start_lat double, end_lon double, end_lat double, cell string, case int, distance double, traveltime double, fuel double, battery double"


def case_index(case: Column) -> Column:
    """0-based place of a direction in the directional arrays; null for no direction."""
    at = F.array_position(F.array(*[F.lit(c) for c in CASES]), case.cast("int"))
    return F.when(at > 0, at.cast("int") - 1)


def at_case(values: Column, case: Column) -> Column:
    """The entry of a directional array for ``case``."""
    return F.get(values, case_index(case))
