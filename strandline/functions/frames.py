"""Axis conventions: NED sources, ENU output; plain column projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES = ("ENU", "NED")


def ned_to_enu(north: Column, east: Column, down: Column) -> tuple[Column, Column, Column]:
    """x = East, y = North, z = Up. Each axis survives the absence of the others."""
    return east, north, -down


def enu_to_ned(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The swap is its own inverse."""
    return ned_to_enu(x, y, z)


def vector_ned_to_enu(v: Column) -> Column:
    """Same swap on an array column; any other length than three is an error."""
    swapped = F.array(v[1], v[0], -v[2])
    return F.when(F.size(v) == 3, swapped).when(v.isNotNull(), F.raise_error(F.lit("a vector needs three axes")))


def axis_to_enu(value: Column, suffix: str) -> Column:
    """One NED component as the ENU component it becomes: N and E keep their sign, D flips."""
    return -value if suffix == "D" else value


def wrap_angle(radians: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(radians + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def heading_to_enu(degrees: Column) -> Column:
    """Degrees clockwise from North to radians counter-clockwise from East."""
    return wrap_angle(F.lit(math.pi / 2) - F.radians(degrees))


def residual(actual: Column, target: Column, actual_frame: str = "ENU", target_frame: str = "ENU") -> Column:
    """actual - target. The frames are part of the plan, so a mismatch fails while it is built."""
    if actual_frame not in FRAMES or target_frame not in FRAMES:
        raise ValueError("frames must be named, ENU or NED")
    if actual_frame != target_frame:
        raise ValueError("actual and target must be in the same frame")
    return actual.cast("double") - target.cast("double")
