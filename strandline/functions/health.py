"""Estimator and receiver status, preference with fallback, and row lineage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.numeric import clean, finite

# Solution status bits.
ATTITUDE, HORIZ_VEL, VERT_VEL = 1, 2, 4
HORIZ_POS_REL, HORIZ_POS_ABS, VERT_POS = 8, 16, 32
CONST_POS = 128

# Receiver fix types that count as a three-dimensional fix.
GPS_FIX_3D = (3, 4, 5, 6, 8)


def has_bit(mask: Column, bit: int) -> Column:
    """Any of the bits set; unknown masks have none."""
    return F.coalesce(mask.cast("bigint"), F.lit(0).cast("bigint")).bitwiseAND(F.lit(bit).cast("bigint")) != 0


def status_known(core: Column, primary: Column, status: Column, fault: Column) -> Column:
    """All four numbers present and the row speaks for the primary core."""
    return finite(core) & finite(primary) & finite(status) & finite(fault) & F.coalesce(core == primary, F.lit(False))


def healthy(core: Column, primary: Column, status: Column, fault: Column, const_pos_bit: int = CONST_POS) -> Column:
    ok = (fault == 0) & has_bit(status, ATTITUDE) & ~has_bit(status, const_pos_bit)
    return status_known(core, primary, status, fault) & F.coalesce(ok, F.lit(False))


def horizontal_position_ok(status: Column, fault: Column, const_pos_bit: int = CONST_POS) -> Column:
    """Status screen for a usable horizontal position."""
    ok = (
        (fault == 0) & has_bit(status, ATTITUDE) & has_bit(status, HORIZ_POS_REL | HORIZ_POS_ABS)
        & ~has_bit(status, const_pos_bit)
    )
    return F.coalesce(ok, F.lit(False))


def gps_known(status: Column) -> Column:
    return F.coalesce(status.isin(*range(9)), F.lit(False))


def gps_valid(status: Column) -> Column:
    return F.coalesce(status.isin(*GPS_FIX_3D), F.lit(False))


def prefer(first: Column, fallback: Column, fallback_ok: Column) -> Column:
    """The first value where finite, else the fallback where it is allowed and finite."""
    return F.coalesce(clean(first), F.when(F.coalesce(fallback_ok, F.lit(False)), clean(fallback)))


def lineage(first: Column, first_label: str, fallback: Column, fallback_ok: Column, fallback_label: str, core: Column) -> Column:
    """Which field a preferred value came from: label, label with core number, or empty."""
    return (
        F.when(finite(first), F.lit(first_label))
        .when(
            F.coalesce(fallback_ok, F.lit(False)) & finite(fallback),
            F.concat(F.lit(fallback_label + "[C="), core.cast("int").cast("string"), F.lit("]")),
        )
        .otherwise(F.lit(""))
    )
