"""Where the columns of the aligned table come from: one table that job 2 builds them from, the catalog explains them with and
the rules check them by."""

from __future__ import annotations

from dataclasses import dataclass

from strandline.config import SOURCES
from strandline.functions import health as he


@dataclass(frozen=True)
class Origin:
    """An output column and the message field it is converted from. States also name the field that stands in for a missing
    one, and the status bits (any of them) under which it may."""

    column: str
    message: str
    field: str
    unit: str
    frame: str | None = None
    stand_in: str | None = None
    bits: int = 0


_PLACE = he.HORIZ_POS_REL | he.HORIZ_POS_ABS

# Columns, message fields, units and status bits.
ORIGINS = (
    Origin("px", "PSCE", "PE", "m", "ENU", "PE", _PLACE),
    Origin("py", "PSCN", "PN", "m", "ENU", "PN", _PLACE),
    Origin("pz", "PSCD", "PD", "m", "ENU", "PD", he.VERT_POS),
    Origin("vx", "PSCE", "VE", "m/s", "ENU", "VE", he.HORIZ_VEL),
    Origin("vy", "PSCN", "VN", "m/s", "ENU", "VN", he.HORIZ_VEL),
    Origin("vz", "PSCD", "VD", "m/s", "ENU", "VD", he.VERT_VEL),
    Origin("ax", "PSCE", "AE", "m/s/s", "ENU"),
    Origin("ay", "PSCN", "AN", "m/s/s", "ENU"),
    Origin("az", "PSCD", "AD", "m/s/s", "ENU"),
    Origin("ax_target", "PSCE", "TAE", "m/s/s", "ENU"),
    Origin("ay_target", "PSCN", "TAN", "m/s/s", "ENU"),
    Origin("az_target", "PSCD", "TAD", "m/s/s", "ENU"),
    Origin("dx", "PSCE", "AE", "m/s/s", "ENU"),
    Origin("dy", "PSCN", "AN", "m/s/s", "ENU"),
    Origin("dz", "PSCD", "AD", "m/s/s", "ENU"),
    Origin("yaw", "ATT", "Yaw", "rad", "ENU"),
    Origin("battery_v", "BAT", "Volt", "V"),
    Origin("battery_i", "BAT", "Curr", "A"),
    Origin("throttle", "CTUN", "ThO", "1"),
    Origin("gps_status", "GPS", "Status", "enum"),
    Origin("ekf_primary_core", "XKF4", "PI", "enum"),
    Origin("ekf_solution_status", "XKF4", "SS", "bitmask"),
    Origin("ekf_fault_status", "XKF4", "FS", "bitmask"),
)
FRAME, RESIDUAL_SIGN = "ENU", "d = a_actual - a_target"  # Fixed values: what a release has to claim.
STAND_IN = "XKF1"  # Fixed value: the message of all stand-ins.
MOTORS = ("motor1", "motor2", "motor3", "motor4")

STATES = tuple(o for o in ORIGINS if o.stand_in)
DIRECT = tuple(o for o in ORIGINS if not o.stand_in)

# Columns that follow from another by name, with message and unit.
FOLLOWING = (
    tuple((f"age_{s.lower()}_ms", s, "ms") for s in SOURCES)
    + tuple((f"source_time_{s.lower()}_us", s, "us") for s in SOURCES)
    + tuple((f"source_{o.column}", "derived lineage", "category") for o in STATES)
    + tuple((m, "RCOU", "us") for m in MOTORS)
    + tuple((f"{kind}_d{axis}", "derived quality", "bool") for kind in ("valid", "eligible") for axis in "xyz")
)


# What events and parameters the flights, modes and motors of the aligned table follow from.
EVENT_FIELDS = {
    "flight_id": (("ARM", "ArmState"), ("EV", "Id")),
    "mode": (("MODE", "ModeNum"), ("MODE", "Mode")),
    "continuity_id": (("GPS", "Status"), ("XKF4", "PI"), ("XKF4", "SS"), ("XKF4", "FS"), ("XKF4", "TS"), ("XKF4", "OFN"), ("XKF4", "OFE"), ("EV", "Id")),
    "time_us": (("ARM", "TimeUS"),),
}


def edges(features: dict[str, tuple[str, ...]]) -> list[tuple[str, str | None, str | None, str | None, str, bool]]:
    """(column, parent column, message, field, how, fallback) of every step from an output column to what it is made of.

    A step leads to another column or to a message field. ``features`` names the columns that eligibility of an axis needs.
    """
    out = []
    field = lambda c, m, f, how, back=False: out.append((c, None, m, f, how, back))
    column = lambda c, p, how, back=False: out.append((c, p, None, None, how, back))
    turned = lambda o, f: "degrees clockwise from north to radians" if o.unit == "rad" else "down to up" if f.endswith("D") else "taken"
    for o in ORIGINS:
        if o.column in ("dx", "dy", "dz"):
            continue
        field(o.column, o.message, o.field, turned(o, o.field))
        if o.stand_in:
            field(o.column, STAND_IN, o.stand_in, turned(o, o.stand_in), True)
            column(o.column, "ekf_healthy", "allows the stand-in", True)
            field(o.column, STAND_IN, "C", "has to be the primary core", True)
            column(f"source_{o.column}", o.column, "names its origin")
    for axis in "xyz":
        pair = (f"a{axis}", f"a{axis}_target")
        for parent in pair:
            column(f"d{axis}", parent, "actual minus target")
            column(f"valid_d{axis}", parent, "both are there")
        for parent in (f"valid_d{axis}", "outlier", *features.get(axis, ())):
            column(f"eligible_d{axis}", parent, "has to be fit")
    for parent in ("battery_v", "battery_i", "throttle", "vx", "vy", "vz", *(f"a{a}{t}" for a in "xyz" for t in ("", "_target")), *MOTORS):
        column("outlier", parent, "has to lie in its range")
    for parent in ("ekf_primary_core", "ekf_solution_status", "ekf_fault_status"):
        column("ekf_healthy", parent, "judged together")
    field("ekf_healthy", "XKF4", "C", "has to be the primary core")
    column("gps_valid", "gps_status", "one of the fixes")
    for motor in MOTORS:
        field(motor, "PARM", "SERVO_FUNCTION", "chooses the channel")
        field(motor, "RCOU", "C", "the chosen channel")
    for source in SOURCES:
        field(f"source_time_{source.lower()}_us", source, "TimeUS", "newest row before")
        column(f"age_{source.lower()}_ms", f"source_time_{source.lower()}_us", "time of the row minus it")
        column(f"age_{source.lower()}_ms", "time_us", "time of the row minus it")
    for name, fields in EVENT_FIELDS.items():
        for message, origin in fields:
            field(name, message, origin, "bounds")
    column("mode", "flight_id", "inside a flight")
    column("continuity_id", "flight_id", "inside a flight")
    column("continuity_id", "mode", "ends with it")
    return out
