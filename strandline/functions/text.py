"""Text decoded from fixed-width fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.config import AUDITED_REVISION

# Prefixes and tokens that identify firmware and board lines.
FIRMWARE_PREFIXES = ("ArduCopter", "ArduPlane", "ArduRover", "ArduSub")
BOARD_TOKENS = ("speedybee", "pixhawk", "cube", "matek")

AUDITED_VEHICLE = "ArduCopter "  # Fixed value.
# Fixed value: how a firmware line states its commit.
_COMMIT = r"\(([0-9a-f]{8,40})\)"


def clean_text(c: Column, binary: bool = False) -> Column:
    """Cut at the first NUL; bytes that are no UTF-8 become replacement characters."""
    text = F.make_valid_utf8(c.cast("string")) if binary else c.cast("string")
    return F.substring_index(text, "\u0000", 1)


def commit_hash(firmware: Column) -> Column:
    """The commit in round brackets, or NULL."""
    return F.nullif(F.regexp_extract(firmware, _COMMIT, 1), F.lit(""))


def audited(firmware: Column, revision: str = AUDITED_REVISION) -> Column:
    """The audited vehicle, and a stated commit that is a prefix of the audited revision."""
    same = F.startswith(firmware, F.lit(AUDITED_VEHICLE)) & F.startswith(F.lit(revision), commit_hash(firmware))
    return F.coalesce(same, F.lit(False))
