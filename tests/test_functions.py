import math

import pytest
from pyspark.sql import functions as F

from strandline.config import ExtractPolicy, override
from strandline.functions import frames as fr
from strandline.functions import health as he
from strandline.functions.numeric import finite, number, sig_text, text_flag
from strandline.functions.text import audited, clean_text, commit_hash


def test_finite_and_text(table):
    df = table("v double, s string", [(1.0, "1.5"), (math.nan, "x"), (math.inf, "True"), (None, "0"), (-math.inf, None)])
    got = df.select(finite(F.col("v")), number(F.col("s")), text_flag(F.col("s"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]
    assert [r[1] for r in got] == [1.5, None, None, 0.0, None]
    assert [r[2] for r in got] == [None, None, True, False, None]


def test_short_number_text(table):
    values = [1.0, 0.01, 1e-7, 1e-6, 0.001, 100000.0, 1234567.0, 0.0001, 2.5, 0.0]
    got = [r[0] for r in table("v double", [(v,) for v in values]).select(sig_text(F.col("v"))).collect()]
    assert got == [f"{v:g}" for v in values]


def test_axis_swap_is_its_own_inverse_and_keeps_the_norm(spark):
    df = spark.range(200).select(*[(F.rand(seed=i) * 20 - 10).alias(c) for i, c in enumerate("ned")])
    x, y, z = fr.ned_to_enu(F.col("n"), F.col("e"), F.col("d"))
    n, e, d = fr.enu_to_ned(x, y, z)
    bad = df.where((n != F.col("n")) | (e != F.col("e")) | (d != F.col("d")) | (F.abs(x * x + y * y + z * z - (F.col("n") ** 2 + F.col("e") ** 2 + F.col("d") ** 2)) > 1e-9))
    assert bad.count() == 0
    assert spark.range(1).select(*fr.ned_to_enu(F.lit(1.0), F.lit(2.0), F.lit(3.0))).first() == (2.0, 1.0, -3.0)
    assert spark.range(1).select(*fr.ned_to_enu(F.lit(1.0), F.lit(None), F.lit(3.0))).first() == (None, 1.0, -3.0)
    assert spark.range(1).select(fr.vector_ned_to_enu(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))).first()[0] == [2.0, 1.0, -3.0]
    with pytest.raises(Exception, match="three axes"):
        spark.range(1).select(fr.vector_ned_to_enu(F.array(F.lit(1.0)))).collect()


@pytest.mark.parametrize("degrees,expected", [(0, math.pi / 2), (90, 0), (180, -math.pi / 2), (270, -math.pi), (360, math.pi / 2), (-90, -math.pi), (450, 0)])
def test_heading(spark, degrees, expected):
    got = spark.range(1).select(fr.heading_to_enu(F.lit(float(degrees)))).first()[0]
    assert got == pytest.approx(expected, abs=1e-12) and -math.pi <= got < math.pi


def test_residual_needs_one_frame(spark):
    assert spark.range(1).select(fr.residual(F.lit(2.0), F.lit(5.0))).first()[0] == -3.0
    assert spark.range(1).select(fr.residual(F.lit(2.0), F.lit(None))).first()[0] is None
    with pytest.raises(ValueError):
        fr.residual(F.lit(1), F.lit(1), "ENU", "NED")
    with pytest.raises(ValueError):
        fr.residual(F.lit(1), F.lit(1), "body", "body")


def test_status_bits(table):
    df = table("c double, p double, s double, f double", [(0, 0, 47, 0), (1, 0, 47, 0), (0, 0, 47 + 128, 0), (0, 0, 46, 0), (0, 0, 47, 1), (0, 0, None, 0)])
    cols = [F.col(c) for c in "cpsf"]
    got = [(r[0], r[1]) for r in df.select(he.status_known(*cols), he.healthy(*cols)).collect()]
    assert got == [(True, True), (False, False), (True, False), (True, False), (True, False), (False, False)]
    gps = table("s int", [(i,) for i in (0, 2, 3, 7, 8, 9, None)]).select(he.gps_known(F.col("s")), he.gps_valid(F.col("s"))).collect()
    assert [tuple(r) for r in gps] == [(True, False), (True, False), (True, True), (True, False), (True, True), (False, False), (False, False)]


def test_firmware_and_text(table):
    df = table("t string", [("ArduCopter V4.8.0-dev (2b5cebb9)",), ("ArduCopter (deadbeef00)",), ("none",), (None,),
                            ("ArduPlane V4.8 (2b5cebb9)",)])
    got = df.select(commit_hash(F.col("t")), audited(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("2b5cebb9", True), ("deadbeef00", False), (None, False), (None, False), ("2b5cebb9", False)]
    raw = table("b binary", [(b"ab\x00cd",), (b"x\xff",)])
    assert [r[0] for r in raw.select(clean_text(F.col("b"), binary=True)).collect()] == ["ab", "x�"]


def test_policy_is_checked():
    assert override(ExtractPolicy(), master_rate_hz=5.0).hold_ms("GPS") == 350
    for bad in ({"master_rate_hz": 0}, {"train_fraction": 1.5}, {"nonsense": 1}, {"max_age_ms": {**ExtractPolicy().max_age_ms, "GPS": -1}}):
        with pytest.raises(ValueError):
            override(ExtractPolicy(), **bad)
