"""Job 3 makes texts, sums and examples only where they are needed."""

import hashlib

from pyspark.sql import functions as F

from strandline.operators import digest as dg
from strandline.operators import rules as ru


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_is_hashed_beside_the_sum_and_as_the_same_text(spark):
    df = spark.createDataFrame([(1, 2.5, None, True), (1, None, "a", False)], "log_id int, x double, s string, b boolean")
    out = dg.table_digest(df, ["log_id"])
    assert not any("md5" in line for line in optimized(out).splitlines() if "Aggregate" in line)
    texts = ["=true\u001f-\u001f=2.5\u001f", "=false\u001f=a\u001f-\u001f"]
    wanted = sum(int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts)
    assert [(r.n_rows, r.digest) for r in out.collect()] == [(2, str(wanted))]


def test_rules_share_one_count_and_one_example(spark):
    df = spark.range(6).select((F.col("id") % 2).alias("log_id"), "id", F.when(F.col("id") > 1, F.col("id")).alias("v"))
    rules = [(f"above{i}", f"s{i}", F.col("v") > i, F.col("v")) for i in range(40)] + [("never", "s", F.lit(None).cast("boolean"), F.col("v"))]
    out = ru.row_rules(df, rules)
    assert optimized(out).count("min(") == 1
    found = {(r.log_id, r.rule, r.scope, r.n_bad, r.example) for r in out.collect()}
    assert found == {(0, "above0", "s0", 2, "2"), (0, "above1", "s1", 2, "2"), (0, "above2", "s2", 1, "4"), (0, "above3", "s3", 1, "4"),
                     (1, "above0", "s0", 2, "3"), (1, "above1", "s1", 2, "3"), (1, "above2", "s2", 2, "3"), (1, "above3", "s3", 1, "5"),
                     (1, "above4", "s4", 1, "5")}


def test_numbers_are_not_read_as_texts(spark):
    df = spark.createDataFrame([(1, 1.5, True), (1, float("nan"), None), (1, float("inf"), False), (1, None, True)], "log_id int, x double, f boolean")
    typed, bad = ru.coerce(df, ["x"], ["f"])
    assert "try_cast" not in optimized(typed).lower() and "cast(x" not in optimized(typed).lower()
    assert [(r.x, r.f) for r in typed.collect()] == [(1.5, True), (None, False), (float("inf"), False), (None, True)]
    assert {(r.rule, r.scope, r.n_bad, r.example) for r in bad.collect()} == {("finite", "x", 1, "Infinity"), ("boolean", "f", 1, "missing")}
