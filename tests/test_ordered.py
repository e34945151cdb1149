import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators.ordered import Chunks, Scan, rank_chunk


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        log = 0 if rng.random() < 0.5 else rng.randint(1, 4)  # log 0 holds half of all rows
        data.append((log, rng.randint(0, 5000), i, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "log_id long, time_us long, record_index long, v long").cache()


def expected(rows):
    w = Window.partitionBy("log_id").orderBy("time_us", "record_index")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "log_id", "record_index",
        F.lag("v").over(w).alias("p"), F.lead("record_index").over(w).alias("n"),
        F.last("v", ignorenulls=True).over(upto).alias("l"), F.sum("v").over(upto).alias("t"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
    )


def scanned(rows):
    out = (
        Scan(rows, ["log_id"], ("time_us", "record_index"))
        .previous("p", "v").following("n", "record_index").last("l", F.col("v")).total("t", F.col("v")).peak_before("m", F.col("v")).run()
    )
    return out.select("log_id", "record_index", F.col("p.v").alias("p"), F.col("n.record_index").alias("n"), "l", "t", "m")


@pytest.mark.parametrize("cell", [1 << 40, 1000, 37])
def test_scan_equals_plain_windows_for_any_chunk_size(rows, cell):
    got = scanned(Chunks(cell).add(rows))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected(rows).collect()))


def test_rank_chunks_hold_a_bounded_number_of_rows(rows):
    cut = rank_chunk(rows, rows=50)
    assert cut.groupBy("log_id", "_chunk").count().agg(F.max("count")).first()[0] <= 50
    w = Window.partitionBy("log_id").orderBy("record_index")
    want = rows.select("log_id", "record_index", F.lag("v").over(w).alias("p"))
    got = Scan(cut, ["log_id"], ("record_index",)).previous("p", "v").run().select("log_id", "record_index", F.col("p.v").alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_data_shuffles_by_log_and_chunk_only(rows):
    plan = scanned(Chunks(1000).add(rows))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_short_sequences_are_whole_and_carry_nothing(rows):
    """One window a sequence, no chunk, no carrier and no aggregate: the result is that of plain windows."""
    whole = Chunks.fitting(rows, 1000)
    assert whole.cell_us is None and "_chunk" not in whole.by_rank(rows).columns
    out = scanned(whole.add(rows))
    assert sorted(map(str, out.collect())) == sorted(map(str, expected(rows).collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan


def test_long_sequences_get_the_widest_cells_that_keep_a_chunk_small(spark):
    base = 1_700_000_000_000_000
    rows = spark.range(20_000).select((F.col("id") % 2).alias("log_id"), (F.lit(base) + F.col("id") * (1 << 29)).alias("time_us"), F.col("id").alias("record_index"))
    fitted = Chunks.fitting(rows, 1 << 33, limit=1000)
    sizes = [r["count"] for r in fitted.add(rows).groupBy("log_id", "_chunk").count().collect()]
    assert fitted.cell_us > Chunks().cell_us and max(sizes) <= 1000 and len(sizes) < 400
    assert Chunks.fitting(rows, 1 << 33, limit=2).cell_us == Chunks().cell_us
