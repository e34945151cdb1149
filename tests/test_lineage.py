"""The lineage graph: closure against a walk, and every column explained."""

from strandline import lineage
from strandline.config import REQUIRED_COLUMNS, ExtractPolicy
from strandline.operators import catalog as cg


def walk(steps, column):
    """Message fields below a column: shortest depth, and whether every way leads through a stand-in."""
    best, todo, seen = {}, [(column, 1, False)], set()
    while todo:
        at, depth, fallback = todo.pop()
        if (at, depth, fallback) in seen:
            continue
        seen.add((at, depth, fallback))
        for c, parent, message, field, _, back in steps:
            if c != at:
                continue
            if message is not None:
                d, f = best.get((message, field), (depth, True))
                best[message, field] = (min(d, depth), f and (fallback or back))
            else:
                todo.append((parent, depth + 1, fallback or back))
    return best


def test_closure_against_a_walk(spark):
    steps = lineage.edges(ExtractPolicy().features)
    found = {}
    for r in cg.lineage_closure(cg.lineage_edges(spark)).collect():
        found.setdefault(r.column, {})[r.message, r.field] = (r.depth, r.fallback)
    assert found == {c: walk(steps, c) for c in {s[0] for s in steps}}
    assert found["px"]["PSCE", "PE"] == (1, False) and found["px"]["XKF1", "PE"] == (1, True)
    assert found["px"]["XKF4", "SS"][1] and not found["ekf_healthy"]["XKF4", "SS"][1]
    assert ("ATT", "Yaw") in found["eligible_dz"] and found["eligible_dz"]["PSCD", "TAD"] == (3, False)


def test_every_required_column_is_explained(spark):
    columns = {s[0] for s in lineage.edges(ExtractPolicy().features)}
    assert set(REQUIRED_COLUMNS) - columns == {"time_s"}  # the grid's own clock, as time_us
    steps = [("a", "b", None, None, "x", False), ("b", "a", None, None, "x", False), ("b", None, "M", "F", "x", False)]
    table = spark.createDataFrame(steps, "column string, parent string, message string, field string, how string, fallback boolean")
    assert {(r.column, r.depth) for r in cg.lineage_closure(table).collect()} == {("a", 2), ("b", 1)}  # circles end
    units = spark.createDataFrame([(1, "M", "F", "m", 2.0, True), (2, "N", "F", "m", 2.0, True)],
                                  "log_id int, message string, field string, unit string, factor double, unit_verified boolean")
    got = cg.explain_columns(cg.lineage_closure(table), units).collect()
    assert {(r.log_id, r.column, r.factor) for r in got} == {(1, "a", 2.0), (1, "b", 2.0)}
