"""Job 3: check a finished table against its own claims and report its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import AXES, NUMERIC_COLUMNS, REQUIRED_COLUMNS, STATE_COLUMNS, ExtractPolicy
from strandline.operators import digest as dg
from strandline.operators import flags as fg
from strandline.operators import profile as pf
from strandline.operators import rules as ru
from strandline.session import settle, stow

# Columns of the finished table that some report reads, besides the log.
READ_COLUMNS = {*REQUIRED_COLUMNS, *NUMERIC_COLUMNS, "time_us", "row_seq", "continuity_id", *[f"eligible_d{a}" for a in "xyz"]}


def find_violations(
    dataset: DataFrame,
    split: DataFrame,
    segments: DataFrame,
    policy: ExtractPolicy = ExtractPolicy(),
    recorded_counts: DataFrame | None = None,
    lineage: DataFrame | None = None,
    expected_digests: DataFrame | None = None,
    actual_digests: DataFrame | None = None,
    manifest: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All violations, and the table with typed columns and recomputed eligibility.

    ``dataset`` is the stored table (typed or text) with ``time_us`` and ``row_seq``. Row rules share one
    aggregate; rules between rows and tables are small aggregates and equi-joins of their own.
    """
    full, missing = ru.missing_columns(dataset, REQUIRED_COLUMNS)
    typed, bad_cells = ru.coerce(full, NUMERIC_COLUMNS)
    flights = segments.select("log_id", "flight_id", F.col("start_us").alias("flight_start_us"), F.col("end_us").alias("flight_end_us"))
    located = typed.join(flights, ["log_id", "flight_id"], "left")
    rules = []
    for axis, (message, _) in AXES.items():
        source = message.lower()
        if f"age_{source}_ms" in typed.columns and f"source_time_{source}_us" in typed.columns:
            rules += ru.residual_rules(axis, source, policy.hold_ms(message))
        else:
            rules.append(("provenance_missing", f"d{axis}", F.col(f"valid_d{axis}"), F.col("time_us")))
    rules += ru.provenance_rules(located, policy)
    checked, eligibility = ru.with_eligibility(typed, policy)
    # Eligibility rules read the recorded flags, so they run on the table before it is recomputed.
    parts = [
        missing, bad_cells, ru.presence(typed, segments.select("log_id").distinct()), ru.duplicates(typed), ru.monotonic(ru.sampling(typed, rate_hz=policy.master_rate_hz)),
        ru.flight_boundaries(typed, segments), ru.row_rules(located, rules + eligibility), ru.split_rules(split), ru.membership(split, typed),
        ru.reconcile(split, typed, [c for c in NUMERIC_COLUMNS if c != "time_s" and c in split.columns],
                     [c for c in typed.columns if c.startswith(("valid_d", "eligible_d"))]),
    ]
    if manifest is not None:
        parts.append(ru.claim_rules(manifest))
    if recorded_counts is not None:
        parts.append(dg.reconcile_counts(recorded_counts, dg.manifest_counts(checked), [f"valid_d{a}" for a in "xyz"]))
    if lineage is not None:
        parts.append(ru.frame_rules(lineage))
    if expected_digests is not None and actual_digests is not None:
        parts.append(dg.reconcile_digests(expected_digests, actual_digests))
    return ru.violations(parts), checked


def validate_dataset(
    dataset: DataFrame,
    split: DataFrame,
    segments: DataFrame,
    policy: ExtractPolicy = ExtractPolicy(),
    proxy_axes: str = "xy",
    **claims: DataFrame,
) -> dict[str, DataFrame]:
    """Violations and quality reports as tables; ``claims`` as in ``find_violations``. The violations and the columns that
    reports read, typed and flagged, are stored first, since every report reads them."""
    found, checked = find_violations(dataset, split, segments, policy, **claims)
    found = settle(found)
    marked = stow(fg.dataset_flags(checked.select("log_id", *[c for c in checked.columns if c in READ_COLUMNS]), policy))
    counts = settle(dg.manifest_counts(marked))
    stats = settle(pf.column_stats(marked, NUMERIC_COLUMNS, ["log_id"], epsilon=policy.constant_range_epsilon))
    fit_split, _ = ru.with_eligibility(split, policy)
    return {
        "violations": found,
        "sampling": ru.sampling_report(marked, rate_hz=policy.master_rate_hz),
        "counts": counts,
        "column_stats": stats,
        "constant_columns": stats.where(F.col("constant") & F.col("field").isin(*STATE_COLUMNS)),
        "outlier_flags": marked.select("log_id", "flight_id", "time_us", *fg.FLAG_COLUMNS, "flagged"),
        "flag_counts": fg.flag_counts(marked),
        "quality_by_flight": ru.quality_by(marked, "flight_id"),
        "quality_by_mode": ru.quality_by(marked, "mode"),
        "coverage_warning": ru.coverage_warning(counts),
        "readiness": ru.readiness(marked, fit_split, found, policy, proxy_axes),
    }
