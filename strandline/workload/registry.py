"""All registered queries."""

from __future__ import annotations

from strandline.workload import alignment_queries, dataset_queries, interval_queries, job_queries, profile_queries

QUERIES, ORACLES = {}, {}
for module in (interval_queries, alignment_queries, profile_queries, dataset_queries, job_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
