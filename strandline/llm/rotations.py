"""Near-duplicate vectors by randomised-rotation binary codes.

A rotated unit vector's signs are its code. The inner product of a vector q and a coded vector o is estimated by that of the
rotated q and o's signs, over the stored factor <signs, o>: unbiased over the rotation, with an error that the factor and the
number of dimensions bound. Only pairs whose upper confidence bound reaches the threshold are recomputed exactly.

Candidates meet where some group of code bits is equal. The number of bits grows with the logarithm of the rows, that of the
groups with the recall asked for, so a bucket stays small at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.grouping import candidate_edges, components, linked_components, verified_links
from strandline.llm.shared import prepare, store

THRESHOLD = 0.9
RECALL = 0.9995  # of pairs at the threshold, by some group of bits
SKETCH_ROTATIONS = 8
SETTLE_DEGREES, SLACK_DEGREES = 15.0, 14.0
CONFIDENCE = 6.0  # standard errors of the bound


def rotation(number: int, dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([11, number]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def bit_groups(n_rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a group, and groups such that a pair at the threshold shares one with probability recall."""
    bits = min(max(math.ceil(math.log2(max(n_rows, 2))), 8), 48)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def _unit(batch_column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one: right length, no null or non-finite part, not zero."""
    rows = np.zeros((len(batch_column), dims))
    good = np.zeros(len(batch_column), bool)
    for i, v in enumerate(batch_column.to_pylist()):
        if v is not None and len(v) == dims and None not in v:
            rows[i] = v
            good[i] = True
    good &= np.isfinite(rows).all(1)
    rows[~good] = 0
    scale = np.abs(rows).max(1, keepdims=True, initial=0.0)
    good &= scale[:, 0] > 0
    rows[good] /= scale[good]  # keeps the squares of very small and very large parts finite
    rows[good] /= np.linalg.norm(rows[good], axis=1, keepdims=True)
    return rows, good


def _angle_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cosine of the angle that the share of unequal bits stands for."""
    unequal = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / (8 * max(a.shape[1], b.shape[1]))
    return np.cos(np.pi * unequal)


def bounded_links(threshold: float, dims: int, confidence: float = CONFIDENCE):
    """Cosine >= threshold within a block or between two; codes and their bounds choose the pairs computed in full."""
    turn = rotation(0, dims)

    def link(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        own = np.frombuffer(b"".join(left), np.float64).reshape(len(left), dims)
        other = np.frombuffer(b"".join(right), np.float64).reshape(len(right), dims) if right else own
        turned = own @ turn.T
        signs = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(dims)
        factor = np.einsum("ij,ij->i", signs, turned)[:, None]  # <signs, o>
        guess = (signs @ (other @ turn.T).T) / factor
        spread = np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(dims - 1, 1))
        linked = np.zeros(guess.shape, bool)
        i, j = np.nonzero(guess + confidence * spread >= threshold)
        linked[i, j] = np.einsum("ij,ij->i", own[i], other[j]) >= threshold
        return linked if right else linked | linked.T

    return link


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    The cosine of unit vectors is computed in double precision. Null, zero, non-finite or incomplete vectors link with nothing,
    others with vectors of their own length; each length that occurs twice takes a pass. Rows that repeat a vec_id are compared
    like others; their links count together. A null vec_id links with nothing. Other columns are ignored; an empty table gives
    no rows.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("node"), F.col("embedding").alias("v"))
    lengths = rows.where("v is not null").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    several = lengths.where("d > 0 and n > 1").orderBy("d").collect()
    if not several:
        return rows.select(F.col("node").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("node").alias("component_id"),
                           F.col("node").isNotNull().alias("kept"))
    links = [_links_of_length(rows.where(F.size("v") == r.d), r.d, r.n, threshold, recall) for r in several]
    counts, roots = linked_components(reduce(DataFrame.unionByName, links))
    found = counts.join(roots, "node", "left")
    return rows.select("node").join(found, "node", "left").select(
        F.col("node").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("component_id"),
        F.coalesce(F.col("node") == F.coalesce("root", "node"), F.lit(False)).alias("kept"),
    )


def _links_of_length(rows: DataFrame, dims: int, n_rows: int, threshold: float, recall: float) -> DataFrame:
    """Stored verified links (node, peer, links) of rows (node, v) that all have ``dims`` parts."""
    bits, groups = bit_groups(n_rows, threshold, recall)
    per_turn = dims // bits if dims >= bits else 1
    turns = max(math.ceil(groups / per_turn), SKETCH_ROTATIONS)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spins = [rotation(k, dims) for k in range(SKETCH_ROTATIONS)]
        for batch in batches:
            found, good = _unit(batch.column(1), dims)
            at = np.flatnonzero(good)
            codes = np.concatenate([np.packbits(found[at] @ s.T >= 0, axis=1) for s in spins], axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in found[at]], pa.binary()),
                pa.array([c.tobytes() for c in codes], pa.binary()),
            ], ["node", "payload", "sketch"])

    coded = store(rows.where("node is not null").mapInArrow(unit, "node bigint, payload binary, sketch binary"), "codes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spins = [rotation(k, dims) for k in range(turns)]
        weights = 1 << np.arange(min(bits, dims), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, dims)
            for turn, spin in enumerate(spins):
                signs = found @ spin.T >= 0
                for part in range(per_turn):
                    number = turn * per_turn + part
                    if number < groups:
                        key = signs[:, part * bits:(part + 1) * bits] @ weights
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(key), batch.column(0)], ["tree", "prefix", "node"]
                        )

    buckets = store(coded.select("node", "payload").mapInArrow(keys, "tree int, prefix bigint, node bigint").distinct(), "code-groups")
    edge = math.cos(math.radians(min(math.degrees(math.acos(threshold)) + SETTLE_DEGREES + SLACK_DEGREES, 90)))
    settle = math.cos(math.radians(SETTLE_DEGREES))
    single = coded.select("node", "sketch").dropDuplicates(["node"])
    near = store(components(candidate_edges(buckets, store(single, "sketches"), _angle_similarity, settle, edge)), "candidate-groups")
    return store(verified_links(near, coded.select("node", "payload"), bounded_links(threshold, dims)), "vector-links")
