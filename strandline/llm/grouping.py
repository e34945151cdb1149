"""From buckets of likely neighbours to verified links, without ever listing all pairs of a bucket.

1. ``candidate_edges``: every member of a bucket is compared, by a small sketch, with the bucket's head; what is close to the
   head is settled, the rest is compared among itself. The edges are linear in the members.
2. ``components``: edges to components by rounds of joins.
3. ``verified_links``: all pairs of a candidate component are compared exactly, block against block, within tasks of bounded
   size. Rows leave as link counts and a spanning forest, not as pairs.

If x and y are linked and x is settled with the head, y is no farther from the head than the settling distance plus the
linking distance; the edge distance is chosen beyond that, so both end in one candidate component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import store

NEAR_ROWS = 32  # remaining members of a bucket up to which each is compared with each
CROWD_ROWS = 1 << 15  # remaining members of a bucket up to which one task takes them all
BLOCK = 192  # members of a block; two blocks are compared in one step

Estimate = Callable[[np.ndarray, np.ndarray], np.ndarray]  # sketches as rows of bytes, one by one -> similarity
Link = Callable[[list[bytes], list[bytes] | None], np.ndarray]  # payloads of one or two blocks -> linked or not


def _rows(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def spanning(a: list[int], b: list[int]) -> np.ndarray:
    """Places of the edges that join what earlier ones have not: a spanning forest, fewer edges than nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _rest_edges(estimate: Estimate, settle: float, edge: float):
    """Compare the members of each bucket, which come one bucket after the other; a spanning forest of each leaves."""
    def crowd(sketches: np.ndarray) -> Iterator[tuple[int, int]]:
        """Leaders in turn: each takes an edge from what is near, and what is close to it is settled."""
        left = np.arange(len(sketches))
        while len(left) > 1:
            head, left = left[0], left[1:]
            similar = estimate(sketches[left], sketches[head:head + 1])
            yield from ((int(i), int(head)) for i in left[similar >= edge])
            left = left[similar < settle]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            trees, prefixes = (table.column(i).to_numpy() for i in (0, 1))
            nodes, sketches = table.column(2), _rows(table.column(3))
            cuts = np.flatnonzero((np.diff(trees) != 0) | (np.diff(prefixes) != 0)) + 1
            bucket = np.zeros(len(trees), np.int64)
            bucket[cuts] = 1
            bucket = np.cumsum(bucket)
            sizes = np.bincount(bucket)
            a, b = [], []
            few = sizes[bucket] <= NEAR_ROWS
            for step in range(1, min(NEAR_ROWS, len(bucket))):
                at = np.flatnonzero(few[:-step] & (bucket[:-step] == bucket[step:]))
                if not len(at):
                    break
                at = at[estimate(sketches[at + step], sketches[at]) >= edge]
                a.append(at + step)
                b.append(at)
            for number in np.flatnonzero(sizes > NEAR_ROWS):
                base = np.searchsorted(bucket, number)
                found = np.array(list(crowd(sketches[base:base + sizes[number]])), np.int64).reshape(-1, 2) + base
                a.append(found[:, 0])
                b.append(found[:, 1])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            tree = spanning(a.tolist(), b.tolist())
            a, b = (nodes.take(pa.array(x[tree])) for x in (a, b))
            return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            trees, prefixes = (table.column(i).to_numpy() for i in (0, 1))
            start = int(np.argmax((trees == trees[-1]) & (prefixes == prefixes[-1])))  # of the last bucket, which may go on
            if start:
                yield solve(table.slice(0, start))
                held = table.slice(start).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return search


def candidate_edges(
    buckets: DataFrame, sketches: DataFrame, estimate: Estimate, settle: float, edge: float, crowd_rows: int = CROWD_ROWS
) -> DataFrame:
    """Edges (a, b) between nodes whose sketches are near enough.

    What is left of a bucket takes a new head, by joins alone, until no bucket has more than crowd_rows left; these are then
    compared within one task each.

    buckets: (tree, prefix, node), stored. sketches: (node, sketch), stored; sketches are binary of one length.
    """
    kind = buckets.schema["node"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                similar = estimate(_rows(batch.column(2)), _rows(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar.astype(np.float64))], ["node", "head", "similar"])

    edges = None
    while True:
        heads = buckets.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        members = store(buckets.join(heads, ["tree", "prefix"]).where(F.col("node") != F.col("head")), "bucket-members")
        met = (
            members.select("node", "head").distinct().join(sketches, "node").withColumnRenamed("sketch", "own")
            .join(sketches.select(F.col("node").alias("head"), F.col("sketch").alias("other")), "head").select("node", "head", "own", "other")
        )
        met = store(met.mapInArrow(judge, f"node {kind}, head {kind}, similar double"), "head-pairs")
        near = met.where(F.col("similar") >= edge).select(F.col("node").alias("a"), F.col("head").alias("b"))
        edges = near if edges is None else edges.unionByName(near)
        buckets = members.join(met.where(F.col("similar") < settle), ["node", "head"]).select("tree", "prefix", "node")
        buckets = store(buckets, "bucket-rest")
        several = buckets.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        most = several.agg(F.max("n")).first()[0]
        if most is None or most <= crowd_rows:
            break
    rest = buckets.join(several.drop("n"), ["tree", "prefix"]).join(sketches, "node").select("tree", "prefix", "node", "sketch")
    found = rest.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix").mapInArrow(
        _rest_edges(estimate, settle, edge), f"a {kind}, b {kind}"
    )
    return edges.unionByName(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Rounds of large-star and small-star steps: each node's neighbours are linked to its smallest one. A node's neighbours are
    never gathered; a join deals them out. Each round is written, so a lost executor costs one round.
    """
    found = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found, mark = store(found, "edges"), None
    while True:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large.where(F.col("a") != F.col("b")), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = found.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark:
            break
        mark = now
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def verified_links(groups: DataFrame, payloads: DataFrame, link: Link, block: int = BLOCK) -> DataFrame:
    """(node, peer, links): all pairs of a group compared exactly.

    groups: (node, root), payloads: (node, payload). A node may have several rows; its links are their sum. The peers are a
    spanning forest of the links of each pair of blocks.
    """
    kind = groups.schema["node"].dataType.simpleString()
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = groups.join(sizes, "root").join(payloads, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["root", "low", "high"]
    rows = rows.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "payload")

    def forest(linked: np.ndarray) -> list[tuple[int, int]]:
        """A spanning tree of each component of the linked rows."""
        tree, open_rows = [], set(np.flatnonzero(linked.any(1)).tolist())
        while open_rows:
            front = [open_rows.pop()]
            while front:
                at = front.pop()
                for to in np.flatnonzero(linked[at]).tolist():
                    if to in open_rows:
                        open_rows.discard(to)
                        front.append(to)
                        tree.append((at, to))
        return tree

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(low: int, high: int, held: list[tuple]) -> list[tuple]:
            left, right = [r for r in held if r[0] == low], [r for r in held if r[0] == high]
            if low == high:
                linked = link([r[2] for r in left], None)
                np.fill_diagonal(linked, False)
                nodes = [r[1] for r in left]
            else:
                if not left or not right:
                    return []
                cross = link([r[2] for r in left], [r[2] for r in right])
                nodes = [r[1] for r in left + right]
                linked = np.zeros((len(nodes), len(nodes)), bool)
                linked[:len(left), len(left):] = cross
                linked |= linked.T
            counts, peers = linked.sum(1), {}
            for at, to in forest(linked):
                peers[to] = at
            return [
                (nodes[i], nodes[peers[i]] if i in peers else None, int(counts[i])) for i in np.flatnonzero(counts).tolist()
            ]

        now, held, out = None, [], []
        for batch in batches:
            for root, low, high, own, node, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, low, high) != now:
                    if held:
                        out += solve(now[1], now[2], held)
                    now, held = (root, low, high), []
                held.append((own, node, payload))
            if out:
                yield _links(out, batch.schema.field("node").type)
                out = []
        if held and (out := solve(now[1], now[2], held)):
            yield _links(out, pa.int64() if kind == "bigint" else pa.binary())

    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compare, f"node {kind}, peer {kind}, links bigint")


def _links(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (kind, kind, pa.int64()))], ["node", "peer", "links"]
    )


def linked_components(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) and (node, root) of stored verified links."""
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    return counts, components(links.where("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
