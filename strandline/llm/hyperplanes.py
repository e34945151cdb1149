"""Hard negatives by a GNAT-style multiway hyperplane tree.

Vectors become whole numbers and one more part, which gives all the same length; between a query (whose extra part is 0) and such
a row the squared distance is then a falling function of the inner product, so a window of scores is an annulus about the query.

A node holds split points; a row belongs to the nearest one, so siblings are parted by hyperplanes. Each split point stores the
least and greatest distance to the rows of every sibling subtree. By the triangle inequality a row of the annulus has a distance
to a split point in a known range; a sibling whose stored range misses it for some split point is eliminated. Leaves that remain
are searched in full, in blocks of rows against blocks of queries.

Split points come from a bounded sample; every row is routed, and the ranges cover every row. The tree's size is bounded by the
sample, so tasks may hold it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import prepare, store

SCALE = 256
SAMPLE_ROWS = 16_384  # rows in the order of their ids' hashes that the split points are chosen from
FANOUT = 16
LEAF_ROWS = 1024  # a subtree of so many rows, by the sample's estimate, is not split any more
BLOCK_PARTS, QUERY_PARTS = 1 << 16, 1 << 14  # vector parts in a block of rows and of queries
SALTS = 4  # ways in which a leaf's rows are dealt before they are put in blocks
SLACK = 1e-6  # of the lengths: more than distances lose to rounding
NORM_LIMIT = 1 << 62
ROWS = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_WHOLE = "vec_id bigint, label bigint, size int, norm bigint, x binary"


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, norm, x): floor(256 c) of every part, its squared length, as little-endian 32-bit integers."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all() and float((x * x).sum()) < 0.99 * NORM_LIMIT:
                    x = x.astype(np.int64)
                    out.append((vec_id, label, len(x), int((x * x).sum()), x.astype("<i4").tobytes()))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["vec_id", "label", "size", "norm", "x"])

    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
    return rows.where("vec_id is not null and label is not null").mapInArrow(whole, _WHOLE)


def matrix(blobs: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, size).astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' exactly: by floats where the lengths prove that no sum can round, else by 64-bit integers."""
    longest = [float((m.astype(np.float64) ** 2).sum(1).max(initial=0.0)) for m in (a, b)]
    if longest[0] * longest[1] < 2.0 ** 104:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Tree:
    """Split points, children and distance ranges. A child is another node or, below zero, ~leaf."""

    def __init__(self, sample: np.ndarray, longest: int, rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS):
        self.longest, self.fanout, self.leaf_rows, self.leaves = longest, fanout, leaf_rows, 0
        self.splits: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        points = self.lifted(sample)
        self.root = self._grow(points, rows / max(len(points), 1))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the extra part that gives all the greatest length."""
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1, keepdims=True), 0))], 1)

    def asking(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], 1)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves  # ~(leaves - 1)

    def _grow(self, points: np.ndarray, weight: float) -> int:
        if len(points) * weight <= self.leaf_rows or len(points) < 2 * self.fanout:
            return self._leaf()
        splits = [points[0]]
        for _ in range(self.fanout - 1):  # the farthest of some candidates from those chosen already
            far = distances(points[:4 * self.fanout], np.array(splits)).min(1)
            if far.max() <= SLACK * np.sqrt(self.longest):
                break
            splits.append(points[int(np.argmax(far))])
        if len(splits) == 1:
            return self._leaf()
        number, count = len(self.splits), len(splits)
        self.splits.append(np.array(splits))
        self.children.append([])
        self.low.append(np.full((count, count), np.inf))
        self.high.append(np.full((count, count), -np.inf))
        nearest = distances(points, self.splits[number]).argmin(1)
        self.children[number] = [self._grow(points[nearest == j], weight) for j in range(count)]
        return number

    def walk(self, lifted: np.ndarray, see: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """The leaf of each row; ``see`` is shown each node with its rows' distances to the split points and their child."""
        out, todo = np.zeros(len(lifted), np.int32), [(self.root, np.arange(len(lifted)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            found = distances(lifted[rows], self.splits[node])
            nearest = found.argmin(1)
            if see is not None:
                see(node, found, nearest)
            todo += [(child, rows[nearest == j]) for j, child in enumerate(self.children[node]) if (nearest == j).any()]
        return out

    def annuli(self, norm: int, windows: list[tuple[int, int]]) -> np.ndarray:
        """Least and greatest distance from a query of that squared length for each window of scores."""
        total = float(norm + self.longest)
        bounds = [(max(total - 2.0 * high, 0.0), max(total - 2.0 * low, 0.0)) for low, high in windows]
        slack = SLACK * (np.sqrt(norm) + np.sqrt(self.longest))
        return np.sqrt(np.array(bounds)) + [-slack, slack]

    def visited(self, query: np.ndarray, annuli: np.ndarray) -> list[int]:
        """Leaves that may hold a row in one of the annuli."""
        leaves, todo, inner, outer = [], [self.root], annuli[:, :1], annuli[:, 1:]
        while todo:
            node = todo.pop()
            if node < 0:
                leaves.append(~node)
                continue
            to = distances(query[None, :], self.splits[node])  # 1 x split points
            least, most = np.maximum(to - outer, inner - to), to + outer  # windows x split points
            meet = (self.low[node] <= most[:, :, None]) & (self.high[node] >= least[:, :, None])
            alive = meet.all(1).any(0)
            todo += [child for child, live in zip(self.children[node], alive) if live]
        return leaves


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _with_ranges(tree: Tree, routed: DataFrame, size: int) -> Tree:
    """The tree with the ranges of all rows: each task brings one least and greatest distance a split point and sibling."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [m.copy() for m in tree.low], [m.copy() for m in tree.high]

        def see(node: int, found: np.ndarray, nearest: np.ndarray) -> None:
            for j in np.unique(nearest):
                own = found[nearest == j]
                low[node][:, j] = np.minimum(low[node][:, j], own.min(0))
                high[node][:, j] = np.maximum(high[node][:, j], own.max(0))

        for batch in batches:
            if batch.num_rows:
                tree.walk(tree.lifted(matrix(batch.column(0).to_pylist(), size)), see)
        for node, (least, most) in enumerate(zip(low, high)):
            i, j = np.nonzero(least < np.inf)
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), node, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                     pa.array(least[i, j]), pa.array(most[i, j])], ["node", "split", "child", "low", "high"],
                )

    found = routed.select("x").mapInArrow(measure, "node int, split int, child int, low double, high double")
    for r in found.groupBy("node", "split", "child").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[r.node][r.split, r.child], tree.high[r.node][r.split, r.child] = r.low, r.high
    return tree


def _blocks(rows: DataFrame, columns: str, most: int) -> DataFrame:
    """Rows of a leaf put together, at most so many a block: each column becomes an array. Leaves are dealt in salted parts."""
    names = columns.split()
    schema = pa.schema([("leaf", pa.int32())] + [(n, pa.list_(pa.binary() if n == "x" else pa.int64())) for n in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        last = None

        def block() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([last], pa.int32())] + [pa.array([held[n]], schema.field(n).type) for n in names], schema=schema)
            for values in held.values():
                values.clear()
            return out

        for batch in batches:
            for leaf, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if held[names[0]] and (leaf != last or len(held[names[0]]) >= most):
                    yield block()
                last = leaf
                for n, v in zip(names, values):
                    held[n].append(v)
        if held[names[0]]:
            yield block()

    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(names[0]), F.lit(SALTS))).repartition("leaf", "salt").sortWithinPartitions("leaf")
    types = ", ".join(f"{n} array<{'binary' if n == 'x' else 'bigint'}>" for n in names)
    return dealt.select("leaf", *names).mapInArrow(pack, f"leaf int, {types}")


_VISIT = (
    "leaf int, class_id array<bigint>, label array<bigint>, x array<binary>, asker array<int>, low array<bigint>, high array<bigint>, "
    "positive array<bigint>"
)
_VISIT_TYPES = pa.schema([
    ("leaf", pa.int32()), ("class_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("x", pa.list_(pa.binary())),
    ("asker", pa.list_(pa.int32())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("positive", pa.list_(pa.int64())),
])


def _visits(queries: DataFrame, tree: Tree, size: int, most: int, own_leaf: bool = False) -> DataFrame:
    """Which queries visit which leaf: neighbouring queries are put together, and one row a leaf and such a block names those of
    its queries that visit the leaf, with the windows of each (``asker`` is the place of a window's query)."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.walk(tree.lifted(matrix(batch.column(3).to_pylist(), size)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "class_id", "label", "norm", "x", "windows"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            leaves: dict[int, list[int]] = {}
            for place, (leaf, _, _, norm, x, windows) in enumerate(held):
                bounds = [(w["low"], w["high"]) for w in windows]
                own = [leaf] if own_leaf else tree.visited(tree.asking(matrix([x], size))[0], tree.annuli(norm, bounds)) if bounds else []
                for one in own:
                    leaves.setdefault(one, []).append(place)
            for leaf, places in sorted(leaves.items()):
                windows = [(i, w["low"], w["high"], w["positive"]) for i, p in enumerate(places) for w in held[p][5]]
                columns = [[held[p][c] for p in places] for c in (1, 2, 4)] + [list(c) for c in zip(*windows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([leaf], pa.int32())] + [pa.array([c], t) for c, t in zip(columns, _VISIT_TYPES.types[1:])], schema=_VISIT_TYPES
                )

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) >= most:
                    yield from settle(held)
                    held = []
        yield from settle(held)

    windows = "array<struct<low:bigint,high:bigint,positive:bigint>>"
    routed = queries.select("class_id", "label", "norm", "x", "windows").mapInArrow(
        route, f"leaf int, class_id bigint, label bigint, norm bigint, x binary, windows {windows}"
    )
    return routed.repartitionByRange("leaf", "class_id").sortWithinPartitions("leaf").mapInArrow(visit, _VISIT)


def _searched(visits: DataFrame, blocks: DataFrame, size: int, same_label: bool, first: int) -> DataFrame:
    """The ``first`` rows of each query's window (class_id, positive, vec_id, score): best scores, then smaller ids."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                class_id, label, x, asker, low, high, positive, vec_id, row_label, row_x = (c[r].values for c in batch.columns)
                class_id, label, asker, low, high, positive, vec_id, row_label = (
                    c.to_numpy() for c in (class_id, label, asker, low, high, positive, vec_id, row_label))
                found = inner_products(matrix(x.to_pylist(), size), matrix(row_x.to_pylist(), size))
                # A query's windows follow each other: rows outside all of them go at once, the few others are sorted once a query.
                queries = np.arange(len(class_id))
                turn = np.searchsorted(asker, queries)
                fits = (label[:, None] == row_label) == same_label
                fits &= found >= np.minimum.reduceat(low, turn)[:, None]
                fits &= found <= np.maximum.reduceat(high, turn)[:, None]
                i, j = np.nonzero(fits)
                order = np.lexsort([vec_id[j], -found[i, j], i])
                i, j = i[order], j[order]
                scores, begin = found[i, j], np.searchsorted(i, queries)
                times = np.bincount(i, minlength=len(queries))[asker]
                window = np.repeat(np.arange(len(asker)), times)
                at = np.arange(len(window)) + (begin[asker] - np.cumsum(times) + times)[window]
                inside = (scores[at] >= low[window]) & (scores[at] <= high[window])
                window, at = window[inside], at[inside]
                place = np.arange(len(window)) - np.searchsorted(window, window)
                window, at = window[place < first], at[place < first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_id[asker[window]]), pa.array(positive[window]), pa.array(vec_id[j[at]]), pa.array(scores[at])],
                    ["class_id", "positive", "vec_id", "score"],
                )

    # Sizes of what tasks make are unknown to the planner, so it may not broadcast: both sides are shuffled, hot leaves split.
    pairs = visits.hint("merge").join(blocks, "leaf").select(
        "class_id", "label", "x", "asker", "low", "high", "positive", "row_id", "row_label", "row_x"
    )
    found = pairs.mapInArrow(score, "class_id bigint, positive bigint, vec_id bigint, score bigint")
    return _first(found, ["class_id", "positive"], [F.desc("score"), F.asc("vec_id")], first).drop("rank")


def _first(rows: DataFrame, keys: list[str], order: list[Column], first: int) -> DataFrame:
    """The first rows of each key, numbered; the limit is applied within tasks before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= first)


def _window(low: Column, high: Column, positive: Column) -> Column:
    return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), positive.cast("bigint").alias("positive"))


def _mine(rows: DataFrame, size: int, every: int, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """Hard negatives of stored rows (vec_id, label, norm, x) of one length."""
    # Ties go to smaller ids, so of rows equal in label and vector only the first few can be in any list.
    kept = store(_first(rows, ["label", "x"], [F.asc("vec_id")], max(positives + 1, negatives)).drop("rank"), "candidates")
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    classes = store(anchors.groupBy("label", "norm", "x").agg(F.min("vec_id").alias("class_id")), "anchor-classes")
    whole = kept.agg(F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("x").collect()
    tree = Tree(matrix([r.x for r in sample], size), whole.longest or 0, whole.n)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.walk(tree.lifted(matrix(batch.column(2).to_pylist(), size)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "row_id", "row_label", "x"])

    routed = store(kept.select("vec_id", "label", "x").mapInArrow(route, "leaf int, row_id bigint, row_label bigint, x binary"), "routed")
    tree = _with_ranges(tree, routed, size)
    blocks = _blocks(routed.select("leaf", "row_id", "row_label", "x"), "row_id row_label x", max(BLOCK_PARTS // size, 8))
    blocks = store(blocks.withColumnRenamed("x", "row_x"), "row-blocks")
    together = max(QUERY_PARTS // size, 4)
    lowest, highest = F.lit(-NORM_LIMIT), F.lit(NORM_LIMIT)

    # Positives: the own leaf gives each class a score that its list reaches at least; then all leaves that may hold better rows.
    anything = F.array(_window(lowest, highest, F.lit(0)))
    near = _searched(_visits(classes.withColumn("windows", anything), tree, size, together, own_leaf=True), blocks, size, True, positives + 1)
    reached = near.groupBy("class_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") > positives).drop("n")
    bounded = classes.join(reached, "class_id", "left").withColumn("windows", F.array(_window(F.coalesce("low", lowest), highest, F.lit(0))))
    best = store(_searched(_visits(bounded, tree, size, together), blocks, size, True, positives + 1).drop("positive"), "positives")

    # Negatives: a window of scores for every positive; the whole-number bound below is least / most of it, rounded up.
    low = F.ceil(F.col("score").cast("decimal(38,0)") * F.lit(least) / F.lit(most))
    wanted = best.where("score >= 0").groupBy("class_id").agg(F.collect_list(_window(low, F.col("score"), F.col("vec_id"))).alias("windows"))
    visits = _visits(classes.join(wanted, "class_id"), tree, size, together)
    hard = store(_searched(visits, blocks, size, False, negatives), "negatives")

    own = anchors.join(classes, ["label", "norm", "x"]).select(F.col("vec_id").alias("anchor_id"), "class_id")
    others = own.join(best, "class_id").where(F.col("vec_id") != F.col("anchor_id"))
    chosen = _first(others, ["anchor_id"], [F.desc("score"), F.asc("vec_id")], positives)
    chosen = chosen.select("anchor_id", "class_id", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    ranked = _first(hard, ["class_id", "positive"], [F.desc("score"), F.asc("vec_id")], negatives)
    return chosen.join(ranked, ["class_id", "positive"]).select(
        "anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``. Scores are inner products of whole numbers floor(256 c). An anchor's
    positives are the first other rows of its label; for each, the first rows of other labels with least * positive_score <=
    most * negative_score <= most * positive_score. Higher scores come first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, an empty vector, a null or non-finite part, or a squared whole-number length of about
    2^62 or more take no part. Vectors compare with those of their own length only; each length takes a pass. A vec_id that repeats
    stands for one row: that of smallest label, then length, then vector. Other columns are ignored; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    first = F.min(F.struct("label", "size", "norm", "x")).alias("row")
    rows = store(whole_rows(vectors).groupBy("vec_id").agg(first).select("vec_id", "row.*"), "whole-rows")
    sizes = sorted(r.size for r in rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("size").distinct().collect())
    found = [_mine(rows.where(F.col("size") == size).drop("size"), size, every, positives, negatives, least, most) for size in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], ROWS)
