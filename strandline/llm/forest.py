"""N-gram Jaccard join by a MinHash LSH forest.

Each of many trees gives a text a label of several MinHash values; a tree's labels form a trie. Matching starts at whole labels.
Texts that share a prefix are compared with the smallest of them by all their MinHash values; those nearly equal to it stop
there and are represented by it in this tree, as whoever shares a shorter prefix with them shares it with their head. For the
others the prefix is shortened by a value, down to the depth at which a pair at the threshold meets in some tree with the target
recall. So each text's prefix is shortened only as far as its matches ask for, and crowds of copies are gone before short
prefixes gather them. Texts that meet are grouped by their signatures and verified on their whole shingle sets.

Texts with the same shingle set are one class and are compared once, as a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.anchors import CHUNK, Rolling
from strandline.llm.grouping import candidate_edges, components, linked_components, verified_links
from strandline.llm.shared import folded_words, give_back, prepare, store
from strandline.llm.spans import NO_ID, doc_key, keyed
from strandline.llm.tokens import release

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 6  # MinHash values of a label, 10 bits each
VALUE_BITS = 10
RECALL = 0.9999
SETTLE, EDGE = 0.8, 0.4  # estimated similarity to a bucket's head: settled, and edge (see grouping)
STOP = 0.95  # estimated similarity to a head at which a text goes no further up a tree; leaves room for a second head
CACHE_WORDS = 200_000
_SCAN = pa.schema([
    ("key", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("labels", pa.binary()),
])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def prefix_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in one of the trees with probability recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str, size: int, cache: _Hashes) -> np.ndarray:
    """Ascending distinct hashes of all runs of ``size`` words; of all words where there are fewer; empty without words."""
    words = folded_words(text)
    if not words:
        return np.empty(0, np.uint64)
    tokens = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    parts = [Rolling(tokens[b:b + CHUNK + size - 1]).every(size) for b in range(0, len(tokens) - size + 1, CHUNK)]
    return np.unique(np.concatenate(parts))


def minhash_labels(found: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One label a tree: the last bits of ``depth`` MinHash values side by side."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 64, trees * depth, np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 64, trees * depth, np.uint64)
    least = np.full(trees * depth, np.iinfo(np.uint64).max)
    for base in range(0, len(found), 1024):
        least = np.minimum(least, ((found[base:base + 1024, None] ^ shifts) * factors).min(0))
    values = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - VALUE_BITS)
    label = np.zeros(trees, np.uint64)
    for i in range(depth):
        label = (label << np.uint64(VALUE_BITS)) | values[i::depth]
    return label


def label_similarity(depth: int = DEPTH):
    """Share of equal MinHash values of two rows of labels."""
    mask = np.uint64((1 << VALUE_BITS) - 1)

    def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)
        equal = sum(((differ >> np.uint64(VALUE_BITS * i)) & mask == 0).sum(1) for i in range(depth))
        return equal / (depth * differ.shape[1])

    return estimate


def jaccard_links(threshold: float):
    """Exact comparison of shingle sets within a block or between two."""
    def link(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        sets = [np.frombuffer(s, np.uint64) for s in left + (right or [])]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = held[place] > 1
        column = np.cumsum(held > 1)[place[shared]] - 1
        owner, width, common = owner[shared], int((held > 1).sum()), np.zeros((len(left), len(sets) - (len(left) if right else 0)))
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for base in range(0, width, 4096):
            a, b = np.searchsorted(column, (base, base + 4096))
            grid = np.zeros((len(sets), 4096), np.float32)
            grid[owner[a:b], column[a:b] - base] = 1
            common += grid[:len(left)] @ (grid[len(left):] if right else grid).T
        n, m = sizes[:len(left), None], sizes[len(left):] if right else sizes
        return common >= threshold * (n + m - common) - 1e-9

    return link


def climb(tries: DataFrame, sketches: DataFrame, estimate, stop: float, edge: float) -> tuple[DataFrame, DataFrame]:
    """One depth of the forest: what goes on to shorter prefixes, (tree, prefix, node), and edges (a, b) to the heads.

    The smallest node of each prefix always goes on, so that whoever meets a stopped node later meets its head.
    tries: (tree, prefix, node), stored. sketches: (node, sketch), stored.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(estimate(own, other))], ["node", "head", "similar"])

    heads = store(tries.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "trie-heads")
    members = tries.join(heads.where("n > 1").drop("n"), ["tree", "prefix"]).where(F.col("node") != F.col("head"))
    members = store(members, "trie-members")
    met = (
        members.select("node", "head").distinct().join(sketches.withColumnRenamed("sketch", "own"), "node")
        .join(sketches.select(F.col("node").alias("head"), F.col("sketch").alias("other")), "head").select("node", "head", "own", "other")
    )
    met = store(met.mapInArrow(judge, "node binary, head binary, similar double"), "trie-pairs")
    on = members.join(met.where(F.col("similar") < stop), ["node", "head"]).select("tree", "prefix", "node")
    near = met.where(F.col("similar") >= edge).select(F.col("node").alias("a"), F.col("head").alias("b"))
    return heads.select("tree", "prefix", F.col("head").alias("node")).unionByName(on), near


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """One row a document: doc_id, class_id, class_size, n_links, component_id, kept, and the row's text_hash.

    class_id is the smallest doc_id with the same shingles, n_links the number of other classes at or above the threshold,
    component_id the smallest doc_id reachable by links; kept is doc_id = component_id. Texts without words (null ones too)
    are classes of their own, without links. Null doc_ids count as smaller than others; rows that repeat a doc_id and text
    share a class and all of its results. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    reach = prefix_depth(trees, depth, threshold, recall)
    rows = keyed(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache = _Hashes()
        for batch in batches:
            out = []
            for key, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text, size, cache)
                if len(found):
                    out.append((key, text_hash, xxhash.xxh3_128_digest(found.tobytes()), minhash_labels(found, trees, depth).tobytes()))
                else:
                    out.append((key, text_hash, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCAN.types)], schema=_SCAN)
        cache.clear()
        give_back()

    scanned = store(rows.mapInArrow(scan, "key bigint, text_hash bigint, node binary, labels binary"), "signatures")
    classes = store(scanned.where("node is not null").groupBy("node").agg(
        F.min(F.struct("key", "text_hash")).alias("first"), F.count(F.lit(1)).alias("class_size"), F.first("labels").alias("sketch")
    ), "classes")

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                each = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                nodes = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
                tree = pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([tree, pa.array(each), nodes], ["tree", "prefix", "node"])

    sketches, estimate, edges = classes.select("node", "sketch"), label_similarity(depth), []
    tries = store(sketches.mapInArrow(labels, "tree int, prefix bigint, node binary"), "forest")
    for _ in range(depth - reach):
        tries, near = climb(tries, sketches, estimate, STOP, EDGE)
        edges.append(near)
        tries = store(tries.withColumn("prefix", F.shiftrightunsigned("prefix", VALUE_BITS)), "forest")
    edges = reduce(DataFrame.unionByName, edges, candidate_edges(tries, sketches, estimate, SETTLE, EDGE))
    groups = store(components(edges), "candidate-groups")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            found = [shingles(t, size, cache).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "payload"])
        cache.clear()
        give_back()

    wanted = classes.join(groups, "node").select("node", "first.key", "first.text_hash")
    texts = rows.join(wanted, ["key", "text_hash"]).select("node", "text").dropDuplicates(["node"])
    links = store(verified_links(groups, texts.mapInArrow(sets, "node binary, payload binary"), jaccard_links(threshold)), "links")
    counts, roots = linked_components(links)
    found = classes.select("node", "class_size", F.col("first.key").alias("class_key")).join(roots, "node", "left").join(counts, "node", "left")
    found = store(found.withColumn("root", F.coalesce("root", "node")), "class-links")
    least = found.groupBy("root").agg(F.min("class_key").alias("component_key"))
    info = store(found.join(least, "root").select("node", "class_key", "class_size", "n_links", "component_key"), "class-results")

    number = lambda c: F.when(c != NO_ID, c)
    one = F.col("node").isNull()
    met = scanned.where(~one).select("key", "text_hash", "node").join(info, "node").drop("node").unionByName(
        scanned.where(one).select(
            "key", "text_hash", F.col("key").alias("class_key"), F.lit(1).cast("bigint").alias("class_size"),
            F.lit(None).cast("bigint").alias("n_links"), F.col("key").alias("component_key"),
        )
    )
    return met.select(
        number(F.col("key")).alias("doc_id"), number(F.col("class_key")).alias("class_id"), "class_size",
        F.coalesce("n_links", F.lit(0)).alias("n_links"), number(F.col("component_key")).alias("component_id"),
        (F.col("key") == F.col("component_key")).alias("kept"), "text_hash",
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without the near copies of others: the smallest doc_id of each component stays, with all its columns.

    Of rows that repeat a kept doc_id one stays, unless their texts have no words.
    """
    joined = store(jaccard_join(docs, **settings), "near-copies")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    kept = joined.where("kept").groupBy(key.alias("key"), "text_hash").agg(F.count(F.lit(1)).alias("n"), F.max("class_size").alias("size"))
    kept = store(kept, "kept-documents")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), doc_key().alias("key"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).join(kept, ["key", "text_hash"])
    again = (F.col("n") > 1) & (F.col("size") > 1)
    rows = rows.where(~again).unionByName(rows.where(again).dropDuplicates(["key", "text_hash"]))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
