"""Suffix-array de-duplication of byte strings, or of strings of words, with longest-previous-factor arrays.

Runs of windows chosen by content (see anchors) bring together, in one task, all places where a window may occur again. Equal
runs are counted once with their number. Where an anchor has several different runs, one of each is fetched, and their
windows' suffixes are sorted. In suffix order the nearest neighbours at smaller positions give every suffix the longest
factor it shares with an earlier one, and those at larger positions the longest shared with a later one.

Positions ascend by doc_id, then by the text's hash, then within the text. Words are runs of anything but ASCII white space; they
are compared by 64-bit hashes, so white space between them does not count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.anchors import CHUNK, Rolling, marked, mix, runs
from strandline.llm.shared import give_back, prepare, store
from strandline.llm.spans import gather, keyed, with_spans
from strandline.llm.tokens import release

LENGTH = 400
GRAM = 100
BATCH_BYTES = 1 << 20  # of runs whose suffixes are sorted together
GROUP_BYTES = 1 << 23  # of one anchor's different runs; beyond, windows are counted by a shuffle instead
_RUNS = pa.schema([(n, pa.int64()) for n in ("anchor", "key", "text_hash", "first", "last", "shape")])
_FOUND = "anchor bigint, shape bigint, places array<struct<first:bigint,last:bigint>>"
_PLACES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _tables(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


BYTE_HASHES, SECOND_HASHES = _tables(1), _tables(2)


class Bytes:
    """Texts as sequences of bytes."""

    dtype, size = np.dtype(np.uint8), 1

    def tokens(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)

    def hashes(self, tokens: np.ndarray) -> np.ndarray:
        return BYTE_HASHES[tokens]

    def second(self, tokens: np.ndarray) -> np.ndarray:
        return SECOND_HASHES[tokens]

    def gone(self, text: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
        """Which bytes of a text lie in spans of tokens."""
        return marked(len(text), spans)


class Words:
    """Texts as sequences of hashed words."""

    dtype, size = np.dtype("<u8"), 8
    _word = re.compile(rb"[^\x20\x09-\x0D]+")

    def tokens(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))

    def hashes(self, tokens: np.ndarray) -> np.ndarray:
        return tokens

    def second(self, tokens: np.ndarray) -> np.ndarray:
        return mix(tokens)

    def gone(self, text: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
        """From the first word of a run of marked ones to the next word that stays, or to the end of the last word."""
        places = [m.span() for m in self._word.finditer(text)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked(len(places), spans).astype(np.int8), [0]])))
        return marked(len(text), [
            (places[a][0], places[b][0] if b < len(places) else places[-1][1]) for a, b in zip(edges[::2], edges[1::2])
        ])


UNITS = {"bytes": Bytes(), "words": Words()}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def token_runs(rows: DataFrame, length: int, gram: int, unit: str = "bytes") -> DataFrame:
    kind = UNITS[unit]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = kind.tokens(text)
                for base in range(0, len(tokens) - length + 1, CHUNK):  # hashes of long texts chunk by chunk
                    anchor, first, last, shape = runs(kind.hashes(tokens[base:base + CHUNK + length - 1]), length, gram)
                    fixed = np.full((2, len(anchor)), [[key], [text_hash]], np.int64)
                    parts.append((anchor, *fixed, first + base, last + base, shape))
            if parts:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*parts)], schema=_RUNS)
        give_back()

    return rows.mapInArrow(scan, "anchor bigint, key bigint, text_hash bigint, first bigint, last bigint, shape bigint")


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal ones alike; the keys are overwritten."""
    order = np.argsort(keys)
    keys[:] = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]), dtype=np.int32)
    return rank


def _pairs(rank: np.ndarray, at: np.ndarray | None, ahead: int) -> np.ndarray:
    """Keys that sort by the rank of a place, then by that of the place so far ahead (0 beyond the end)."""
    if at is not None:
        return (rank[at].astype(np.int64) << 32) | rank[at + ahead]
    key = rank.astype(np.int64) << 32
    key[:max(len(rank) - ahead, 0)] |= rank[ahead:]
    return key


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the order of the ``length`` tokens from them, and the tokens each shares with the one before it; 0 below floor.

    Ranks of prefixes of twice the tokens come from those of half the length; 8 bytes are ranked at once, of which length must be
    at least one. With floor = length the shorter ranks are not kept.
    """
    size, span = len(text), 8 if text.dtype == np.uint8 else 1
    key = text.astype(np.uint64) if span == 1 else np.zeros(size, np.uint64)
    for i in range(span if span > 1 else 0):
        key <<= np.uint64(8)
        key[:max(size - i, 0)] |= text[i:]
    levels = {span: _dense(key)}
    del key
    while span * 2 <= length:
        levels[span * 2] = _dense(_pairs(levels[span], None, span))
        if floor >= length:
            del levels[span]
        span *= 2
    key = _pairs(levels[span], starts, length - span)
    order = np.argsort(key, kind="stable")
    key, place = key[order], starts[order]
    same = key[1:] == key[:-1]
    if floor >= length:
        return place, np.concatenate([[0], np.where(same, length, 0)])
    a, b = place[:-1], place[1:]
    common = np.zeros(len(a), np.int64)
    for level in sorted(levels, reverse=True):
        at = np.minimum(a + common, size - 1), np.minimum(b + common, size - 1)
        common += np.where((common + level <= length) & (levels[level][at[0]] == levels[level][at[1]]), level, 0)
    for _ in range(7):
        at = np.minimum(a + common, size - 1), np.minimum(b + common, size - 1)
        common += (common < length) & (text[at[0]] == text[at[1]])
    common = np.where(same, length, np.minimum(common, length))
    return place, np.concatenate([[0], np.where(common >= floor, common, 0)])


def _nearest_smaller(place: np.ndarray, shared: np.ndarray, floor: int) -> np.ndarray:
    """Bytes each suffix shares with the nearest one before it in the order whose position is smaller; 0 below floor.

    All suffixes jump at once: what lies between one and the place it points to is larger, so it may take over the pointer
    of a larger one. A suffix stops when it has found a smaller position or shares less than floor.
    """
    pointer, common = np.arange(-1, len(place) - 1), shared.copy()
    live = np.arange(1, len(place))
    while len(live):
        live = live[(common[live] >= floor) & (pointer[live] >= 0)]
        to = pointer[live]
        ahead = place[to] > place[live]
        live, to = live[ahead], to[ahead]
        less, on = np.minimum(common[live], common[to]), pointer[to]
        common[live], pointer[live] = less, on
    found = (pointer >= 0) & (common >= floor)
    return np.where(found, common, 0)


def longest_previous_factors(place: np.ndarray, shared: np.ndarray, floor: int = 1) -> np.ndarray:
    """For each suffix in suffix order the bytes it shares with some suffix at a smaller position; 0 below floor.

    The longest is with the nearest smaller position before it or after it in that order.
    """
    before = _nearest_smaller(place, shared, floor)
    turned = np.concatenate([[0], shared[:0:-1]])
    after = _nearest_smaller(place[::-1], turned, floor)[::-1]
    return np.maximum(before, after)


def repeated_starts(
    segments: list[bytes], counts: list[int], length: int, earlier_only: bool, dtype: np.dtype = Bytes.dtype
) -> list[np.ndarray]:
    """Which of the first ``counts`` windows of each segment occur earlier, or anywhere else. Segments ascend in position."""
    text = np.frombuffer(b"".join(segments), dtype)
    bases = np.cumsum([0] + [len(s) // dtype.itemsize for s in segments])
    starts = np.concatenate([np.arange(n) + b for b, n in zip(bases, counts)])
    place, shared = suffix_order(text, starts, length, length)
    again = longest_previous_factors(place, shared, length) >= length
    if not earlier_only:
        again |= longest_previous_factors(-place, shared, length) >= length
    flags = np.zeros(len(text), bool)
    flags[place[again]] = True
    return [flags[b:b + n] for b, n in zip(bases, counts)]


def _runs_of(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def _fetch(rows: DataFrame, wanted: DataFrame, length: int, kind: Bytes | Words) -> DataFrame:
    """The tokens of one occurrence of each wanted run; texts are joined with the list of what is wanted of them."""
    lists = wanted.groupBy("key", "text_hash").agg(F.collect_list(F.struct("anchor", "shape", "first", "last", "hot")).alias("runs"))
    texts = rows.join(lists, ["key", "text_hash"]).select("key", "text_hash", "text", "runs")
    out = pa.schema([
        ("anchor", pa.int64()), ("shape", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()),
        ("hot", pa.bool_()), ("bytes", pa.binary()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, text_hash, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = kind.tokens(text)
                parts += [
                    (r["anchor"], r["shape"], key, text_hash, r["first"], r["hot"], tokens[r["first"]:r["last"] + length].tobytes())
                    for r in found
                ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), out.types)], schema=out)

    return texts.mapInArrow(
        cut, "anchor bigint, shape bigint, key bigint, text_hash bigint, first bigint, hot boolean, bytes binary"
    )


def _sorted_places(cut: DataFrame, length: int, earlier_only: bool, kind: Bytes | Words) -> DataFrame:
    """Suffix sorting: whole anchors, batch by batch of bounded size."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: dict) -> pa.RecordBatch | None:
            rows = sorted(held.items(), key=lambda x: x[1][:3])
            counts = [len(r[3]) // kind.size - length + 1 for _, r in rows]
            flags = repeated_starts([r[3] for _, r in rows], counts, length, earlier_only, kind.dtype)
            found = [(a, s, _runs_of(f)) for ((a, s), _), f in zip(rows, flags) if f.any()]
            if not found:
                return None
            anchors, shapes, places = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(shapes, pa.int64()), pa.array(places, _PLACES)], ["anchor", "shape", "places"]
            )

        release()
        held, size, last = {}, 0, None
        for batch in batches:
            for anchor, shape, key, text_hash, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH_BYTES and anchor != last:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = {}, 0
                if (anchor, shape) not in held:
                    size += len(raw)
                held[anchor, shape] = (key, text_hash, first, raw)
                last = anchor
        if held and (out := solve(held)) is not None:
            yield out
        held.clear()
        give_back()

    rows = cut.where(~F.col("hot")).select("anchor", "shape", "key", "text_hash", "first", "bytes")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, _FOUND)


def _counted_places(cut: DataFrame, length: int, earlier_only: bool, kind: Bytes | Words) -> DataFrame:
    """The same for anchors with too many different runs for one task: windows meet by their 128-bit hashes in a shuffle."""
    names = ("anchor", "shape", "key", "text_hash", "first", "off", "left", "right")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, shape, key, text_hash, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                code = np.frombuffer(raw, kind.dtype)
                left, right = Rolling(kind.hashes(code)).every(length), Rolling(kind.second(code)).every(length)
                fixed = np.full((5, len(left)), [[anchor], [shape], [key], [text_hash], [first]], np.int64)
                yield pa.RecordBatch.from_arrays([_signed(c) for c in (*fixed, np.arange(len(left)), left, right)], list(names))

    rows = cut.where("hot").select("anchor", "shape", "key", "text_hash", "first", "bytes").dropDuplicates(["anchor", "shape"])
    every = rows.mapInArrow(windows, ", ".join(f"{n} bigint" for n in names))
    place = F.struct("key", "text_hash", F.col("first") + F.col("off"))
    every = store(every.withColumn("place", place).drop("key", "text_hash", "first"), "hot-windows")
    twice = every.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("earliest")).where("n > 1")
    again = every.join(twice, ["left", "right"])
    if earlier_only:
        again = again.where(F.col("place") != F.col("earliest"))
    return again.groupBy("anchor", "shape").agg(F.collect_list(F.struct(F.col("off").alias("first"), F.col("off").alias("last"))).alias("places"))


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, group_bytes: int = GROUP_BYTES, unit: str = "bytes"
) -> DataFrame:
    """Spans covered by strings of ``length`` bytes (or words) that also start earlier (or anywhere else, without keep_first).

    The lists of places of a run are bounded by its windows. Rows equal in doc_id and text share one position: without
    keep_first each repeats the other, with it both keep what is first in one of them.
    """
    prepare(docs.sparkSession)
    kind, rows = UNITS[unit], keyed(docs)
    level = store(token_runs(rows, length, gram, unit), "token-runs")
    twice = level.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("shape") == F.max("shape")).alias("alike")
    ).where("n > 1").drop("n")
    twice = store(twice, "repeated-anchors")  # a table of its own, so the join can split an anchor that many runs share
    live = store(level.join(twice, "anchor"), "live-token-runs")
    place = F.struct("key", "text_hash", "first", "last")
    kinds = live.groupBy("anchor", "shape", "alike").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("earliest"))
    kinds = store(kinds, "run-kinds")

    several = kinds.where(~F.col("alike")).select("anchor", "shape", "earliest.*")
    crowded = several.groupBy("anchor").agg(F.sum((F.col("last") - F.col("first") + length) * kind.size).alias("size")).where(F.col("size") > group_bytes)
    several = several.join(crowded.withColumn("hot", F.lit(True)), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = store(_fetch(rows, several, length, kind), "cut-runs")
    found = _sorted_places(cut, length, keep_first, kind).unionByName(_counted_places(cut, length, keep_first, kind))
    known = store(kinds.join(found, ["anchor", "shape"], "left"), "run-places")

    first = F.col("earliest.first") == F.col("first")
    is_first = first & (F.col("earliest.key") == F.col("key")) & (F.col("earliest.text_hash") == F.col("text_hash"))
    all_again = ~is_first if keep_first else F.col("n") > 1
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("first"), (F.col("last") - F.col("first")).alias("last")))
    spans = (
        live.drop("alike").join(known, ["anchor", "shape"])
        .select("key", "text_hash", F.col("first").alias("base"), F.when(all_again, whole).otherwise(F.col("places")).alias("places"))
        .select("key", "text_hash", "base", F.explode_outer("places").alias("p")).where("p is not null")
        .select("key", "text_hash", (F.col("base") + F.col("p.first")).alias("first"), (F.col("base") + F.col("p.last") + length).alias("end"))
    )
    return gather(spans)


def suffix_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes of every document.

    A null text is empty. Null and repeated doc_ids are documents like others. Other columns are ignored.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                gone = marked(len(raw), [(s["first"], s["end"]) for s in spans])
                kept = raw[~gone].tobytes()
                n_spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                out.append((doc_id, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    found = with_spans(docs, repeated_spans(docs, length, gram, keep_first))
    return found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "text", "spans").mapInArrow(digest, DIGESTS)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = "bytes") -> DataFrame:
    """docs with the later copies cut out of their texts, the first kept; all other columns stay, null texts stay null.

    A character of which a span takes some bytes goes whole; words go with the white space up to the next word that stays. A text
    that is all copies becomes empty (or keeps the white space at its ends). Rows that repeat, null doc_ids included, are
    documents like others; rows equal in doc_id and text share one position and lose nothing to each other. An empty table stays
    empty.
    """
    kind = UNITS[unit]

    @F.udf("string", useArrow=True)
    def kept(text: str, spans: list) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        gone = kind.gone(raw, [(s["first"], s["end"]) for s in spans])
        return np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")

    found = with_spans(docs, repeated_spans(docs, length, gram, keep_first=True, unit=unit))
    text = F.when(F.size("spans") > 0, kept("text", "spans")).otherwise(F.col("row.text"))
    return found.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
