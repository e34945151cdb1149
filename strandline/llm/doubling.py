"""Substring de-duplication by doubling the length of repeated windows of words.

Lengths are halved from the sought window down to a shortest one: 50, 25, 13, 7. Each window of the sought length is
represented at the shortest length by its anchor (see anchors), at each further length by a window that holds the one before
and lies within the sought window; which one is told by the anchor's place in it. Equal windows thus have equal representatives
at every length. A representative that occurs in one document only falls out with all windows it stands for; the others alone
are extended to twice the length, until none is left or the sought length is reached. There, where all occurrences of a
survivor have equal surroundings, its windows are settled together; the others are cut out one by one, named by the hashes of
their two halves, and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.anchors import CHUNK, PLACE_BITS, Rolling, marked, mix, sliding_min
from strandline.llm.shared import prepare, store
from strandline.llm.spans import NO_ID, gather, keyed, with_spans

WINDOW = 50
SHORTEST = 7  # no window is halved below this length
CACHE_WORDS = 200_000
_WINDOWS = pa.schema([(n, pa.int64()) for n in ("left", "right", "key", "text_hash", "first")])
DIGESTS = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _hashed(found: list[bytes], cache: _Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def ladder(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths from the shortest to the sought one, each at most twice the one before."""
    lengths = [window]
    while (half := (lengths[0] + 1) // 2) >= shortest and half < lengths[0] or len(lengths) == 1:
        lengths.insert(0, half)
    return lengths


def extensions(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How an anchor at each place of a window grows: the number of its way, and for each way the starts from the anchor on.

    A window grows to the right where the longer one still ends within the sought window, else to the left.
    """
    window, ways = lengths[-1], {}
    way_of = np.empty(window - lengths[0] + 1, np.int64)
    for place in range(len(way_of)):
        at, starts = place, [0]
        for short, long in zip(lengths[:-2], lengths[1:-1]):
            at = at if at + long <= window else at + short - long
            starts.append(at - place)
        way_of[place] = ways.setdefault(tuple(starts), len(ways))
    return way_of, np.array(list(ways), np.int64)


def doubling_runs(tokens: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Consecutive windows that share their representatives at all lengths, some columns for each chunk of a long text.

    Columns: the representative of each length below the sought one, first and last start, hash of the run's words and shape.
    """
    window, gram = lengths[-1], lengths[0]
    way_of, ways = extensions(lengths)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for base in range(0, max(len(tokens) - window + 1, 0), CHUNK):
        rolling = Rolling(tokens[base:base + CHUNK + window - 1])
        hashes = rolling.every(gram)
        packed = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))  # the last one of several least
        place = (mask - (sliding_min(packed, window - gram + 1) & mask)).astype(np.int64)
        way = way_of[place - np.arange(len(place))]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(way) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
        anchor, way = place[first], way[first]
        shape = mix(((anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64))
        levels = []
        for n, length in enumerate(lengths[:-1]):
            at = anchor + ways[way, n]
            levels.append(rolling.at(at, at + length) ^ mix(way.astype(np.uint64)))
        yield (*levels, first + base, last + base, rolling.at(first, last + window) ^ shape)


def word_runs(rows: DataFrame, window: int, shortest: int = SHORTEST) -> DataFrame:
    """Runs of windows of all texts: level_0, level_1, ..., key, text_hash, first and last start, hash of the run's words."""
    lengths = ladder(window, shortest)
    names = [f"level_{n}" for n in range(len(lengths) - 1)] + ["key", "text_hash", "first", "last", "shape"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, schema = _Hashes(), pa.schema([(n, pa.int64()) for n in names])
        for batch in batches:
            parts = []
            for key, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                for *levels, first, last, shape in doubling_runs(_hashed(words(text), cache), lengths):
                    fixed = np.full((2, len(first)), [[key], [text_hash]], np.int64)
                    parts.append((*levels, *fixed, first, last, shape))
            if parts:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*parts)], schema=schema)

    return rows.mapInArrow(scan, ", ".join(f"{n} bigint" for n in names))


def _cut_windows(rows: DataFrame, window: int) -> DataFrame:
    """Every window of the runs listed with each text, named by the hashes of its two halves (they may overlap by a word)."""
    half = (window + 1) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            parts, held = [], 0
            for key, text_hash, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = _hashed(words(text), cache)
                spans = sorted((r["first"], r["last"]) for r in found)
                for base in range(0, len(tokens) - window + 1, CHUNK):  # long texts chunk by chunk
                    here = [(max(a, base) - base, min(b, base + CHUNK - 1) - base) for a, b in spans if b >= base and a < base + CHUNK]
                    if not here:
                        continue
                    rolling = Rolling(tokens[base:base + CHUNK + window - 1])
                    at = np.concatenate([np.arange(a, b + 1) for a, b in here])
                    fixed = np.full((2, len(at)), [[key], [text_hash]], np.int64)
                    parts.append((rolling.at(at, at + half), rolling.at(at + window - half, at + window), *fixed, at + base))
                    held += len(at)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*parts)], schema=_WINDOWS)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*parts)], schema=_WINDOWS)

    return rows.mapInArrow(cut, "left bigint, right bigint, key bigint, text_hash bigint, first bigint")


def survivors(runs: DataFrame, level: str) -> DataFrame:
    """Runs whose representative of this level occurs in two documents, without that level."""
    twice = runs.groupBy(level).agg(F.min("key").alias("least"), F.max("key").alias("most")).where(F.col("least") < F.col("most"))
    twice = store(twice.select(level), f"repeated-{level}")  # a table, so the join can split what many runs share
    return store(runs.join(twice, level).drop(level), f"after-{level}")


def repeated_spans(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """Word spans covered by windows that also start in a document with a smaller doc_id, one array a text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = keyed(docs)
    runs = store(word_runs(rows.where(F.col("key") != NO_ID), window, shortest), "word-runs")
    *shorter, level = [c for c in runs.columns if c.startswith("level_")]
    for name in shorter:
        runs = survivors(runs, name)
    twice = runs.groupBy(level).agg(
        F.min("key").alias("least"), F.max("key").alias("most"), (F.min("shape") == F.max("shape")).alias("alike")
    ).where(F.col("least") < F.col("most")).drop("most")
    twice = store(twice, "repeated-runs")
    live = runs.join(twice, level).where(~F.col("alike") | (F.col("key") > F.col("least")))
    live = store(live.select("key", "text_hash", "first", "last", "alike"), "live-runs")

    open_runs = live.where(~F.col("alike")).groupBy("key", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    texts = rows.join(open_runs, ["key", "text_hash"]).select("key", "text_hash", "text", "runs")
    cut = store(_cut_windows(texts, window), "word-windows")
    seen = cut.groupBy("left", "right").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    seen = store(seen.where(F.col("least") < F.col("most")).drop("most"), "repeated-windows")
    late = cut.join(seen, ["left", "right"]).where(F.col("key") > F.col("least"))
    whole = live.where("alike").select("key", "text_hash", "first", (F.col("last") + window).alias("end"))
    return gather(whole.unionByName(late.select("key", "text_hash", "first", (F.col("first") + window).alias("end"))))


def substring_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document.

    A null text has no words. Documents shorter than a window lose nothing. A null doc_id is neither smaller nor larger than
    another: such rows lose nothing and cost others nothing. Rows that repeat a doc_id are documents of their own which do
    not count as smaller to each other. Other columns are ignored.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                found = words(text)
                gone = marked(len(found), [(s["first"], s["end"]) for s in spans])
                kept = [w for w, g in zip(found, gone.tolist()) if not g] if spans else found
                out.append((doc_id, len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = with_spans(docs, repeated_spans(docs, window))
    return found.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "text", "spans").mapInArrow(digest, DIGESTS)
