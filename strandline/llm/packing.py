"""Hierarchical multi-length packing of documents into training sequences.

A document's whole windows of the longest size leave as they are. What is left is routed to the shortest tier (context
size) that holds it. Each tier is packed from its longest piece on; the gap of a window is filled with the longest pieces
that fit from the same or shorter tiers, and a last piece is cut to close it. Every window is thus exactly full. Windows of
one tier are dealt into step groups of equal tokens.

A task packs the documents of its own partition in one pass over a bounded buffer: nothing is shuffled, and what a
partition has left at its end leaves in windows of shrinking powers of two, so no sequence is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import give_back, prepare, text_or_empty
from strandline.llm.tokens import DEFAULT_TOKENIZER, encoder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 16
BUFFER_TOKENS = 1 << 21
ROWS = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_tokens bigint, step_group bigint"
)
_NAMES = [part.split()[0] for part in ROWS.split(", ")]
_OUT = pa.schema([(name, pa.int64()) for name in _NAMES])


class Packer:
    """Packs pieces (ids, doc_id, start, doc_tokens) and yields full sequences as lists of pieces."""

    def __init__(self, tiers: tuple[int, ...], buffer_tokens: int):
        self.tiers, self.buffer_tokens = tuple(sorted(tiers)), buffer_tokens
        self.waiting: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # (tokens, number) a tier, ascending
        self.pieces: dict[int, tuple] = {}
        self.held = self.number = 0

    def _route(self, piece: tuple) -> None:
        tokens = len(piece[0])
        tier = next(t for t in self.tiers if t >= tokens)
        self.number += 1
        self.pieces[self.number] = piece
        insort(self.waiting[tier], (tokens, self.number))
        self.held += tokens

    def _take(self, tier: int, at: int) -> tuple:
        tokens, number = self.waiting[tier].pop(at)
        self.held -= tokens
        return self.pieces.pop(number)

    def add(self, ids: np.ndarray, doc_id: int | None) -> Iterator[list[tuple]]:
        longest, total = self.tiers[-1], len(ids)
        whole = total - total % longest
        for start in range(0, whole, longest):
            yield [(ids[start:start + longest], doc_id, start, total)]
        if whole < total:
            self._route((ids[whole:].copy(), doc_id, whole, total))
        if self.held >= self.buffer_tokens:
            yield from self._pack(keep=2 * longest)

    def _fill(self, tier: int) -> list[tuple]:
        """One full window of a tier whose pieces and those of all tiers hold enough tokens."""
        window = [self._take(tier, -1)]
        gap = tier - len(window[0][0])
        while gap:
            for source in reversed([t for t in self.tiers if t <= tier]):
                at = bisect_right(self.waiting[source], (gap, self.number)) - 1
                if at >= 0:
                    window.append(self._take(source, at))
                    break
            else:  # nothing fits whole: cut the shortest piece there is
                source = next(t for t in self.tiers if self.waiting[t])
                ids, doc_id, start, total = self._take(source, 0)
                window.append((ids[:gap], doc_id, start, total))
                self._route((ids[gap:], doc_id, start + gap, total))
            gap = tier - sum(len(p[0]) for p in window)
        return window

    def _pack(self, keep: int) -> Iterator[list[tuple]]:
        for tier in reversed(self.tiers):
            while self.waiting[tier] and self.held >= max(keep, tier):
                yield self._fill(tier)

    def finish(self) -> Iterator[list[tuple]]:
        """The rest: full windows, then windows of falling powers of two, each exactly full."""
        yield from self._pack(keep=0)
        rest = [self._take(t, -1) for t in reversed(self.tiers) for _ in range(len(self.waiting[t]))]
        left = sum(len(p[0]) for p in rest)
        while left:
            size, window = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                ids, doc_id, start, total = rest.pop()
                window.append((ids[:size], doc_id, start, total))
                if len(ids) > size:
                    rest.append((ids[size:], doc_id, start + size, total))
                size -= len(window[-1][0])
            yield window


def pack_documents(
    docs: DataFrame, tiers: tuple[int, ...] = TIERS, end_id: int = 2, tokenizer: str = DEFAULT_TOKENIZER,
    step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """One row a piece: where a run of a document's ids lies in which sequence.

    Tiers are powers of two. A null text is empty: its document is the end id alone. Null and repeated doc_ids are packed
    like others, each row as a document of its own. Other columns are ignored; an empty table gives no rows. Sequence and
    group numbers carry the partition in their upper bits.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(tiers, buffer_tokens)
        end, base = np.array([end_id], enc.dtype), TaskContext.get().partitionId() << 33
        sequence, group, groups = base, base, {}  # groups: tier -> (group, tokens it can still take)
        out: list[tuple] = []

        def emit(window: list[tuple]) -> None:
            nonlocal sequence, group
            size = sum(len(p[0]) for p in window)
            tier = size if size in tiers else 0
            mine, room = groups.get(tier, (None, 0))
            if room < size:
                mine, room = group, step_tokens
                group += 1
            groups[tier] = (mine, room - size)
            offset = 0
            for ids, doc_id, start, total in window:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, size, mine))
                offset += len(ids)
            sequence += 1

        def ready() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_OUT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for window in packer.add(np.concatenate([enc.encode(text), end]), doc_id):
                    emit(window)
            if len(out) >= 1024:
                yield ready()
        for window in packer.finish():
            emit(window)
        if out:
            yield ready()
        give_back()

    return rows.mapInArrow(pack, ROWS)
