"""Token counts by finite-state machines compiled from a byte-level BPE vocabulary.

Two deterministic transducers stand for the tokenizer. The first reads classes of characters and marks where pre-tokens
begin. The second reads the bytes of a pre-token; each of its transitions is annotated with the number of tokens by which the
count of what was read so far changes (below zero where bytes merge), so the sum over a path is the count.

The first one runs in parallel: a batch is cut into chunks of equal size, all chunks compute at once the map from the state
they are entered in to the state they are left in, and the maps compose through a prefix scan. With every chunk's entry known
all chunks mark boundaries at once. The second starts anew at each boundary, so every pre-token is a lane of its own.

A state of the second machine is what the future can depend on: the longest end of the read bytes that begins some token, and
for each place in it which tokens may follow the encoding up to there, and its count. A token may follow another exactly if the
two stay apart when encoded together, and one token alone may end the encoding of each prefix. States are made when first met.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import prepare, text_or_empty
from strandline.llm.tokens import ALPHABET

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
BLOCK_CHARS = 1 << 20  # characters taken at once
CHUNK = 256
STATES_KEPT = 1 << 17  # compiled states of the second machine beyond which it is begun anew before the next block
FEW_FOLLOWERS = 64  # so few tokens that go on from a place: only which of them may follow is kept of the token before it
MEMO = 1 << 18  # remembered answers about pairs of tokens, of either kind
FEW_LANES = 16  # so few pre-tokens left: each is walked to its end alone
ROWS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

# The split pattern of the byte-level pre-tokenizer, which the first machine stands for.
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
OTHER_LETTER, SINGLE, R, V, E, L, NUMBER, OTHER, QUOTE, SPACE, WHITE, END = range(12)
NOTHING, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(13)
HERE, BEFORE_LAST = 1, 2  # a pre-token begins at this character; one begins at the character before it
N_STATES = 13


def _begin(kind: int) -> int:
    """The state after the first character of a pre-token."""
    if kind <= L:
        return LETTERS
    return {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, SPACE: ONE_SPACE, WHITE: ONE_WHITE, END: NOTHING}[kind]


def _split_step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks of the first machine."""
    fresh = (_begin(kind), HERE)
    run = {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: OTHERS}.get(kind, LETTERS)  # what goes on without an apostrophe's suffix
    if state in (NOTHING, CLOSED):
        return fresh
    if state in (LETTERS, NUMBERS, OTHERS):
        return (state, 0) if kind < SPACE and run == state and not (kind == QUOTE and state != OTHERS) else fresh
    if state == QUOTED:
        if kind in (OTHER, QUOTE):
            return OTHERS, 0
        return {SINGLE: (CLOSED, 0), R: (QUOTED_R, 0), V: (QUOTED_V, 0), L: (QUOTED_L, 0)}.get(kind, fresh)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if kind == (L if state == QUOTED_L else E):
            return CLOSED, 0
        after, marks = _split_step(LETTERS, kind)
        return after, marks | BEFORE_LAST
    if kind in (SPACE, WHITE):
        return (SPACES if kind == SPACE else WHITES), 0
    if kind == END:
        return fresh
    return {ONE_SPACE: (run, 0), ONE_WHITE: fresh, SPACES: (run, BEFORE_LAST), WHITES: (fresh[0], HERE | BEFORE_LAST)}[state]


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by state * 16 + class."""
    after, marks = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for state in range(N_STATES):
        for kind in range(12):
            after[state << 4 | kind], marks[state << 4 | kind] = _split_step(state, kind)
    return after, marks


AFTER, MARKS = _split_tables()


def entry_states(kinds: np.ndarray) -> np.ndarray:
    """The state in which each chunk is entered; kinds holds one chunk a column.

    A chunk's map goes from each state at its start to that at its end. Most maps soon send all states to one, and go on as a
    single column. The maps compose from the left through a scan of doubling strides.
    """
    size, count = kinds.shape
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], count, 1)
    lead = min(8, size)
    for row in kinds[:lead]:
        maps = AFTER[maps << 4 | row]
    wide = np.flatnonzero((maps != maps[0]).any(0))
    single, rest = maps[0], maps[:, wide]
    for row in kinds[lead:]:
        single = AFTER[single << 4 | row]
        if len(wide):
            rest = AFTER[rest << 4 | row[wide]]
    maps = np.repeat(single[None, :], N_STATES, 0)
    maps[:, wide] = rest
    stride = 1
    while stride < count:
        maps[:, stride:] = np.take_along_axis(maps[:, stride:], maps[:, :-stride].astype(np.intp), 0)
        stride *= 2
    return np.concatenate([[NOTHING], maps[NOTHING, :-1]]).astype(np.uint8)


def first_characters(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places where pre-tokens begin, ascending; every END is one too."""
    padded = np.full(-(-len(kinds) // chunk) * chunk, END, np.uint8)
    padded[:len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(-1, chunk).T)
    state, marks = entry_states(columns), np.empty_like(columns)
    for row, out in zip(columns, marks):
        at = state << 4 | row
        out[:], state = MARKS[at], AFTER[at]
    marks = marks.T.ravel()[:len(kinds)]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE_LAST).astype(bool)
    return np.flatnonzero(begins)


class CountingMachine:
    """Both machines of one vocabulary file: compiled once a worker process, the states of the second on demand."""

    def __init__(self, path: str, states_kept: int = STATES_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.states_kept = Tokenizer.from_file(path), states_kept
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        if plan["pre_tokenizer"]["type"] != "ByteLevel" or plan["normalizer"] or plan["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        added = [t["content"] for t in plan["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.kinds = self._kinds()
        bytes_of = {c: b for b, c in ALPHABET.items()}
        self.ids = {bytes(map(bytes_of.get, t)): i for t, i in plan["model"]["vocab"].items() if t not in added}
        self.names = {i: t for t, i in plan["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.sorted = sorted(self.ids)
        self.prefixes = {t[:n] for t in self.ids for n in range(len(t))}
        self.apart: dict[int, bool] = {}
        self.follow: dict[tuple[int, bytes], int | tuple[int, ...]] = {}
        self._restart()

    def _kinds(self) -> np.ndarray:
        """The class of every code point, asked of the library: does it join a letter, a number or a mark before it?"""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        kinds = np.full(0x110000, WHITE, np.uint8)
        for block in range(0, 0x110000, 256):
            if 0xD800 <= block < 0xE000:
                continue
            chars = "".join(map(chr, range(block, block + 256)))
            for lead, kind in (("!", OTHER), ("a", OTHER_LETTER), ("1", NUMBER)):
                if len(split(lead + chars)) == 1:
                    kinds[block:block + 256] = kind
                    break
                for i, char in enumerate(chars):
                    if len(split(lead + char)) == 1:
                        kinds[block + i] = kind
        for char, kind in ((" ", SPACE), ("'", QUOTE), ("r", R), ("v", V), ("e", E), ("l", L), *((c, SINGLE) for c in "stmd")):
            kinds[ord(char)] = kind
        return kinds

    def _restart(self) -> None:
        """Forget all states of the second machine but the first."""
        self.table = np.full((1024, 256), -1, np.int32)  # next state << 8 | change of the count + 128; -1: not made yet
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self._number((b"", ((-1, 0),)))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.numbers[state]

    def _may_follow(self, last: int, token: int) -> bool:
        """Do two tokens stay apart when encoded together? Nothing (-1) is before the first."""
        if last < 0:
            return True
        pair = last << 32 | token
        if pair not in self.apart:
            if len(self.apart) >= MEMO:
                self.apart.clear()
            both = [t.id for t in self.tokenizer.model.tokenize(self.names[last] + self.names[token])]
            self.apart[pair] = both == [last, token]
        return self.apart[pair]

    def _followers(self, last: int, tail: bytes) -> int | tuple[int, ...]:
        """What of a place's last token still matters: itself, or where few tokens go on from tail, those that may follow it."""
        if not tail:
            return last
        if (last, tail) not in self.follow:
            if len(self.follow) >= MEMO:
                self.follow.clear()
            longer = self.sorted[bisect_right(self.sorted, tail):bisect_left(self.sorted, tail + b"\xff" * 4)]
            many = len(longer) > FEW_FOLLOWERS
            self.follow[last, tail] = last if many else tuple(t for t in map(self.ids.get, longer) if self._may_follow(last, t))
        return self.follow[last, tail]

    def _place(self, followers: int | tuple[int, ...], tail: bytes) -> int | tuple[int, ...]:
        if isinstance(followers, int):
            return self._followers(followers, tail)
        return tuple(t for t in followers if len(self.bytes[t]) > len(tail) and self.bytes[t].startswith(tail))

    def _make(self, number: int, byte: int) -> int:
        """Compile one transition."""
        tail, places = self.states[number]
        tail += bytes([byte])
        for at, (followers, count) in enumerate(places):
            token = self.ids.get(tail[at:])
            if token is not None and (token in followers if isinstance(followers, tuple) else self._may_follow(followers, token)):
                break
        change = count + 1
        after = []
        for at, (followers, count) in enumerate((*places, (token, change))):
            rest = tail[at:]
            followers = self._place(followers, rest) if followers != () and rest in self.prefixes else ()
            after.append((followers, count - change if followers != () else 0))
        keep = next(at for at, (followers, _) in enumerate(after) if followers != ())
        self.table[number, byte] = self._number((tail[keep:], tuple(after[keep:]))) << 8 | change + 128
        return int(self.table[number, byte])

    def _walk(self, raw: bytes) -> int:
        """Tokens of one pre-token."""
        state = count = 0
        for byte in raw:
            step = self.table.item(state, byte)
            if step < 0:
                step = self._make(state, byte)
            state, count = step >> 8, count + (step & 255) - 128
        return count

    def lane_counts(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens raw[first:first + size], all lanes at once."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        state, count = np.zeros(len(first), np.int32), np.zeros(len(first), np.int64)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), "right")  # lanes longer than each step
        done = 0
        for step, lanes in enumerate(alive):
            if lanes < FEW_LANES:
                break
            read = raw[first[:lanes] + step]
            found = self.table[state[:lanes], read]
            new = found < 0
            if new.any():
                for number, byte in np.unique(np.stack([state[:lanes][new], read[new]]), axis=1).T.tolist():
                    self._make(number, byte)
                found = self.table[state[:lanes], read]
            state[:lanes] = found >> 8
            count[:lanes] += (found & 255) - 128
            done = step + 1
        for lane in np.flatnonzero(size[:FEW_LANES] > done):
            count[lane] = self._walk(raw[first[lane]:first[lane] + size[lane]].tobytes())
        out = np.empty_like(count)
        out[order] = count
        return out

    def piece_counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece, none of which holds a special token."""
        if len(self.states) > self.states_kept:
            self._restart()
        joined = "\0".join(pieces) + "\0"
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        kinds = self.kinds[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        kinds[ends] = END
        begins = first_characters(kinds)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        offset = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        size = np.diff(np.append(offset[begins], len(raw)))
        real = kinds[begins] != END
        counts = self.lane_counts(raw, offset[begins[real]], size[real])
        return np.bincount(np.searchsorted(ends, begins[real]), counts, len(pieces)).astype(np.int64)

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of at most about a block between special tokens; a pre-token always ends before white space that follows text."""
        for part in self.special.split(text) if self.special else [text]:
            start = 0
            while len(part) - start > BLOCK_CHARS:
                cut = _SAFE.search(part, start + BLOCK_CHARS - 1)
                if cut is None:
                    break
                yield part[start:cut.start() + 1]
                start = cut.start() + 1
            yield part[start:]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every whole text; a special token's string inside a text is one token, as is the library's default."""
        total = np.array([len(self.special.findall(t)) if self.special else 0 for t in texts], np.int64)
        held, rows, size = [], [], 0

        def settle() -> None:
            np.add.at(total, rows, self.piece_counts(held))
            held.clear()
            rows.clear()

        for row, text in enumerate(texts):
            for piece in self._pieces(text):
                if held and size + len(piece) > BLOCK_CHARS:
                    settle()
                    size = 0
                held.append(piece)
                rows.append(row)
                size += len(piece)
        if held:
            settle()
        return total


_SAFE = re.compile(r"[A-Za-z0-9.,](?= )")
_MACHINES: dict[str, CountingMachine] = {}


def machine(path: str = DEFAULT_TOKENIZER) -> CountingMachine:
    """One compiled pair of machines a worker process and vocabulary."""
    if path not in _MACHINES:
        _MACHINES[path] = CountingMachine(path)
    return _MACHINES[path]


def count_tokens(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens, for every row of docs.

    A null text is empty and has no tokens; so has an empty one. Null and repeated doc_ids are rows like others, texts that
    repeat are counted each time. Other columns are ignored; an empty table gives no rows. Nothing is shuffled. A text is
    worked through in blocks cut where a pre-token must end, so long texts need no more memory than their own bytes.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"),
                       F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = machine(tokenizer).counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return rows.mapInArrow(count, ROWS)
