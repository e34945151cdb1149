"""Exact, cached encoding with a public word-level BPE tokenizer.

White space is dropped by the tokenizer and no piece crosses it, so a text's ids are the ids of its chunks between ASCII
white space, in order. Chunks repeat, so a bounded cache of their ids replaces most of the encoding.
"""

from __future__ import annotations

import gc
import os
import unicodedata
from array import array

import numpy as np
import public_tokenizers

from strandline.llm.shared import give_back

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHE_CHUNKS = 300_000  # of each of two generations; some 190 bytes each
_MARK = b"<|"  # may begin a special token, whose case counts

_LATIN_END = "\u0250"  # letters below it are letters in every version of Unicode
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII signs but the apostrophe, which may begin a piece with letters

# The byte-level alphabet by its rule: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_OTHER = [b for b in range(256) if b not in _PRINTABLE]
ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}

_ENCODERS: dict[str, "ChunkEncoder"] = {}


def _lowered(text: str) -> str:
    """As the tokenizer's normalizer does it: composed, then each character lower-cased by itself; only a sigma looks around."""
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()


class Generations(dict):
    """A cache whose entries outlive the next turnover only if they were asked for since the last one."""

    def __init__(self, make, limit: int = CACHE_CHUNKS):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            give_back()
        self[key] = value
        return value


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned integers, 16 bits wide where the vocabulary fits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"  # array's name of the type; both are little-endian here
        self.model = self.tokenizer.model
        self.chunks = Generations(self._chunk)
        give_back()  # reading the vocabulary takes more than keeping it

    def _piece(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        """Latin letters are one piece, which the model takes in the byte-level alphabet; all else takes the whole tokenizer."""
        if word.isalpha() and word.islower():
            return self._piece(word.decode("ascii"))
        text = word.decode("utf-8")
        plain = _lowered(text)
        if plain.isalpha() and max(plain) < _LATIN_END:
            return self._piece(plain.encode().decode("latin-1").translate(ALPHABET))
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        """ASCII chunks are lower-cased, as the tokenizer would; the signs after a Latin letter are a piece of their own.

        The letter is that of the lower-cased text: some capitals leave a mark behind, which signs join.
        """
        if _MARK in chunk:
            return self._word(chunk)
        if plain := chunk.isascii():
            chunk = chunk.lower()
        head = chunk.rstrip(_SIGNS)
        if head and len(head) < len(chunk):
            last = head[-1:].decode("ascii") if plain else _lowered(head.decode("utf-8"))[-1:]
            if last.isalpha() and last < _LATIN_END:
                return self.chunks[head] + self.chunks[chunk[len(head):]]
        return self._word(chunk)

    def encode(self, text: str) -> np.ndarray:
        chunks = self.chunks
        return np.frombuffer(b"".join([chunks[c] for c in text.encode("utf-8", "replace").split()]), self.dtype)


def release() -> None:
    """Give up encoders and caches, and their memory, in a worker process that goes on to other work."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()  # an encoder and its cache refer to each other
        give_back()


def encoder(path: str = DEFAULT_TOKENIZER) -> ChunkEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
