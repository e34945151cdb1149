"""Token files, packing and the cached encoder against the tokenizer itself."""

import gc
import random
import weakref
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import packing, token_files
from strandline.llm.tokens import DEFAULT_TOKENIZER, ChunkEncoder, Generations, encoder, release
from tests.llm.conftest import odd_rows

TOKENIZER = Tokenizer.from_file(DEFAULT_TOKENIZER)
STRANGE = [
    "It's <|endoftext|> <|ENDOFTEXT|> we'll", "É́ é H̱ İİ ẞß", "a.b. c,, d., 12.5 ٣٤", "中文。字", "x y z\x85q\x1cw", "ﬁ Ǆ ǅ ªº",
    "''s 's'S I'M", "﻿a​b퟿", "Σίσυφος ΣΑΣ. ΑΣ", "🙂👍🏽 .", ". , .. ,.", "",
]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_cached_ids_are_the_tokenizers():
    for text in STRANGE + [" ".join(STRANGE)]:
        assert encoder().encode(text).tolist() == ids(text), text


def test_released_encoders_are_gone_at_once():
    held = weakref.ref(encoder())
    gc.disable()
    try:
        release()
        assert held() is None
    finally:
        gc.enable()


def test_random_strings():
    rng = random.Random(3)
    parts = ["İ", "ı", "ß", "ẞ", "ǅ", "ſ", "K", "Å", "é", "e\u0301", "\u0307", "\u0301", "中", "ª", "ª", "Ω", "ж", "a", "T", "s", "'", "'s", ".",
             ",", "..", "-", "1", "٣", " ", "  ", "\n", "\u00a0", "\u0085", "<|", "|>", "ﬁ", "🙂", "\u200d", "ᾼ", "ΑΣ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(100_000)]
    own, found = encoder(), TOKENIZER.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, found) if own.encode(t).tolist() != e.ids] == []
    assert own.encode("TATİ. x").tolist() == ids("TATİ. x")


def test_signs_after_a_word_are_a_piece_of_their_own():
    rng = random.Random(4)
    parts = ["İ", "é", "E\u0301", "ß", "ж", "中", "ª", "a", "T", "1", "'", "'s", "\u0307", "?", "***", "!!", "$", "&", "<", "|", "\\", "`", "~", "_", ".", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(50_000)]
    own, found = encoder(), TOKENIZER.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, found) if own.encode(t).tolist() != e.ids] == []


def test_words_with_signs_do_not_take_the_whole_tokenizer():
    own, asked = ChunkEncoder(DEFAULT_TOKENIZER), []

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return TOKENIZER.encode(text, **options)

    own.tokenizer = Counted()
    text = "Word*** word!! éué### don't, (x)"
    assert own.encode(text).tolist() == ids(text)
    assert sorted(asked) == ["!!", "###", "(x", ")", "***", ",", "don't"]


def test_cache_keeps_what_is_asked_for():
    made = []
    cache = Generations(lambda k: made.append(k) or k, limit=2)
    for key in (b"a", b"b", b"c", b"a", b"d", b"e", b"a"):
        cache[key]
    assert made.count(b"a") == 1


def test_token_files_round_trip(odd):
    got = [tuple(r) for r in token_files.token_id_files(odd).collect()]
    rows = [(d, ids(t) + [1]) for d, t in odd_rows()]
    assert sorted((d is not None, d, n, c) for d, _, n, c in got) == sorted(
        (d is not None, d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in rows
    )
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)


def test_empty_tables(documents):
    assert token_files.token_id_files(documents([])).count() == 0
    assert packing.pack_documents(documents([])).count() == 0


def check_packing(rows, pieces, tiers):
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(ids(t) + [2])
    sequences, of_doc = defaultdict(list), defaultdict(int)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        of_doc[p.doc_id] += p.length
        assert any(
            len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            for x in texts[p.doc_id]
        )
    assert of_doc == {d: sum(map(len, x)) for d, x in texts.items()}
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        size = sum(p.length for p in own)
        assert size == own[0].sequence_tokens and size & (size - 1) == 0 and size <= max(tiers)
    return sequences


def test_packing_fills_every_sequence(odd):
    check_packing(odd_rows(), packing.pack_documents(odd).collect(), packing.TIERS)


def test_packing_with_small_buffers_uses_all_tiers(documents):
    rows = [(i, "w " * (i * 37 % 400)) for i in range(120)]
    pieces = packing.pack_documents(documents(rows), tiers=(16, 64, 256), buffer_tokens=1024, step_tokens=512).collect()
    sequences = check_packing(rows, pieces, (16, 64, 256))
    assert {16, 64, 256} <= {own[0].sequence_tokens for own in sequences.values()}
    steps = defaultdict(int)
    for own in sequences.values():
        steps[own[0].step_group] += own[0].sequence_tokens
    assert max(steps.values()) <= 512 and sum(s == 512 for s in steps.values()) > len(steps) / 2
