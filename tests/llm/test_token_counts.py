"""Token counts against the library itself."""

import random

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import transducers
from strandline.llm.transducers import AFTER, DEFAULT_TOKENIZER, N_STATES, CountingMachine, count_tokens, machine
from tests.llm.conftest import odd_rows

TOKENIZER = Tokenizer.from_file(DEFAULT_TOKENIZER)
PARTS = [
    "'", "'s", "'re", "'r", "'ll", "'l", "'ve", "'v", " ", "  ", "\n", "\t", "a", "the", "é", "İ", "中", "1", "23", "!", "..",
    "<|endoftext|>", "<|endof", "🙂", " ", "　", "r", "s", "ll", "\x85", "​", "٣", "ª", "\x1c", "ing", "aaaa", "Q", "\0",
]


def counts(texts):
    return [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def strange_texts(n, longest=25, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_strings_of_difficult_parts():
    texts = strange_texts(20_000)
    assert machine().counts(texts).tolist() == counts(texts)


def test_random_letters():
    rng = random.Random(2)
    kinds = [lambda: rng.randrange(97, 123)] * 3 + [lambda: rng.randrange(32, 0x3000), lambda: 0x4E00 + rng.randrange(20_000)]
    texts = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(40))) for _ in range(5_000)]
    assert machine().counts(texts).tolist() == counts(texts)


def test_small_blocks_and_forgotten_states(monkeypatch):
    monkeypatch.setattr(transducers, "BLOCK_CHARS", 50)
    texts = strange_texts(300, 200, 3) + ["word " * 400, "x" * 3000, " " * 500 + "a", "ab" * 700 + "."]
    assert CountingMachine(DEFAULT_TOKENIZER, states_kept=100).counts(texts).tolist() == counts(texts)


def test_chunk_maps_compose_to_the_states_of_one_walk():
    kinds = np.random.default_rng(4).integers(0, 12, (40, 33)).astype(np.uint8)
    kinds[:, 5] = transducers.OTHER  # maps that stay wide
    state, expected = transducers.NOTHING, []
    for column in kinds.T:
        expected.append(state)
        for kind in column:
            state = int(AFTER[state << 4 | kind])
    assert transducers.entry_states(kinds).tolist() == expected and max(expected) < N_STATES


def test_rows(odd, documents):
    texts = [t or "" for _, t in odd_rows()]
    expected = sorted(((d is not None, d, len(t.encode()), n, n > 512) for (d, _), t, n in zip(odd_rows(), texts, counts(texts))), key=str)
    got = count_tokens(odd)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(((r[0] is not None, *r) for r in got.collect()), key=str) == expected
    assert count_tokens(documents([])).count() == 0
