"""Substring and suffix-array de-duplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from strandline.llm import anchors, doubling, suffixes
from tests.llm.conftest import odd_rows, random_texts


def brute_words(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length, keep_first=False):
    texts = sorted(((d, (t or "").encode()) for d, t in rows), key=str)
    seen = {}
    for n, (_, t) in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i:i + length], []).append((n, i))
    out = []
    for n, (d, t) in enumerate(texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if len(seen[t[i:i + length]]) > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_substring_odd_rows(odd):
    assert rows_of(doubling.substring_digests(odd)) == brute_words(odd_rows(), 50)


@pytest.mark.parametrize("window", [5, 8])
def test_substring_random(documents, window):
    rows = random_texts(window, 60, "ab", 40) + random_texts(window + 50, 20, "abcde", 60)
    rows = [(i // 2, t) for i, (_, t) in enumerate(rows)]  # ids occur twice
    assert rows_of(doubling.substring_digests(documents(rows), window)) == brute_words(rows, window)


def test_ladder_and_extensions():
    assert doubling.ladder(50) == [7, 13, 25, 50] and doubling.ladder(5) == [3, 5] and doubling.ladder(16, 2) == [2, 4, 8, 16]
    for lengths in (doubling.ladder(50), doubling.ladder(23, 2), doubling.ladder(5)):
        way_of, ways = doubling.extensions(lengths)
        for place, way in enumerate(way_of):
            spans = [(place + s, place + s + n) for s, n in zip(ways[way], lengths)]
            assert all(0 <= a and b <= lengths[-1] for a, b in spans)
            assert all(c <= a and b <= d for (a, b), (c, d) in zip(spans, spans[1:]))


def test_only_repeated_windows_are_extended(documents):
    """Texts that share 4, 8, 15 and 16 words in a row: each level loses what repeats at shorter lengths only."""
    def text(d, shared):
        return " ".join([f"a{d}_{i}" for i in range(20)] + [f"s{shared}_{i}" for i in range(shared)] + [f"b{d}_{i}" for i in range(20)])
    rows = [(10 * n + d, text(10 * n + d, n)) for n in (4, 8, 15, 16) for d in range(2)]
    runs = doubling.word_runs(doubling.keyed(documents(rows)), 16, 2)
    left = []
    for level in ("level_0", "level_1", "level_2"):
        runs = doubling.survivors(runs, level)
        left.append({r.key for r in runs.collect()})
    assert left[0] >= left[1] >= left[2] >= {160, 161} and not left[1] & {40, 41} and {40, 41} <= {k for k, _ in rows}
    assert rows_of(doubling.substring_digests(documents(rows), 16)) == brute_words(rows, 16)


@pytest.mark.parametrize("shortest", [2, 4])
def test_substring_levels_lose_nothing(documents, shortest):
    rng = random.Random(shortest)
    pieces = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(6)))) for i in range(60)]
    found = doubling.with_spans(documents(rows), doubling.repeated_spans(documents(rows), 16, shortest))
    got = {r.doc_id: int(anchors.marked(len(r.text.split()), [(s["first"], s["end"]) for s in r.spans]).sum())
           for r in found.select("row.doc_id", "text", "spans").collect()}
    assert got == {r[0]: r[2] for r in brute_words(rows, 16)} and any(got.values())


def test_suffix_odd_rows(odd):
    assert rows_of(suffixes.suffix_digests(odd)) == brute_bytes(odd_rows(), 400)


@pytest.mark.parametrize("group_bytes", [1 << 24, 0])
def test_suffix_random(documents, group_bytes, monkeypatch):
    rows = random_texts(3, 40, "ab", 60, "") + random_texts(4, 20, ["abcabcabd", "é", "x"], 12, "")
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda *a: found(*a, group_bytes=group_bytes))
    assert rows_of(suffixes.suffix_digests(documents(rows), 10, 4)) == brute_bytes(rows, 10)


@pytest.mark.parametrize("group_bytes", [1 << 24, 0])
def test_first_copy_stays(documents, group_bytes):
    """Kept text holds every string of the length that the input held, at its first place only."""
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh") for _ in range(40))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(30)) + part[rng.randrange(10):] + str(i) * 3) for i in range(30)]
    spans = {r.key: r.spans for r in suffixes.repeated_spans(documents(rows), 12, 5, True, group_bytes).collect()}
    seen = set()
    for d, t in rows:
        gone = set()
        for i in range(len(t) - 11):
            if t[i:i + 12] in seen:
                gone.update(range(i, i + 12))
            seen.add(t[i:i + 12])
        assert {x for s in spans.get(d, []) for x in range(s.first, s.end)} == gone


def cut_later_words(rows, length):
    """Texts in order of doc_id without the words of windows that start earlier; they take the white space behind them along."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        words, gone = [raw[a:b] for a, b in places], set()
        for i in range(len(words) - length + 1):
            if tuple(words[i:i + length]) in seen:
                gone.update(range(i, i + length))
            seen.add(tuple(words[i:i + length]))
        cut = set()
        for i in gone:
            cut.update(range(places[i][0], places[i + 1][0] if i + 1 < len(places) else places[i][1]))
        out.append((d, None if text is None else bytes(b for i, b in enumerate(raw) if i not in cut).decode()))
    return sorted(out)


@pytest.mark.parametrize("glue", [" ", "\n  "])
def test_later_copies_of_word_strings(documents, glue):
    rng = random.Random(6)
    part = [rng.choice("abcdé") for _ in range(40)]
    rows = [(i, glue.join([rng.choice("abcdé") for _ in range(20)] + part[rng.randrange(9):] + ["z"] * (i % 20)) + " \n" * (i % 2)) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "a b"), (103, glue.join(part)), (104, glue.join(part * 3))]
    got = suffixes.without_repeats(documents(rows), 12, 4, unit="words")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == cut_later_words(rows, 12)
    assert suffixes.without_repeats(documents([]), 12, 4, unit="words").count() == 0


def test_word_windows_of_one_anchor_counted_by_a_shuffle(documents):
    rows = [(i, " ".join(["a"] * (15 + i) + [str(i)])) for i in range(12)]
    spans = {r.key: r.spans for r in suffixes.repeated_spans(documents(rows), 8, 3, True, 0, "words").collect()}
    seen = set()
    for d, text in rows:
        words, gone = text.split(), set()
        for i in range(len(words) - 7):
            if tuple(words[i:i + 8]) in seen:
                gone.update(range(i, i + 8))
            seen.add(tuple(words[i:i + 8]))
        assert {x for s in spans.get(d, []) for x in range(s.first, s.end)} == gone


def test_cut_texts_keep_columns_and_characters(odd):
    out = suffixes.without_repeats(odd)
    assert out.columns == odd.columns
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in texts and (2, "") in texts and all(t is None or "�" not in t for _, t in texts)


def test_previous_factors_against_brute_force():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4):
        text = rng.integers(97, 97 + letters, 120).astype(np.uint8)
        length, starts = 20, np.arange(100)
        place, shared = suffixes.suffix_order(text, starts, length)
        words = [bytes(text[i:i + length]) for i in place]
        assert words == sorted(words)
        got = dict(zip(place.tolist(), suffixes.longest_previous_factors(place, shared).tolist()))
        for i in range(100):
            best = 0
            for j in range(i):
                k = 0
                while k < length and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


def test_word_suffixes_sort_like_tuples():
    text = np.random.default_rng(3).integers(0, 3, 90).astype("<u8") << np.uint64(61)
    starts = np.arange(70)
    place, shared = suffixes.suffix_order(text, starts, 20)
    words = [tuple(text[i:i + 20].tolist()) for i in place]
    assert words == sorted(words)
    assert shared[1:].tolist() == [next((k for k in range(20) if a[k] != b[k]), 20) for a, b in zip(words, words[1:])]


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    tails = [np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), common]) for n in (7, 31)]
    found = []
    for tokens in tails:
        anchor, first, last, _ = anchors.runs(tokens, 20, 8)
        assert first[0] == 0 and last[-1] == len(tokens) - 20 and (first[1:] == last[:-1] + 1).all()
        base = len(tokens) - 60
        found.append([int(a) for a, f, e in zip(anchor, first, last) for _ in range(max(f, base), e + 1)])
    assert found[0] == found[1]


def test_long_texts_in_chunks(documents, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 16)
    monkeypatch.setattr(doubling, "CHUNK", 16)
    rows = random_texts(8, 6, "ab", 120)
    for found in (anchors.runs(np.arange(100, dtype=np.uint64), 9, 4),):
        assert found[1][0] == 0 and found[2][-1] == 91 and (found[1][1:] == found[2][:-1] + 1).all()
    assert rows_of(doubling.substring_digests(documents(rows), 6)) == brute_words(rows, 6)


def test_empty_tables(documents):
    assert doubling.substring_digests(documents([])).count() == 0
    assert suffixes.suffix_digests(documents([])).count() == 0
