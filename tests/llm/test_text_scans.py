"""Toxicity, licences and decontamination."""

import hashlib
import random
import re

import numpy as np

from strandline.llm import decontaminate, licenses, toxicity
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_leaks(rows, items, window):
    wins = {}
    for item, text in items:
        w = fold(text)
        span = min(len(w), window)
        for i in range(len(w) - span + 1 if span else 0):
            wins.setdefault(tuple(w[i:i + span]), set()).add("" if item is None else str(item))
    out = []
    for d, text in rows:
        w, hit, found = fold(text), set(), set()
        for i in range(len(w)):
            for span in range(1, window + 1):
                key = tuple(w[i:i + span])
                if len(key) == span and key in wins:
                    hit.update(range(i, i + span))
                    found |= wins[key]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, span int")


def leaks(docs, items, window=10):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in decontaminate.decontaminate(docs, items, window).select(*cols).collect()), key=str)


def test_leaks_in_odd_rows(spark, odd):
    items = [(1, " ".join(f"W{i}" for i in range(30, 45))), (2, None), (3, ""), (4, "three FOUR"), (4, "a a a a a a a a a a a"), (None, "Two"),
             (5, "É" * 3), (6, "é" * 500), (10, "w1 w2")]
    assert leaks(odd, bench(spark, items)) == brute_leaks(odd_rows(), items, 10)


def test_leaks_random(spark, documents):
    rng = random.Random(2)
    rows = [(i % 50, " ".join(rng.choice("abC") for _ in range(rng.randrange(40)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("aBc") for _ in range(rng.randrange(12)))) for i in range(12)]
    assert leaks(documents(rows), bench(spark, items), 6) == brute_leaks(rows, items, 6)


def test_upper_case_beyond_ascii_differs(spark, documents):
    rows = [(1, "É b c"), (2, "é b c"), (3, "É B C")]
    assert [r[2] for r in leaks(documents(rows), bench(spark, [(1, "É b c")]))] == [3, 0, 3]


def test_no_documents_or_items(spark, documents):
    assert leaks(documents([]), bench(spark, [(1, "a b")])) == []
    assert [r[5] for r in leaks(documents([(1, "a b")]), bench(spark, []))] == [False]
    out = decontaminate.without_contaminated(documents([(1, "a b"), (2, "c"), (None, "a b"), (None, None)]), bench(spark, [(1, "a b")]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(2, "c"), (None, None)]


def brute_licenses(rows, threshold=licenses.THRESHOLD):
    out = []
    for d, text in rows:
        w = fold(text)
        places, labels, score = [], set(), 0.0
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
        base = {label for _, label in places}
        for i in range(0, max(len(w) - 16, 1), 16):
            own = set(w[i:i + 32])
            for template, label in licenses.TEMPLATES:
                t = set(template.split())
                if len(own & t) / len(t) >= threshold:
                    labels.add(label)
                    score = max(score, len(own & t) / len(t))
        starts = [i for i, _ in places]
        out.append((d, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | labels)), round(score, 9)))
    return sorted(out, key=str)


def test_licenses(documents):
    rng = random.Random(1)
    rows = odd_rows() + [
        (20, "Released under the MIT\nLicense. mit license MIT-LICENSE"), (21, "x\nLicensed under the Apache License, Version 2.0.\ny"),
        (22, "This work is licensed under the GNU General Public License, version 3."), (23, "Licensed under CC BY-NC 4.0."),
        (24, "émit license mit licensé"), (24, None), (25, "The version, under Apache LICENSE: licensed 2! " * 400),
    ]
    for i in range(30, 90):
        words = [w for t, _ in rng.choices(licenses.TEMPLATES, k=2) for w in t.split() if rng.random() < 0.9]
        rows.append((i, " ".join(words) + rng.choice(["", "\n", " and more"]) + "z"))
    got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in licenses.scan_licenses(documents(rows)).collect()), key=str)
    assert got == brute_licenses(rows)
    assert licenses.scan_licenses(documents([])).count() == 0


def test_wrapped_notices(documents):
    """Notices broken over lines anywhere and at any place of a text reach their templates, single words of them do not."""
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd")
    gpl = ("redistribute it and/or modify\nit under the terms of the GNU General Public License", "gpl")
    mit = ("Permission is hereby granted, free of charge,\nto any person obtaining a copy\n\nof this software", "mit")
    rows, labels = [], {}
    for before in range(0, 70, 3):
        for text, label in (bsd, gpl, mit):
            labels[len(rows)] = label
            rows.append((len(rows), "x " * before + text + " y" * (before % 7)))
    at = len(rows)
    rows += [(at, " z ".join("redistribution use source binary forms modification permitted".split())), (at + 1, "mit\nlicense")]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    assert all(got[d].labels == label and got[d].score >= licenses.THRESHOLD for d, label in labels.items())
    assert (got[at].labels, got[at].score) == ("", 0.0) and (got[at + 1].labels, got[at + 1].score) == ("mit", 0.0)


def toxic_rows(n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[:0] = rng.choices(["scum", "moron", "trash"], k=rng.choice([1, 2, 3, 6]))
            rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, documents):
    rows, labels = toxic_rows()
    known = spark.createDataFrame([(i, 1, t) for i, t in labels if i < 300] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), known).collect()}
    held = [(got[i].toxic, bool(t)) for i, t in labels if i >= 300]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in got.values())
    model = toxicity.fit_toxicity(documents(rows), known)
    assert list(model.thresholds) == sorted(model.thresholds) and model.above("scum moron trash")[0] > 0.5 > model.above("")[0]
    assert model.above("scum moron trash").sum() > model.above("scum").sum()


def test_toxicity_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {(r.severity, r.grade, r.toxic) for r in toxicity.toxicity(odd, none).collect()} == {(0.0, 0, False)}
    assert toxicity.toxicity(odd.limit(0), none).count() == 0
    kept = toxicity.without_toxic(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        held = np.flatnonzero(rng.random(6) < 0.4)
        rows.append(held)
        grades.append(int(np.clip((held < 3).sum(), 0, 2)))
    weights, thresholds = toxicity.fit_ordinal(rows, np.array(grades), 6)
    assert weights[:3].min() > 5 * max(weights[3:].max(), 0.1) and thresholds[0] < thresholds[1]


def test_toxic_share_does_not_depend_on_the_sample_bound(spark, documents):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(2400):
        bad = i % 12 == 0
        words = [f"w{rng.randrange(60)}" for _ in range(20)] + [f"only{i}"]
        if rng.random() < (0.6 if bad else 0.12):
            words.append("meh")  # weak: half of the texts with it are toxic only where toxic texts are as many as clean ones
        if bad and rng.random() < 0.8:
            words.append("scum")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(10000, "meh"), (10001, "scum meh")] + [(i, rows[1][1]) for i in range(20000, 20400)]  # copies of one clean text
    labels += [(i, 1, 0) for i in range(20000, 20400)]
    docs, known = documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    whole, bound = (toxicity.fit_toxicity(docs, known, each) for each in (4000, 150))
    a, b = ({r.doc_id: r for r in toxicity.score_toxicity(docs, m).collect()} for m in (whole, bound))
    assert a[10000].grade == b[10000].grade == 0 and a[10001].grade > 0 and b[10001].grade > 0
    assert abs(whole.thresholds[0] - bound.thresholds[0]) < 0.7
    assert np.mean([(a[i].grade > 0) == (b[i].grade > 0) for i in a]) > 0.99
