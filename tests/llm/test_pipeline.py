"""The whole pipeline against stages worked out by hand."""

import random

import corpus_pipeline
from strandline.llm import packing
from tests.llm.test_joins import brute_jaccard
from tests.llm.test_repeats import cut_later_words
from tests.llm.test_text_scans import brute_leaks
from tests.llm.test_tokens import check_packing


def corpus():
    """Documents by kind: toxic ones, near copies, ones that share a long passage, contaminated ones, clean ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(14))) for i in range(3)]
    docs, toxic, at = [], set(), 0
    for _ in range(120):
        docs.append((at, text(rng.randrange(30, 90))))
        at += 1
    for _ in range(40):
        words = text(60)
        for slur in ("scum", "moron", "trash"):
            words.insert(rng.randrange(60), slur)
        toxic.add(at)
        docs.append((at, words))
        at += 1
    for base in range(5):
        for _ in range(3):
            words = list(docs[base][1]) + text(60) if not _ else list(docs[-1][1])
            words[rng.randrange(len(words))] = word()
            docs.append((at, words))
            at += 1
    passage = text(90)
    for _ in range(4):
        docs.append((at, text(200) + passage + text(200)))
        at += 1
    for i, leak in items:
        docs.append((at, text(20) + leak.split() + text(20)))
        at += 1
    return [(d, " ".join(w)) for d, w in docs] + [(at, ""), (at + 1, None)], toxic, items


def test_pipeline_against_hand_made_stages(spark, tmp_path):
    rows, toxic, items = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, int(d in toxic)) for d, _ in rows if d % 7]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {"toxicity": [r for r in rows if r[0] not in toxic]}
    drop = {r[0] for r in brute_jaccard(kept["toxicity"]) if not r[5]}
    kept["ngram_jaccard_join"] = [r for r in kept["toxicity"] if r[0] not in drop]
    kept["suffix_array_dedup"] = cut_later_words(kept["ngram_jaccard_join"], 50)
    leaks = {r[0] for r in brute_leaks(kept["suffix_array_dedup"], items, 10) if r[5]}
    kept["benchmark_decontamination"] = [r for r in kept["suffix_array_dedup"] if r[0] not in leaks]
    assert drop and leaks and kept["suffix_array_dedup"] != kept["ngram_jaccard_join"]

    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        assert sorted((r.doc_id, r.text) for r in at.collect()) == sorted(kept[name]), name
        assert all(r.n_chars == len(r.text) for r in at.collect() if r.text is not None)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(kept["benchmark_decontamination"], pieces, packing.TIERS)
