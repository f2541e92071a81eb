"""Counterfactual swaps, and the classifier on rows that it hasn't learned from."""

from __future__ import annotations

import zlib

import numpy as np

from codeloom.llm import toxicity
from codeloom.llm.labelled import labelled_sample
from codeloom.llm.queries import QUERIES


def test_swaps_are_of_sentences():
    got = toxicity.swapped("Nothing here. The Women met old men!\nwomenfolk came\n\nMuslims, again?", swaps=3)
    assert [s for s, _ in got] == ["The Women met old men!", "Muslims, again?"]
    for sentence, others in got:
        assert len(others) == 3
        for o in others:
            words = toxicity._RUN.findall(o)
            assert len(words) == len(toxicity._RUN.findall(sentence)) and set(w for w in words if w in toxicity.IDENTITY_TERMS)
            assert not {"Women", "men", "Muslims"} & set(words) - set(toxicity.IDENTITY_TERMS)
    assert toxicity.swapped("") == [] and toxicity.swapped("x" * 2_000_000) == []
    assert toxicity.swapped("women.") == toxicity.swapped("women.")


def test_a_change_is_what_one_sentence_has_more():
    words = ["alpha", "beta", "women", "men"]
    m = toxicity.Model(toxicity.with_terms(np.unique(np.concatenate(list(toxicity.features([w.encode() for w in words]))))))
    f = list(toxicity.features([b"alpha women", b"alpha men", b"alpha"]))
    d = m.change(f[0], f[1])
    assert set(d.tolist()) == {*(m.positions(next(toxicity.features([b"women"]))) + 1).tolist(), *(-(m.positions(next(toxicity.features([b"men"]))) + 1)).tolist()}
    assert m.change(f[2], f[2]).size == 0


def test_neutral_mentions_of_a_group_that_toxic_texts_name(spark):
    """A group named mostly in toxic sentences, and with words of its own beginnings beside it."""
    rng = np.random.default_rng(8)
    plain, rows = [f"n{k}" for k in range(40)], []
    for k in range(600):
        toxic = k % 4 == 0
        words = list(rng.choice(plain, 6)) + (["immigrants"] if toxic or k % 60 == 1 else [])
        rows.append((k, " ".join(rng.permutation(words)) + "." + (" they are vile scum." if toxic and k % 8 else ""), int(toxic)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    neutral = [b"n1 immigrants n2 n3.", b"n4 n5 immigrants."]
    free, held = (toxicity.train(sample, swap=w) for w in (0.0, 20.0))
    assert free.scores(neutral).min() > 0.5 > held.scores(neutral).max()
    assert held.scores([b"n1 they are vile scum."])[0] > 0.5


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    rows = QUERIES["op4_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    got = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught, false = sum(p and t for p, t in got), sum(p and not t for p, t in got)
    print(f"{caught} of {sum(t for _, t in got)} found, {false} false alarms among {sum(not t for _, t in got)}")
    assert caught >= 0.8 * sum(t for _, t in got) and false <= 0.02 * len(got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} text", "x") for k in range(200)], "doc_id long, text string, label string")
    marks = [(k, int(k % 7 == 0)) for k in range(200)]
    turned = [(k, 1 - m if zlib.crc32(str(k).encode()) % 5 == 0 else m) for k, m in marks]
    models = []
    for rows in (marks, turned):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        models.append(toxicity.train(labelled_sample(docs.where(toxicity.trains()), labels.where(toxicity.trains()), "toxic")))
    assert (models[0].w == models[1].w).all() and models[0].b == models[1].b
