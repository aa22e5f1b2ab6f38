from __future__ import annotations

import random

import numpy as np

from tallyframe.llm import toxicity


def corpus(spark, n=1200):
    rng = random.Random(9)
    syll = ["ta", "ri", "mo", "len", "sha", "ve", "un", "dor", "pi", "ka"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = [word() for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["grubbish", "Snarkle", "zorgface", "vexling" + word()]))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    truth = {i: any(b in t.lower() for b in ("grubbish", "snarkle", "zorgface", "vexling")) for i, t in rows}
    rows += [(5000, None), (5001, ""), (5001, ""), (None, "ta ri mo")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200
    right = sum(bool(r["predicted"]) == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert not any(r["predicted"] for r in got if r["doc_id"] in (5000, 5001))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 5001").count() == 2


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = corpus(spark, 500)
    held = {r["doc_id"] for r in toxicity.score(docs, labels).collect() if r["held_out"]}
    turned = spark.createDataFrame([(r["doc_id"], 1 - r["toxic"] if r["doc_id"] in held else r["toxic"]) for r in labels.collect()], "doc_id long, toxic int")
    key = lambda r: (str(r["doc_id"]), r["text_key"])
    a, b = (sorted(map(tuple, toxicity.score(docs, x).collect()), key=str) for x in (labels, turned))
    assert a == b


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.6])
    votes = np.stack([np.where(rng.random(len(y)) < a, y, ~y) for a in right] + [np.zeros(len(y), bool)], axis=1).astype(int)
    votes[:, 4] = votes[:, 1]  # a copy: wholly dependent
    rows, n = np.unique(votes, axis=0, return_counts=True)
    known = votes[:600]
    model = toxicity.LabelModel(np.concatenate([rows, known]), np.concatenate([n, np.ones(600)]).astype(float), np.concatenate([np.full(len(rows), -1), y[:600].astype(int)]))
    acc = model.accuracies()
    assert acc[0] > acc[3] + 0.2 and abs(acc[0] - 0.95) < 0.05
    assert model.parent[4] == 1 or model.parent[1] == 4  # the correlated pair is joined


def test_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(no_docs, none).count() == 0


def test_the_label_model_decides_the_targets(spark, monkeypatch):
    docs, labels, truth = corpus(spark)
    loss = lambda rows: -np.mean([np.log(max(1e-6, r["score"] if truth[r["doc_id"]] else 1 - r["score"])) for r in rows if r["held_out"] and r["doc_id"] in truth])
    with_model = loss(toxicity.score(docs, labels).collect())
    share = lambda model, terms, votes, width: toxicity.fit_linear(terms, toxicity._bits(votes)[:, toxicity.LEXICONS :].astype(float), toxicity._bits(votes).mean(axis=1), width)
    monkeypatch.setattr(toxicity, "fit_classifier", share)
    assert with_model < 0.5 * loss(toxicity.score(docs, labels).collect())


def test_labels_that_gave_no_terms_are_no_targets(spark):
    """The classifier's targets depend on votes alone: documents of one pattern get one target."""
    rng = np.random.default_rng(1)
    votes = rng.integers(0, 2, (500, toxicity.VOTERS))
    rows, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(np.concatenate([rows, rows[:9]]), np.concatenate([n, np.ones(9)]).astype(float), np.array([-1] * len(rows) + [0, 1] * 4 + [0]))
    post = model.posterior(rows)
    assert post.shape == (len(rows),) and ((0 <= post) & (post <= 1)).all()


def test_shouting_and_long_texts(spark):
    none: tuple = ({}, [])
    at = toxicity.VOTERS - len(toxicity.PATTERNS) + toxicity.PATTERNS.index("shouting")
    assert toxicity._values("ALL OF THIS IS LOUD", *none)[1] == 1 << at and toxicity._values("quiet", *none)[1] == 0
    terms, votes = toxicity._values("grubbish words and more " * 200_000, {"grubbish": 0}, [3])
    assert terms == [0] and votes & (1 << 3) and toxicity._values(None, *none) == ([], 0)


def test_clashing_names(spark):
    docs, labels, _ = corpus(spark, 400)
    odd = docs.selectExpr("*", "1 as bad_id", "2 as bad_key", "3 as votes", "'x' as terms")
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
