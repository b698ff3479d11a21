"""Training in the tasks against training on the texts."""

from __future__ import annotations

from vigilake.llm import toxicity


def sample():
    fine = ["the garden is green today", "we walk to the lake", "rain fell over the town", "a train came late"]
    texts = [". ".join([fine[i % 4], fine[i // 4 % 4], f"you utter scumbag {i}" if i % 5 == 0 else f"number {i} is kind"]) for i in range(200)]
    return texts, [int(i % 5 == 0) for i in range(200)]


def test_fit_leaves_texts_in_the_tasks_and_learns_the_same(spark, monkeypatch):
    assert toxicity.SAMPLE == 3000
    texts, toxic = sample()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    want = toxicity.train(texts, toxic)
    monkeypatch.setattr(toxicity, "_telling", lambda *a: 1 / 0)  # reads texts in the driver
    got = toxicity.fit(docs, labels)
    assert want.weights and got.weights.keys() == want.weights.keys()
    assert all(abs(got.weights[f] - w) < 1e-6 for f, w in want.weights.items()) and abs(got.bias - want.bias) < 1e-6


def test_words_are_those_of_the_sentences():
    model = toxicity.SentenceModel({"=scumbag": 9.0}, -6.0)
    for mark in ".!?\n":
        score, found = model.document(f"fine{mark}Scumbag")
        assert score > 0.9 and [x[:2] for x in found] == [(5, 12)]
        assert "=scumbag" in toxicity._features_of(f"fine{mark}Scumbag")
