"""Quality classifier: gradients, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from squallframe.llm.mil_quality import WIDTH, AttentionModel, learn, passage_features, score
from squallframe.llm.mil_quality_query import query


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, starts, y, weight = rng.normal(size=(9, WIDTH)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = AttentionModel()

    def loss():
        p = model.forward(x, starts)[0]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    grad = model.gradient(x, starts, y, weight)
    for name, value in model.weights.items():
        for at in list(np.ndindex(value.shape))[:6]:
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-6


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 0.1, (rng.integers(1, 6), WIDTH)) for _ in range(300)]
    y = np.array([i % 2 for i in range(300)], dtype=float)
    for bag, own in zip(bags, y):
        if own:
            bag[rng.integers(len(bag)), 3] += 1
    model = AttentionModel().fit(bags, y, np.ones(300), epochs=60)
    starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    assert ((model.forward(np.concatenate(bags), starts)[0] >= 0.5) == y).mean() > 0.95


def test_features_of_passages():
    x = passage_features("aa " * 64 + "BB# cc\n1.")
    assert x.shape == (2, WIDTH) and np.isclose(x[0, 9], 1 / 64) and np.isclose(x[0, 10], 63 / 64) and np.isclose(x[1, 11], 1 / 3)
    assert passage_features("").tolist() == passage_features(" \n").tolist() == [[0.0] * WIDTH]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = query(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, "good words in a row " * 5 if i % 2 else "BAD!! $$$ " * 9, "x") for i in range(40)]
    rows += [(50, None, "x"), (51, "", "x"), (None, "good words", "x"), (52, "good words " * 30000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, quality int")
    got = score(docs, learn(docs, labels, F.lit(True)))
    assert got.count() == 45 and got.columns == ["doc_id", "text", "score"]
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert score(docs, learn(docs, labels.filter("false"), F.lit(True))).filter("score <> 0.5").count() == 0
    assert score(docs.filter("false"), None).count() == 0


def test_repeated_id_counts_once(spark):
    rows = [(i, "good words in a row " * 5 if i % 2 else "BAD!! $$$ " * 9) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fit = lambda r: learn(spark.createDataFrame(r, "doc_id long, text string"), labels, F.lit(True)).weights
    once, often = fit(rows), fit([*rows, *[rows[3]] * 50])
    assert all(np.array_equal(once[k], often[k]) for k in once)
