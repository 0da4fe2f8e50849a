import zlib

import numpy as np
import pytest

from strandset.llm.toxicity import distinct_voters, fit, label_model, logistic, toxicity


def test_held_out_accuracy(spark, sf):
    """Held out of the training rows, at the size with enough of them."""
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity(docs, fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.predicted for r in got) > 0.9 and hit / sum(r.toxic for r in got) > 0.65


def test_odd_rows_and_training_part(spark):
    texts = {i: (f"a{i} b{i} vile c{i} d{i}" if i % 3 == 0 else f"some fine a{i} words b{i} here") for i in range(400)}
    docs = spark.createDataFrame([*texts.items(), (None, "vile"), (1000, None), (1001, ""), (1002, "vile " * 50000)], "doc_id long, text string").selectExpr("*", "1 AS label")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, fit(docs, labels)).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[0].predicted == got[None].predicted == got[1002].predicted == 1 and got[1].predicted == got[1000].predicted == got[1001].predicted == 0
    flipped = spark.createDataFrame([(i, int(i % 3 == 0) if zlib.crc32(str(i).encode()) % 4 != 2 else 1) for i in range(400)], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity(docs, fit(docs, flipped)).collect()}
    assert again == {k: r.score for k, r in got.items()}


@pytest.mark.parametrize("given", [[], [(1, 0), (2, 0)], [(5, 1)]])
def test_without_both_labels(spark, given):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame(given, "doc_id long, toxic int")
    assert len({r.score for r in toxicity(docs, fit(docs, labels)).collect()}) == 1
    assert toxicity(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_label_model_sees_through_label_noise():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    votes = np.stack([np.where(y, r.random(4000) < a, r.random(4000) < b) for a, b in ((0.8, 0.02), (0.7, 0.1), (0.6, 0.3))], 1).astype(float)
    labels = np.where(r.random(4000) < 0.1, ~y, y).astype(int)
    post, group = label_model(votes, labels)
    assert ((post > 0.5) == y).mean() > max((labels == y).mean(), 0.93)
    assert len(set(label_model(np.hstack([votes, votes[:, :1]]), labels)[1].tolist())) == 3
    w = logistic(votes, post)
    assert w[0] > w[1] > w[2] > 0


def test_voters_that_agree_are_one():
    class Row:
        def __init__(self, votes):
            self.votes = votes

    assert distinct_voters([Row([0, 1]), Row([0, 1, 2]), Row([3])], 7) == [0, 2, 3, 4, 5, 6]
