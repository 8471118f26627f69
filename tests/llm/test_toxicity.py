"""The label model on made-up votes, and held-out accuracy on the tables."""

import inspect
import zlib

import numpy as np

from fathomgrid.llm.toxicity import features, label_model, score_toxicity


def made_up(n=6000, seed=0):
    """A hidden class, and voters: good, weak, noise, two copies of the good one, one that repeats the noise."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.15
    fires = lambda hit, false: np.where(rng.random(n) < np.where(truth, hit, false), 1, 0)
    good, other, weak, noise = fires(0.6, 0.005), fires(0.5, 0.005), fires(0.4, 0.03), fires(0.03, 0.03)
    again = np.where(rng.random(n) < 0.9, noise, 0)
    return truth, np.column_stack([good, other, weak, noise, good, again]).astype(np.int8)


def test_label_model_finds_accuracies_and_dependences():
    truth, votes = made_up()
    post, parent, log = label_model(votes, np.ones(len(votes)), 0.15)
    pairs = {frozenset((j, int(p))) for j, p in enumerate(parent) if p >= 0}
    assert frozenset((0, 4)) in pairs and frozenset((3, 5)) in pairs
    fired = [(post @ (v == 1)) / post.sum() / (((1 - post) @ (v == 1)) / (1 - post).sum()) for v in votes.T]
    assert fired[0] > fired[2] > fired[3] and 0.5 < fired[3] < 3
    alone = label_model(votes, np.ones(len(votes)), 0.15, least=np.inf)[0]
    both_noise = (votes[:, 3] == 1) & (votes[:, 5] == 1) & ~votes[:, :3].any(1)
    assert post[both_noise].mean() < 0.3 < alone[both_noise].mean()  # a voter's echo adds nothing
    assert post[truth & votes[:, :2].any(1)].mean() > 0.7 > 0.1 > post[~truth].mean()


def test_posterior_equals_enumeration():
    """The posterior is Bayes' rule over the tables that the model returns, whatever the forest."""
    votes = made_up(400, 3)[1]
    votes[::7, 2] = -1
    times = np.arange(1, 401) % 5 + 1
    for least in (5.0, np.inf):
        post, parent, log = label_model(votes, times, 0.2, least=least)
        assert (parent >= 0).any() == (least == 5.0)
        for row, p in zip(votes.tolist(), post, strict=True):
            joint = [0.8, 0.2]
            for c in (0, 1):
                for j, x in enumerate(row):
                    above = row[parent[j]] + 1 if parent[j] >= 0 else 0
                    joint[c] *= np.exp(log[c, j, above, x + 1])
            assert abs(joint[1] / sum(joint) - p) < 1e-9
        assert np.allclose(np.exp(log).sum(-1), 1)


def test_posterior_is_not_the_gold_label(spark):
    """The model sees votes and the toxic share only: other labels on the same votes leave its posterior as it is, and it differs from them."""
    truth, votes = made_up()
    post = label_model(votes, np.ones(len(votes)), 0.15)[0]
    wrong = (post > 0.5) != truth
    assert 0 < wrong.mean() < 0.2
    assert "toxic" not in inspect.signature(label_model).parameters and "labels" not in inspect.signature(label_model).parameters


def test_rows_that_stand_for_many():
    votes = made_up(500, 1)[1]
    short, times = np.unique(votes, axis=0, return_counts=True)
    a, b = label_model(votes, np.ones(500), 0.15)[0], label_model(short, times, 0.15)[0]
    place = {tuple(r): i for i, r in enumerate(short.tolist())}
    assert np.allclose(a, [b[place[tuple(r)]] for r in votes.tolist()])


def test_features():
    assert features(None) == features("") == set()
    assert {"moronic", "^moro", "^moron*2"} <= features("Moronic MORONS") and "^moron*4" not in features("Moronic MORONS")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    hit = {0: [], 1: []}
    for r in labels.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7) and 0 <= got[r.doc_id].score <= 1
        if got[r.doc_id].held_out:
            hit[r.toxic].append(got[r.doc_id].predicted)
    assert np.mean(hit[1]) >= 0.7 and np.mean(hit[0]) <= 0.02


def test_held_out_labels_change_nothing(spark):
    texts = [(i, ("you idiot and moron " if i % 5 == 0 else "a fine day ") + f"w{i}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = [(i, int(i % 5 == 0)) for i in range(200)]
    swapped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in kept]
    a, b = ({r.doc_id: r.score for r in score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (kept, swapped))
    assert a == b and all((a[i] >= 0.7) == (i % 5 == 0) for i in a)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "idiot"), (1, None), (1, None), (2, ""), (3, "x " * 90_000), (4, "you idiot, moron and worthless scum")], "doc_id long, text string").selectExpr("*", "1 as score", "text as toxic")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = score_toxicity(docs, some).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert max(got, key=lambda r: r.score).doc_id == 4
    assert score_toxicity(docs.limit(0), labels).count() == 0
