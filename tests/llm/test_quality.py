import zlib

import numpy as np
import pytest

from heddle.llm import queries, quality


def by_hand(net, text):
    """The network on one text, one place at a time."""
    w = net.weights
    padded = text + bytes(quality.WIDTH)
    responses = [sum(w["table"][k][padded[i + k]] for k in range(quality.WIDTH)) for i in range(len(text))]
    halves = [np.max(responses[i : i + quality.HALF], axis=0) for i in range(0, len(text), quality.HALF)] or [np.full(quality.FILTERS, quality.NOTHING)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    logits = [np.maximum(np.maximum(c + w["bias"], 0) @ w["dense"] + w["dense_bias"], 0) @ w["out"] for c in chunks]
    z = w["end"] @ np.array([np.mean(logits), min(logits), 1])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_are_those_of_single_texts():
    rng = np.random.default_rng(3)
    net = quality.Network(5)
    net.weights["bias"] += 0.1
    texts = [b"", b"a", b"x" * 127, b"y" * 128, b"z" * 129, b"", rng.integers(0, 256, 999, dtype=np.uint8).tobytes(), bytes(300), rng.integers(97, 110, 70_000, dtype=np.uint8).tobytes()]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), first)
    assert got == pytest.approx([by_hand(net, t) for t in texts], abs=1e-5)


def test_one_class_or_no_label():
    assert quality.train([], np.array([])).scores(np.frombuffer(b"ab", np.uint8), np.array([0, 2])) == pytest.approx([0.5])
    ones = quality.train([b"a", b"b"], np.array([1, 1]))
    assert ones.scores(np.frombuffer(b"", np.uint8), np.array([0, 0])) > 0.99


def test_sample_keeps_its_bounds(spark):
    docs = spark.createDataFrame([(i, None if i == 9 else "text " * i) for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(2, 1), (None, 1), (3, None), (4, 7), (1000, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    texts, given = quality.training_sample(docs, labels, rows=10)
    assert len(texts) <= 20 and set(given) <= {0, 1}
    texts, given = quality.training_sample(docs, labels, rows=100)
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and i not in (2, 9)]
    assert sorted(texts) == sorted(quality._sampled(("text " * i).encode()) for i in usable)


def test_operator_on_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (3, None), (4, ""), (5, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as SCORE", "2 as held_out")
    net = quality.Network()
    got = quality.score_quality(docs, net).collect()
    assert [r.doc_id for r in got] == [1, 1, None, 3, 4, 5]
    assert got[0].score == got[1].score and got[3].score == got[4].score
    assert [r.held_out for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score_quality(docs.limit(0), net).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in queries.op7_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    right = np.mean([labels[r.doc_id] == r.predicted for r in got])
    bad = np.mean([r.predicted == 0 for r in got if labels[r.doc_id] == 0])
    assert right > 0.97 and bad > 0.93
