import itertools
import json

import numpy as np
import pytest

from thrustlog.llm import crf, toxicity


def brute(emissions, transitions):
    n = len(emissions)
    total, marked, moves = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        path = list(zip((0, *y), y, strict=False))
        w = np.exp(sum(e * k for e, k in zip(emissions, y, strict=True)) + sum(transitions[a, b] for a, b in path))
        total += w
        marked += w * np.array(y)
        for a, b in path:
            moves[a, b] += w
    return marked / total, moves / total, np.log(total)


def test_marginals_against_all_paths(monkeypatch):
    draw = np.random.default_rng(0)
    for block in (1, 2, 3, 32):
        monkeypatch.setattr(crf, "BLOCK", block)
        lengths = [3, 0, 1, 7, 0, 5]
        emissions, transitions = draw.normal(size=16) * 2, draw.normal(size=(2, 2))
        got, moves, log_z = crf.Chain(lengths).marginals(emissions, transitions, pairs=True)
        start, all_moves, all_z = 0, np.zeros((2, 2)), 0.0
        for n in lengths:
            if n:
                p, m, z = brute(emissions[start : start + n], transitions)
                assert np.allclose(got[start : start + n], p)
                all_moves, all_z = all_moves + m, all_z + z
            start += n
        assert np.allclose(moves, all_moves) and np.isclose(log_z, all_z)


def test_long_sequences_stay_finite():
    p = crf.Chain([100_000]).marginals(np.full(100_000, 8.0), np.array([[0, -5.0], [-2.0, 1.0]]))
    assert np.isfinite(p).all() and p.min() > 0.9


def test_gradient_by_differences():
    words = ["a", "bad", "c", "bad", "bad", "d"]
    features = toxicity.Emissions(words, np.array([0, 3]), ["bad$", "a$", "c$"])
    chain, labels, draw = crf.Chain([3, 3]), np.array([0, 1, 0, 1, 1, 0]), np.random.default_rng(1)
    w, free = draw.normal(size=features.size), np.array([[0.0, 0.3], [-0.2, 0.1]])

    def value(w):
        e = features.emissions(w)
        return chain.marginals(e, free, pairs=True)[2] - e @ labels

    slope = features.gradient(chain.marginals(features.emissions(w), free) - labels)
    for i in range(features.size):
        step = np.zeros(features.size)
        step[i] = 1e-5
        assert np.isclose((value(w + step) - value(w - step)) / 2e-5, slope[i], atol=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.learned(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    unseen = docs.join(labels, "doc_id").where(toxicity.held_out(docs["doc_id"]))
    rows = toxicity.scored(unseen, model).selectExpr("row.toxic", "predicted").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert right >= 0.95 * len(rows) and sum(caught) >= 0.85 * len(caught)


def test_spans_are_offsets_of_the_text(model):
    text = "İİ THE idiot\n" + "plain words here " * 300 + "you moron!"
    ((score, spans),) = toxicity.Tagger(model.value).scored([text])
    assert score >= 0.5 and [text[a:b] for a, b, _ in spans] == ["idiot", "moron"]


def test_edge_rows(spark, model):
    long = "plain words " * 50_000
    rows = [(1, "idiot moron", None, "x"), (2, "", None, "x"), (3, None, None, "x"), (None, "you idiot and moron", None, "x"), (1, "idiot moron", None, "x"), (4, long, 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, spans string")
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in sorted(got, key=lambda r: str(r["row"]["text"]))] == [0, 0, 1, 1, 0, 1]
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    none = toxicity.learned(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert json.loads(none.value) == {}
    nulls = toxicity.learned(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.scored(docs, nulls).collect()} == {0.0}
