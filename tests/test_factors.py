import math
import random

import numpy as np
import pytest

from broadsheet.operators import factors
from broadsheet.sources.tables import Tables

P = factors.Params(size=3, rounds=6, full=5.0)


def samples_of(seed, n=80):
    rng = random.Random(seed)
    return [[rng.choice("abcdefgh") if rng.random() < 0.9 else "rare" for _ in range(rng.randint(0, 30))] for _ in range(n)]


def plain_sums(rows, known, window):
    out = {}
    for words in rows:
        for i, x in enumerate(words):
            for d in range(1, window + 1):
                if i + d < len(words) and x in known and (y := words[i + d]) in known:
                    for pair in ((known[x], known[y]), (known[y], known[x])):
                        out[pair] = out.get(pair, 0.0) + 1 / d
    return out


def plain_fit(sums, n, p):
    """Alternating least squares on whole matrices: losses by round, vectors and contexts."""
    X = np.zeros((n, n))
    for (i, j), x in sums.items():
        X[i, j] = x
    W = np.where(X > 0, np.minimum(1, (X / p.full) ** p.power), 0)
    Y = np.where(X > 0, np.log(np.where(X > 0, X, 1)), 0)
    rng = np.random.default_rng(p.seed)
    A, B, losses = np.zeros((n, p.size + 1)), np.hstack([(rng.random((n, p.size)) - 0.5) / p.size, np.zeros((n, 1))]), []

    def solve(other, W, Y):
        D = np.hstack([other[:, :-1], np.ones((n, 1))])
        return np.array([np.linalg.solve((D.T * W[i]) @ D + p.ridge * np.eye(p.size + 1), (D.T * W[i]) @ (Y[i] - other[:, -1])) for i in range(n)])

    for _ in range(p.rounds):
        A = solve(B, W, Y)
        B = solve(A, W.T, Y.T)
        said = A[:, :-1] @ B[:, :-1].T + A[:, -1:] + B[:, -1]
        losses.append((float((W * (said - Y) ** 2).sum()), p.ridge * float((A**2).sum() + (B**2).sum())))
    return losses, A, B


@pytest.fixture(scope="module")
def corpus_(spark):
    rows = samples_of(1)
    known = {c: i for i, c in enumerate("abcdefghz")}  # z is in no sample
    df = spark.createDataFrame([(r,) for r in rows] + [(None,), (["a", None, "b"],)], "words array<string>")
    return rows + [["a", "?", "b"]], known, df.repartition(3)


@pytest.mark.parametrize("gathered", [2_000_000, 50])
def test_sums_like_plain_loops(spark, corpus_, monkeypatch, gathered):
    monkeypatch.setattr(factors, "GATHERED", gathered)
    rows, known, df = corpus_
    want = plain_sums(rows, known, 15)
    got = {(r["left"], r["right"]): r["weight"] for r in factors.pair_sums(df, "words", known).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_fit_like_whole_matrices(spark, corpus_):
    rows, known, df = corpus_
    sums = factors.pair_sums(df, "words", known, 5)
    pairs = factors.weighted(sums, P)
    fitted, curve = factors.fit(pairs, known, Tables(spark, "f"), P)
    losses, A, B = plain_fit(plain_sums(rows, known, 5), len(known), P)
    got = [(r["loss"], r["penalty"]) for r in curve.orderBy("round").collect()]
    assert np.allclose(got, losses)
    assert all(sum(b) <= sum(a) + 1e-9 for a, b in zip(got, got[1:]))
    vecs = {r["word"]: (r["vec"], r["context"]) for r in fitted.collect()}
    for w, i in known.items():
        assert np.allclose(vecs[w][0], A[i]) and np.allclose(vecs[w][1], B[i])
    assert vecs["z"] == ([0.0] * 4, [0.0] * 4)
    said = factors.fitted_pairs(pairs, fitted, known).collect()
    assert sum(r["f"] * (r["fitted"] - r["y"]) ** 2 for r in said) == pytest.approx(losses[-1][0])
    out = {r["word"]: r["vec"] for r in factors.vectors(fitted, known).collect()}
    assert np.allclose(out["a"], A[0, :-1] + B[0, :-1])
    assert np.allclose(out["<unk>"], np.mean([out[w] for w in known], axis=0))


def test_weights(spark):
    r = factors.weighted(spark.createDataFrame([(0, 1, 100.0), (1, 0, 250.0), (0, 0, 1.0)], "left int, right int, weight double")).orderBy("y").collect()
    assert [(x["y"], x["f"]) for x in r] == [(0.0, pytest.approx(0.01**0.75)), (pytest.approx(math.log(100)), 1.0), (pytest.approx(math.log(250)), 1.0)]


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "words array<string>")
    known = {"a": 0}
    assert factors.pair_sums(empty, "words", known).collect() == []
    fitted, _ = factors.fit(factors.weighted(factors.pair_sums(empty, "words", known)), known, Tables(spark, "f"), factors.Params(rounds=1))
    assert fitted.count() == 1
    with pytest.raises(ValueError):
        factors.vocabulary(spark.createDataFrame([("a", 1)], "word string, id int"))


def test_buckets_and_slices(spark, corpus_, monkeypatch):
    """Sums don't depend on how ids are cut into buckets and places into slices, and what moves is packed."""
    rows, known, df = corpus_
    want = {(r["left"], r["right"]): r["weight"] for r in factors.pair_sums(df, "words", known).collect()}
    for name, value in (("CELLS", 6), ("SLICE", 7), ("ROWS", 3)):
        monkeypatch.setattr(factors, name, value)
    assert factors.buckets(9)[0] == (0, 2) and factors.buckets(9)[-1][1] == 9
    sums = factors.pair_sums(df, "words", known)
    got = [(r["left"], r["right"], r["weight"]) for r in sums.collect()]
    assert len(got) == len(want) and {(x, y): w for x, y, w in got} == want
    assert "Aggregate" not in sums._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("together, dense", [(4, 0.0), (2, 0.7), (1, 2.0)])
def test_words_together_like_one_by_one(spark, corpus_, monkeypatch, together, dense):
    rows, known, df = corpus_
    monkeypatch.setattr(factors, "TOGETHER", together)
    monkeypatch.setattr(factors, "DENSE", dense)
    monkeypatch.setattr(factors, "MANY", 0)
    fitted, curve = factors.fit(factors.weighted(factors.pair_sums(df, "words", known, 5), P), known, Tables(spark, "f"), P)
    losses, A, B = plain_fit(plain_sums(rows, known, 5), len(known), P)
    assert np.allclose([(r["loss"], r["penalty"]) for r in curve.orderBy("round").collect()], losses)
    vecs = {r["word"]: (r["vec"], r["context"]) for r in fitted.collect()}
    assert all(np.allclose(vecs[w][0], A[i]) and np.allclose(vecs[w][1], B[i]) for w, i in known.items())
