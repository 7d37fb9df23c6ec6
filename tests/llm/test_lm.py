import numpy as np

from broadsheet.llm import lm
from broadsheet.llm.common import Scratch


def by_hand(net: dict, x: list[int], i: int) -> float:
    """log P of the token at i, unit by unit."""
    a = net["hidden"].astype(float).copy()
    for d in range(1, lm.AROUND + 1):
        a += net["near"][0][x[i - d]] * net["scale"][0][d - 1].astype(float)
        a += net["near"][1][x[i + d]] * net["scale"][1][d - 1].astype(float)
    h = np.tanh(a)
    kind, slot = divmod(x[i], lm.SIDE)
    z = h @ net["kind"] + net["kind_bias"]
    y = h @ net["token"][kind] + net["token_bias"][kind]
    return float(z[kind] - np.log(np.exp(z).sum()) + y[slot] - np.log(np.exp(y).sum()))


def made(seed=3):
    rng = np.random.default_rng(seed)
    flat = lm.start(rng.integers(0, 50, lm.TOKENS), seed)
    border = [lm.TOKENS] * lm.AROUND
    x = np.array(border + list(rng.integers(0, lm.TOKENS, 40)) + border)
    return flat, x, np.arange(lm.AROUND, lm.AROUND + 40)


def test_network_is_the_formula():
    flat, x, at = made()
    got = lm.Network(flat).log_p(x, at)
    assert np.allclose(got, [by_hand(lm.views(flat), list(x), i) for i in at], atol=1e-4)
    # over all tokens that could stand at a place, probabilities sum to one
    total = 0.0
    for t in range(lm.TOKENS):
        y = x.copy()
        y[at[5]] = t
        total += np.exp(lm.Network(flat).log_p(y, at[5:6])[0])
    assert abs(total - 1) < 1e-3


def test_gradients_are_differences():
    flat, x, at = made()
    flat = flat.astype(np.float64)
    net = lm.Network(flat, np.zeros_like(flat))
    seen = []
    net.step = seen.extend
    net.log_p(x, at, learn=True)
    g = np.zeros_like(flat)
    for name, where, v in seen:
        lm.views(g)[name][where] = v
    rng = np.random.default_rng(1)
    for i in [*rng.choice(np.flatnonzero(g), 150), *range(2 * (lm.TOKENS + 1) * lm.HIDDEN, 2 * (lm.TOKENS + 1) * lm.HIDDEN + 5 * lm.HIDDEN, 7)]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        want = -(lm.Network(up).log_p(x, at).sum() - lm.Network(down).log_p(x, at).sum()) / 2e-4
        assert abs(g[i] - want) < 1e-5 + 1e-4 * abs(want)


def test_scores_are_sums_over_the_network(spark, odd, corpus):
    model = lm.fit(corpus, Scratch(spark, "fit"))
    got = {(r["doc_id"]): r for r in lm.score(corpus, model).collect()}
    coding, net = lm.Coding(model.own), lm.views(model.flat)
    for r in corpus.limit(15).collect():
        codes = [coding.code(w) for w in lm.words_of(r["text"])]
        border = [lm.TOKENS] * lm.AROUND
        x = border + [c // lm.CELLS for c in codes] + border
        want = sum(by_hand(net, x, i + lm.AROUND) + (float(model.share[c - lm.OWN * lm.CELLS]) if c >= lm.OWN * lm.CELLS else 0) for i, c in enumerate(codes))
        assert abs(got[r["doc_id"]]["log_likelihood"] - want) < 1e-4 * max(1, abs(want)) and got[r["doc_id"]]["n_tokens"] == len(codes)
    rest = np.exp(model.share.reshape(lm.RARE, lm.CELLS).astype(float)).sum(axis=1)
    assert np.allclose(rest, 1, atol=1e-3)
    rows = lm.score(odd, model).collect()
    assert len(rows) == odd.count() and {r["per_token"] for r in rows if not r["n_tokens"]} == {None}
    assert np.isfinite(lm.fit(odd, Scratch(spark, "odd")).flat).all()
    none = lm.fit(odd.where("false"), Scratch(spark, "none"))
    assert lm.score(odd.where("false"), none).count() == 0 and np.isfinite(none.flat).all()


def test_coded_texts_train_and_score_as_texts(spark, odd, corpus):
    for docs in (corpus.coalesce(1), odd.coalesce(1), odd.where("false")):
        own, by_code = lm.vocabulary(docs, Scratch(spark, "own"))
        coded = lm.code_texts(docs, own)
        read = [(r["doc_id"], len(r["tokens"]), len(r["cells"])) for r in coded.collect()]
        assert read == [(r["doc_id"], *[2 * len(lm.words_of(r["text"] or ""))] * 2) for r in docs.collect()]
        by_text, by_code_of = lm.fit_to(docs, own, by_code), lm.fit_to(coded, own, by_code)
        assert np.allclose(by_text.flat, by_code_of.flat, atol=1e-6)
        same = [[(r["doc_id"], r["n_tokens"], round(r["log_likelihood"], 3)) for r in lm.score(d, by_text).collect()] for d in (docs, coded)]
        assert same[0] == same[1]
    rows = lm.fit_score(odd, Scratch(spark, "both")).collect()
    assert len(rows) == odd.count() and {r["per_token"] for r in rows if not r["n_tokens"]} == {None}


def test_groups_of_coded_texts_are_bounded(monkeypatch):
    """Small groups have the same words, each text whole."""
    monkeypatch.setattr(lm, "GROUP", 5)
    n = np.array([3, 0, 4, 9, 0, 1, 2])
    words = np.arange(n.sum())
    parts = [w.astype(np.uint16).tobytes() for w in np.split(words, np.cumsum(n)[:-1])]
    b = lm.pa.RecordBatch.from_arrays([lm.pa.array(parts, lm.pa.binary())] * 2, names=["tokens", "cells"])
    got = list(lm.groups(b, []))
    assert len(got) > 2 and np.array_equal(np.concatenate([k for _, k in got]), n)
    assert np.array_equal(np.concatenate([c[lm.centres(k)] for c, k in got]), words * (lm.CELLS + 1))
    assert all(len(c) == k.sum() + lm.AROUND * (len(k) + 1) for c, k in got)


def test_words_are_coded_once(spark, corpus, monkeypatch):
    """A text is cut for the counts and for its codes; rounds and scores read those."""
    seen = []
    code, train, score = lm.code_texts, lm.train, lm.score
    monkeypatch.setattr(lm, "code_texts", lambda *a: seen.append("code") or code(*a))
    monkeypatch.setattr(lm, "train", lambda docs, *a: seen.append(docs.columns) or train(docs, *a))
    monkeypatch.setattr(lm, "score", lambda docs, *a: seen.append(docs.columns) or score(docs, *a))
    lm.fit_score(corpus, Scratch(spark, "once"))
    assert seen == ["code", ["doc_id", "tokens", "cells"], ["doc_id", "tokens", "cells"]]


def test_large_numbers_are_summed_safely():
    flat, x, at = made()
    lm.views(flat)["kinds"][:] *= 40
    lm.views(flat)["tokens"][:] *= 40
    lm.views(flat)["kind_bias"][:] += 150
    want = [by_hand(lm.views(flat), list(x), i) for i in at]
    with np.errstate(over="raise", invalid="raise"):
        assert np.allclose(lm.Network(flat).log_p(x, at), want, rtol=1e-4, atol=1e-2)


def test_one_task_trains_as_the_plain_loop(spark, corpus):
    docs = corpus.coalesce(1)
    texts = [r["text"] or "" for r in docs.collect()]
    own = sorted({w for t in texts[:20] for w in lm.words_of(t)}, key=lambda w: w[::-1])[: lm.OWN]
    flat = lm.start(np.zeros(lm.TOKENS))
    got = lm.train(docs, own, flat, 1)
    net, coding = lm.Network(flat.copy(), np.zeros_like(flat)), lm.Coding(own)
    for r in range(lm.ROUNDS):
        codes, n = coding.batch(texts[r :: lm.ROUNDS])
        at = np.random.default_rng(r).permutation(lm.centres(n))
        for i in range(0, len(at), lm.BLOCK):
            net.log_p(codes // lm.CELLS, at[i : i + lm.BLOCK], learn=True)
    assert np.abs(got - flat).max() > 0.1 and np.allclose(got, net.flat, atol=1e-3)


def test_held_out_tokens_are_predicted_from_both_sides(spark, corpus):
    """Better than by frequencies alone, which the network starts from."""
    model = lm.fit(corpus.where("doc_id % 4 <> 0"), Scratch(spark, "held"))
    coding = lm.Coding(model.own)
    codes, n = coding.batch([r["text"] or "" for r in corpus.where("doc_id % 4 = 0").collect()])
    known, _ = coding.batch([r["text"] or "" for r in corpus.where("doc_id % 4 <> 0").collect()])
    counts = np.bincount(known // lm.CELLS, minlength=lm.TOKENS + 1)[: lm.TOKENS]
    alone = lm.Model(model.own, lm.start(counts), model.share)
    for k in ("near", "kind", "token"):
        lm.views(alone.flat)[k][:] = 0
    assert model.score(codes, n).sum() > alone.score(codes, n).sum() + 0.05 * n.sum()


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The package only on the driver's path: what a job sends has to be whole."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    said = f"""
import sys
sys.path.insert(0, {str(root)!r})
from broadsheet.llm import common, lm
from broadsheet.session import build_session
spark = build_session("alone", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
docs = spark.createDataFrame([(1, "a b c a b c"), (2, None)], "doc_id long, text string")
print(lm.score(docs, lm.fit(docs, common.Scratch(spark, "x"))).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("2"), ran.stderr[-2000:]
