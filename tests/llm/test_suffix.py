import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import common, suffix
from broadsheet.llm.common import Scratch


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120) | st.text(alphabet="ab", max_size=200).map(str.encode))
def test_suffix_array(t):
    got = suffix.two_stage(np.frombuffer(t, np.uint8), len(t) + 1).tolist()
    assert got == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows, n):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            first = seen.setdefault(b[s : s + n], (i, s))
            gone[s : s + n] |= first != (i, s)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(map(str, out))


def ran(df, name, n):
    return sorted(str(tuple(r)) for r in suffix.dedup(df, Scratch(df.sparkSession, name), n).collect())


@pytest.mark.parametrize("n", [100, 60])
def test_like_brute_force(spark, odd, nothing, corpus, n):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    p = "A passage of some length that many documents hold, with its own words, over and over again: yes, indeed. "
    rows += [(1000 + i, f"{i} " + "pre" * (i % 5) + p * (1 + i % 3) + f" post {i}") for i in range(60)]
    rows += [(2000, "a" * 400), (2001, "b" * 99 + "a" * 99), (2002, "ab" * 150), (2003, "é" * 70 + "a" * 101), (2004, None), (2005, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ran(df, "b", n) == brute(rows, n)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert ran(odd, "o", 100) == brute(rows, 100)
    assert ran(nothing, "n", 100) == []


def test_one_row_of_those_that_repeat_stays(spark):
    a, b = "".join(f"{i} little ducks, " for i in range(40)), "".join(f"{i} large geese; " for i in range(40))
    rows = [(1, a), (1, a), (2, b), (3, b), (3, b), (3, "another text of the same id " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ran(df, "r", 100) == brute(rows, 100)


def test_beyond_the_broadcast_bounds(spark, odd, monkeypatch):
    for where, name in ((suffix, "BROADCAST_MARKS"), (suffix, "BROADCAST_BYTES"), (common, "BROADCAST_ROWS")):
        monkeypatch.setattr(where, name, 0)
    p = "A passage of some length that a few documents hold, with words of its own, over and over again: yes, indeed. "
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows += [(100 + i, f"{i} " + p * (1 + i % 3) + f" post {i % 4}") for i in range(20)] + [(130, p * 2), (131, p * 2), (131, p * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ran(df, "w", 100) == brute(rows, 100)


def test_spans_and_kept_bytes(spark):
    p = "é passage of some length that many documents hold, with its own words, over and over again: yes, indeed, é"
    rows = [(1, f"one {p} end"), (2, f"two {p} fin {p}"), (3, f"one {p} end"), (4, "short"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.cut_out(df, Scratch(spark, "s"), 100).collect()}
    raw = {i: (t or "").encode() for i, t in rows}
    kept = {i: bytes(got[i]["kept"]) for i in got}
    assert kept == {1: raw[1], 2: raw[2].replace(f" {p} ".encode(), b"").replace(f" {p}".encode(), b""), 3: b"", 4: b"short", 5: b""}
    for i, r in got.items():
        gone = [x for lo, hi in zip(r["lo"], r["hi"]) for x in range(lo, hi)]
        assert bytes(x for k, x in enumerate(raw[i]) if k not in gone) == kept[i]
    assert (got[3]["lo"], got[3]["hi"]) == ([0], [len(raw[3])])


@pytest.mark.parametrize("n", [2, 12, 40, 100, 296, 400])
def test_passages_about_as_long_as_the_strings(spark, n):
    """Pairs that share a bit less, as much and a bit more than a string, or nothing at all."""
    rng = np.random.default_rng(n)
    word = lambda k: bytes(rng.integers(97, 123, k).astype(np.uint8)).decode()
    for k, shared in enumerate([n // 2 - 1, n // 2 + 1, 45, 70, n - 1, n, n + 1, 0, 3 * n]):
        p = word(max(shared, 0))
        rows = [(1, word(170) + p + word(180)), (2, word(150) + p + word(210)), (3, word(90))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert ran(df, f"p{k}", n) == brute(rows, n), shared


def test_too_short_strings(spark, odd, scratch):
    with pytest.raises(ValueError):
        suffix.cut_out(odd, scratch, 1)
