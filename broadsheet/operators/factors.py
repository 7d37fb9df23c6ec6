"""Word vectors by weighted factorisation of co-occurrences: logarithms of pair sums as inner products and biases.

The vocabulary has MAX_VOCAB words at most, so a table of its vectors (4 MB) may pass through the driver; the pair sums, which
can have the square of that, stay in Spark, a row for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.embed import DIMENSIONS, MAX_VOCAB, UNKNOWN, WINDOW
from broadsheet.sources.tables import Tables

# Rounds, the sum from which on a pair has full weight, the power below it, rare words behind the unknown one.
ROUNDS, FULL, POWER, RARE = 30, 100.0, 0.75, 100
#: Places that a task gathers before it sums up their pairs, cells of a bucket, and places and pairs that are worked on at once.
GATHERED, CELLS, SLICE, ROWS = 16_000_000, 2_000_000, 1_000_000, 250_000
#: Words that have pairs with over a share of the vocabulary are worked on together, as a matrix with all cells, if a batch has very many such pairs.
TOGETHER, DENSE, MANY = 32, 0.3, 2_000_000


@dataclass(frozen=True)
class Params:
    size: int = DIMENSIONS
    rounds: int = ROUNDS
    full: float = FULL
    power: float = POWER
    ridge: float = 0.1
    seed: int = 1


def vocabulary(ids: DataFrame) -> dict[str, int]:
    """Of word, id: words by id from 0; more than MAX_VOCAB are an error."""
    rows = ids.select("word", "id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB or sorted(r["id"] for r in rows) != list(range(len(rows))):
        raise ValueError(f"a vocabulary has at most {MAX_VOCAB} words, with ids from 0 on")
    return {r["word"]: r["id"] for r in rows}


def buckets(n: int) -> list[tuple[int, int]]:
    """Ranges of ids below n, such that a range's pairs with ids up to its end have CELLS cells or so."""
    out, lo = [], 0
    while lo < n:
        out.append((lo, min(n, max(lo + 1, int((lo + (lo * lo + 4 * CELLS) ** 0.5) / 2)))))
        lo = out[-1][1]
    return out


def pair_sums(samples: DataFrame, words: str, known: dict[str, int], window: int = WINDOW) -> DataFrame:
    """left int, right int, weight double: each pair of known words up to `window` apart in a sample adds one over its distance, both ways.

    words: array<string> of a sample in order; unknown words count as places. The words of a sample never part: a task
    gathers them as numbers and adds up the pairs of one bucket of ids after another, in an array with a cell for each pair. What
    moves is an array of sums for each bucket and gathering, which the bucket's owner adds up. Weights are whole
    numbers of a common part of 1, 1/2, 1/3 and so on, so that sums are exact in any order.
    """
    if len(known) > MAX_VOCAB:
        raise ValueError(f"a vocabulary has at most {MAX_VOCAB} words")
    unit, ranges, none = lcm(*range(1, window + 1)), buckets(len(known)), 65535

    def summed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(x, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(x, minlength=none + 1)))
        for k, (lo, hi) in enumerate(ranges):
            if ends[lo] == ends[hi]:
                continue
            sums = np.zeros((hi - lo) * hi, np.int64)
            for i in range(ends[lo], ends[hi], SLICE):
                at = order[i : min(i + SLICE, ends[hi])]
                own = x[at]
                row = (own.astype(np.int64) - lo) * hi
                for d in range(1, window + 1):
                    # a pair is counted at its larger id, and at its first place if the ids are equal
                    for y, mine in ((y, y <= own) if d > 0 else (y, y < own) for d in (d, -d) for y in (x[at + d],)):
                        np.add.at(sums, row[mine] + y[mine], unit // d)
            found = np.flatnonzero(sums)
            if len(found):
                packed = [pa.compress(v.tobytes(), "zstd", asbytes=True) for v in (np.diff(found, prepend=0).astype("<u4"), sums[found].astype("<i8"))]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(found)], pa.int32()), *[pa.array([v], pa.binary()) for v in packed]], names=["bucket", "n", "gaps", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            col = b.column(0)
            ends = col.offsets.to_numpy()
            said = col.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            code = np.array([known.get(w, none) for w in said.dictionary.to_pylist()] + [none], np.uint16)
            # samples have a window of places that nothing is known of before, between and after them
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            word = np.full(len(row) + window * (len(b) + 1), none, np.uint16)
            word[np.arange(len(row)) + window * (row + 1)] = code[said.indices.fill_null(len(code) - 1).to_numpy()]
            parts.append(word)
            n += len(word)
            if n > GATHERED:
                yield from summed(np.concatenate(parts))
                parts, n = [], 0
        if parts:
            yield from summed(np.concatenate(parts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, None

        def out() -> Iterator[pa.RecordBatch]:
            lo, hi = ranges[last]
            found = np.flatnonzero(sums)
            for i in range(0, len(found), ROWS):
                at = found[i : i + ROWS]
                x, y, weight = (at // hi + lo).astype(np.int32), (at % hi).astype(np.int32), sums[at] / unit
                two = x != y
                cols = (np.append(x, y[two]), np.append(y, x[two]), np.append(np.where(two, weight, 2 * weight), weight[two]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["left", "right", "weight"])

        for b in batches:
            for k, n, gaps, units in zip(*(b.column(c) for c in ("bucket", "n", "gaps", "sums"))):
                k, n = k.as_py(), n.as_py()
                if k != last:
                    if last is not None:
                        yield from out()
                    last, sums = k, np.zeros((ranges[k][1] - ranges[k][0]) * ranges[k][1], np.int64)
                at, own = (np.frombuffer(pa.decompress(v.as_buffer(), n * size, "zstd"), kind) for v, size, kind in ((gaps, 4, "<u4"), (units, 8, "<i8")))
                sums[np.cumsum(at, dtype=np.int64)] += own
        if last is not None:
            yield from out()

    read = samples.select(words).where(F.col(words).isNotNull()).mapInArrow(run, "bucket int, n int, gaps binary, sums binary")
    # a number of parts, as their size on the way says nothing about what they become
    parts = max(1, min(len(ranges), 3 * samples.sparkSession.sparkContext.defaultParallelism))
    return read.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "left int, right int, weight double")


def weighted(pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """left, right, y: the logarithm of the pair's sum, and f: its weight, one from `full` on."""
    x = F.col("weight")
    return pairs.where(x > 0).select("left", "right", F.log(x).alias("y"), F.least(F.lit(1.0), F.pow(x / p.full, F.lit(p.power))).alias("f"))


def solved(right: np.ndarray, y: np.ndarray, f: np.ndarray, other: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The vector and bias (last) of a word that fit its pairs best, those of the others being given; and what is left of its loss."""
    known = other[right].copy()
    bias = known[:, -1].copy()
    known[:, -1] = 1.0
    by_weight = known * f[:, None]
    own = np.linalg.solve(by_weight.T @ known + ridge * np.eye(known.shape[1]), by_weight.T @ (y - bias))
    return own, float(f @ (known @ own + bias - y) ** 2)


def products(other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word what a weighted sum of gives its part of a linear system: products of its vector (with a one for the bias) and its own bias; and what sums with y need."""
    known, bias = other.copy(), other[:, -1:]
    known[:, -1] = 1.0
    i, j = np.triu_indices(known.shape[1])
    return np.hstack([known[:, i] * known[:, j], known * bias, bias * bias]), np.hstack([known, bias])


def solved_together(right: list[np.ndarray], y: list[np.ndarray], f: list[np.ndarray], sums: tuple[np.ndarray, np.ndarray], ridge: float) -> list[tuple[np.ndarray, float]]:
    """What solved() gives, of several words with most of the vocabulary as their pairs: the sums of all systems are products of matrices."""
    weight = np.zeros((len(right), len(sums[0])))
    weight_y, square = np.zeros_like(weight), np.zeros(len(right))
    for k in range(len(right)):
        weight[k, right[k]], weight_y[k, right[k]], square[k] = f[k], f[k] * y[k], f[k] @ (y[k] * y[k])
    a, b = weight @ sums[0], weight_y @ sums[1]
    size = sums[1].shape[1] - 1
    i, j = np.triu_indices(size)
    system = np.zeros((len(right), size, size))
    system[:, i, j] = system[:, j, i] = a[:, : len(i)]
    target = b[:, :size] - a[:, len(i) : len(i) + size]
    own = np.linalg.solve(system + ridge * np.eye(size), target[:, :, None])[:, :, 0]
    left = np.einsum("ki,kij,kj->k", own, system, own) - 2 * (own * target).sum(axis=1) + a[:, -1] - 2 * b[:, -1] + square
    return list(zip(own, np.maximum(left, 0).tolist()))


def one_thread() -> None:
    """Keeps numpy's OpenBLAS, where that is what it uses, to the task's own core."""
    with contextlib.suppress(OSError):
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
        for lib in map(ctypes.CDLL, paths):
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)


def packed_rows(pairs: DataFrame) -> DataFrame:
    """left, right, y, f: a row for each left word, its pairs by right as little-endian binaries (right of two bytes, others of eight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate([x[c] for x in parts]).astype(kind).tobytes() for c, kind in enumerate(("<u2", "<f8", "<f8"))]
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *[pa.array([c], pa.binary()) for c in cols]], names=["left", "right", "y", "f"])

        for b in batches:
            left, *cols = (b.column(c).to_numpy() for c in ("left", "right", "y", "f"))
            starts = np.flatnonzero(np.diff(left, prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(left)]):
                if left[i] != last:
                    if parts:
                        yield out()
                    last, parts = int(left[i]), []
                parts.append([c[i:j] for c in cols])
        if parts:
            yield out()

    # a number of parts, as the rounds need all cores
    dealt = pairs.select("left", "right", "y", "f").repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "left")
    return dealt.sortWithinPartitions("left", "right").mapInArrow(run, "left int, right binary, y binary, f binary")


def fit(pairs: DataFrame, known: dict[str, int], tables: Tables, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(word, vec array<double>, context array<double>; the last item of both is a bias) and (round, loss, penalty).

    Alternating least squares: with the contexts given, each word's vector and bias are the solution of a small linear
    system over its pairs, and the other way round, as pairs go both ways. What is made smaller is the sum of
    f (vec . context + biases - y)^2 (loss) and ridge times all squares (penalty); it never grows. A word without pairs gets zeros.
    pairs: left, right, y, f as of weighted(), a pair once each way.
    """
    spark, n = pairs.sparkSession, len(known)
    rows = tables.keep(packed_rows(pairs), "rows")
    rng = np.random.default_rng(p.seed)
    sides = [np.zeros((n, p.size + 1)), np.hstack([(rng.random((n, p.size)) - 0.5) / p.size, np.zeros((n, 1))])]

    def half(other: np.ndarray) -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            sums = None
            for b in batches:
                left = b.column("left").to_pylist()
                lists = [[np.frombuffer(v.as_buffer(), kind) for v in b.column(c)] for c, kind in (("right", "<u2"), ("y", "<f8"), ("f", "<f8"))]
                size = np.array([len(x) for x in lists[0]])
                wide = np.flatnonzero(size > DENSE * n)
                wide = wide if size[wide].sum() > MANY else wide[:0]
                found = {i: solved(*[x[i] for x in lists], other, p.ridge) for i in np.setdiff1d(np.arange(len(left)), wide).tolist()}
                for k in range(0, len(wide), TOGETHER):
                    some = wide[k : k + TOGETHER].tolist()
                    sums = products(other) if sums is None else sums
                    found |= zip(some, solved_together(*[[x[i] for i in some] for x in lists], sums, p.ridge))
                out = [found[i] for i in range(len(left))]
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array([x.tobytes() for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.float64())], names=["id", "own", "loss"])

        got = rows.mapInArrow(run, "id int, own binary, loss double").toArrow().sort_by("id")  # as many rows as words
        made = np.zeros_like(other)
        for i, own in zip(got["id"].to_pylist(), got["own"].to_pylist()):
            made[i] = np.frombuffer(own)
        return made, float(sum(got["loss"].to_pylist()))

    curve = []
    for k in range(p.rounds):
        sides[0], _ = half(sides[1])
        sides[1], loss = half(sides[0])
        curve.append((k + 1, loss, p.ridge * float(sum((s**2).sum() for s in sides))))
    made = [(w, sides[0][i].tolist(), sides[1][i].tolist()) for w, i in known.items()]
    return spark.createDataFrame(made, "word string, vec array<double>, context array<double>"), spark.createDataFrame(curve, "round int, loss double, penalty double")


def vectors(fitted: DataFrame, known: dict[str, int]) -> DataFrame:
    """word, vec: a word's vector and context added up, without biases; and the unknown word, the mean of the rarest known ones."""
    spark = fitted.sparkSession
    both = fitted.select("word", F.slice(F.zip_with("vec", "context", lambda a, b: a + b), 1, F.size("vec") - 1).alias("vec"))
    rare = spark.createDataFrame([(w,) for w in sorted(known, key=known.__getitem__)[-RARE:]], "word string")
    mean = both.join(F.broadcast(rare), "word", "left_semi").select(F.posexplode("vec").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("v"))
    unknown = mean.agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("x")).select(F.lit(UNKNOWN).alias("word"), F.transform("x", lambda r: r["v"]).alias("vec"))
    return both.unionByName(unknown)


def fitted_pairs(pairs: DataFrame, fitted: DataFrame, known: dict[str, int]) -> DataFrame:
    """left word, right word, y, f and what the vectors say for y."""
    ids = fitted.sparkSession.createDataFrame(list(known.items()), "word string, id int")
    side = fitted.join(F.broadcast(ids), "word")
    left = side.select(F.col("id").alias("left"), F.col("word").alias("left_word"), "vec")
    right = side.select(F.col("id").alias("right"), F.col("word").alias("right_word"), "context")
    both = pairs.join(F.broadcast(left), "left").join(F.broadcast(right), "right")
    n = F.size("vec")
    dot = F.aggregate(F.zip_with(F.slice("vec", 1, n - 1), F.slice("context", 1, n - 1), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    said = dot + F.element_at("vec", -1) + F.element_at("context", -1)
    return both.select(F.col("left_word").alias("left"), F.col("right_word").alias("right"), "y", "f", said.alias("fitted"))
