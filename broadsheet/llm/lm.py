"""LM scoring: masked pseudo-likelihood of a window network that sees both sides of every token.

The vocabulary is the corpus's most frequent words and buckets of the others by their endings. A network in numpy gives each
token from the AROUND tokens at its left and as many at its right: embeddings of each side, scaled by distance, make a hidden
layer, and a softmax of two levels (a class, then a token of the class) has the token's probability. A rarer word's share in its
bucket comes from counts of the whole corpus. Every token of the corpus is trained on once: tasks go over their own rows in small
steps, and after each of ROUNDS rounds their networks are averaged, by tokens seen.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS, small_groups, worker_cache
from .common import Scratch

#: Classes, and tokens of each class.
SIDE = 64
TOKENS = SIDE * SIDE
#: Tokens that are buckets of rarer words, the last ones; all others are words. A bucket's words are counted in cells.
RARE, CELLS = TOKENS // 4, 512
OWN = TOKENS - RARE
#: Neighbours on each side, and hidden units.
AROUND, HIDDEN = 2, 24
#: Rounds of training, step size, tokens of a step.
ROUNDS, STEP, BLOCK = 3, 0.1, 8192
#: Places whose layers are worked out at once, and a number up to which exponentials can be summed as they are.
PLACES, LIMIT = 1024, 80
#: Tokens that a training task has at least where the input's partitions allow it: each task sends a whole network.
TASK = 2_000_000
#: Tokens that are worked on together where texts are coded already, about as many as small_groups has words.
GROUP = 600_000
#: Numbers of a network that travel together.
CHUNK = 8192


def words_of(text: str) -> list[str]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts; each task sums up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(words_of(t))
                if len(seen) > WORDS:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Coding(dict):
    """Words to codes, token * CELLS + cell. Token TOKENS is the border of a document. It remembers codes that it has given."""

    def __init__(self, own: list[str]) -> None:
        super().__init__()
        self.own = {w: i for i, w in enumerate(own)}

    def __missing__(self, word: str) -> int:
        self[word] = code = self.code(word)
        return code

    def code(self, word: str) -> int:
        if word in self.own:
            return self.own[word] * CELLS
        return (OWN + zlib.crc32(word[-3:].encode()) % RARE) * CELLS + zlib.crc32(word.encode()) % CELLS

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one after another, and the number of words of each."""
        if len(self) > WORDS:
            self.clear()
        n = []

        def words() -> Iterator[list[str]]:
            # a text's words are gone before the next one's, so they stay in a core's cache
            for t in texts:
                found = words_of(t)
                n.append(len(found))
                yield found

        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(words())), np.int32)
        return codes, np.array(n, np.int64)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, with AROUND borders before, between and after them; and the number of words of each."""
        codes, n = self.cut(texts)
        return bordered(codes, n), n


def centres(n: np.ndarray) -> np.ndarray:
    """Places of all words in what Coding.batch gives."""
    return np.arange(int(n.sum())) + AROUND * (1 + np.repeat(np.arange(len(n)), n))


def bordered(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.full(len(codes) + AROUND * (len(n) + 1), TOKENS * CELLS, np.int32)
    out[centres(n)] = codes
    return out


def code_texts(docs: DataFrame, own: list[str], id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, and tokens and cells of the whole text's words, two bytes each; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = coding_of(own)
        for b in batches:
            at = 0
            for texts in small_groups(b.column("text").to_pylist()):
                codes, n = coding.cut(texts)
                ends = pa.py_buffer(np.append(0, np.cumsum(2 * n)).astype(np.int32))
                parts = [pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(v.astype(np.uint16))]) for v in (codes // CELLS, codes % CELLS)]
                yield pa.RecordBatch.from_arrays([b.column(id_col).slice(at, len(n)), *parts], names=[id_col, "tokens", "cells"])
                at += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, tokens binary, cells binary")


def groups(b: pa.RecordBatch, own: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What Coding.batch gives for the texts of a batch, or for what code_texts() made of them (cells only where it has them)."""
    if "text" in b.schema.names:
        yield from map(coding_of(own).batch, small_groups(b.column("text").to_pylist()))
        return
    columns = [b.column(k) for k in ("tokens", "cells") if k in b.schema.names]
    n = np.array([len(t) // 2 for t in columns[0].to_pylist()], np.int64)
    # rows whose first token is in the same GROUP of tokens
    of = (np.cumsum(n) - n) // GROUP
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(n) else []
    for i, j in zip(starts, [*starts[1:], len(n)]):
        codes, *cells = (np.frombuffer(b"".join(c.slice(i, j - i).to_pylist()), np.uint16).astype(np.int32) for c in columns)
        codes *= CELLS
        yield bordered(sum(cells, codes), n[i:j]), n[i:j]


def coding_of(own: list[str]) -> Coding:
    """The coding of these words; a worker keeps the last one, with what it has coded."""
    kept = worker_cache()
    if getattr(kept, "coding", (None,))[0] != own:
        kept.coding = (own, Coding(own))
    return kept.coding[1]


def one_thread() -> None:
    """Keeps numpy's OpenBLAS, where that is what it uses, to the task's own core."""
    with contextlib.suppress(OSError):
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
        for lib in map(ctypes.CDLL, paths):
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)


def softmax(z: np.ndarray, said: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """log P of what each row said, a place in z as a whole; and the sums of the exponentials that it puts in z's place, for gradients.

    small says that no number passes LIMIT, so that exponentials can be taken as they are.
    """
    if not small:
        z -= z.max(axis=1, keepdims=True)
    of = z.take(said)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return of - np.log(total), total


def errors(z: np.ndarray, total: np.ndarray, said: np.ndarray) -> None:
    """Puts in z's place the gradients of -log P of what was said by the numbers that softmax() was given."""
    z *= (1 / total)[:, None]
    z.reshape(-1)[said] -= 1


#: The arrays of a network, one after another in a vector: embeddings of the tokens at each side, scales of each side's
#: distances, the hidden layer's bias, then weights of the classes and of the tokens of each class, a bias as their last row.
SHAPES = {
    "near": (2, TOKENS + 1, HIDDEN), "scale": (2, AROUND, HIDDEN), "hidden": (HIDDEN,), "kinds": (HIDDEN + 1, SIDE), "tokens": (SIDE, HIDDEN + 1, SIDE),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out | {"kind": out["kinds"][:-1], "kind_bias": out["kinds"][-1], "token": out["tokens"][:, :-1], "token_bias": out["tokens"][:, -1]}


def start(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """The network before training: small random embeddings, and the tokens' frequencies as biases."""
    flat = np.zeros(SIZE, np.float32)
    net = views(flat)
    rng = np.random.default_rng(seed)
    for k in ("near", "kind", "token"):
        net[k][:] = rng.normal(0, 0.1, net[k].shape)
    net["scale"][:] = 1 / np.arange(1, AROUND + 1)[:, None]
    n = counts.reshape(SIDE, SIDE) + 1.0
    net["kind_bias"][:] = np.log(n.sum(axis=1) / n.sum())
    net["token_bias"][:] = np.log(n / n.sum(axis=1, keepdims=True))
    return flat


class Network:
    """A network and the sums of squared gradients of its training, as one vector."""

    def __init__(self, flat: np.ndarray, squares: np.ndarray | None = None) -> None:
        one_thread()  # products are small, and rounding would depend on the number of threads
        self.flat, self.squares = flat, squares
        self.net = views(flat)
        self.sq = None if squares is None else views(squares)

    def scaled(self) -> np.ndarray:
        """Embeddings of the tokens at each side and distance, by distance within side."""
        return (self.net["near"][:, None] * self.net["scale"][:, :, None]).reshape(2 * AROUND, TOKENS + 1, HIDDEN)

    def layers(self) -> np.ndarray:
        """Per class the weights of the classes and, beside them, those of its tokens."""
        return np.concatenate([np.broadcast_to(self.net["kinds"], self.net["tokens"].shape), self.net["tokens"]], axis=2)

    def hidden(self, scaled: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The hidden layer and a column of ones, where ids are the neighbours as scaled() has them."""
        a = scaled[0].take(ids[0], axis=0)
        for rows, i in zip(scaled[1:], ids[1:]):
            a += rows.take(i, axis=0)
        a += self.net["hidden"]
        h = np.ones((len(a), HIDDEN + 1), a.dtype)
        h[:, :-1] = np.tanh(a, out=a)
        return h

    def log_p(self, x: np.ndarray, at: np.ndarray, learn: bool = False) -> np.ndarray:
        """log P(token | both sides) at the places `at` of the tokens x; with learn, one step of Adagrad on their sum.

        Places go by class, and PLACES of them at once, so that their layers stay in a core's cache.
        """
        order = np.argsort((x.take(at) // SIDE).astype(np.uint8), kind="stable")
        at = at.take(order)
        scaled, layers = self.scaled(), self.layers()
        # hidden units are between -1 and 1
        small = bool(np.abs(layers).sum(axis=1).max() < LIMIT)
        out = np.empty(len(at))
        if learn:
            by_layer = np.zeros_like(layers)
            da, seen = np.empty((len(at), HIDDEN), self.flat.dtype), np.empty((2 * AROUND, len(at)), np.int64)
        for i in range(0, len(at), PLACES):
            some = slice(i, i + PLACES)
            here = at[some]
            ids = np.stack([x.take(here + sign * (d + 1)) for sign in (-1, 1) for d in range(AROUND)]).astype(np.int64)
            h = self.hidden(scaled, ids)
            said = x.take(here).astype(np.int64)
            kind = said // SIDE
            starts = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
            runs = [(kind[i], slice(i, j)) for i, j in zip(starts, np.append(starts[1:], len(kind)))]
            both = np.empty((len(h), 2 * SIDE), h.dtype)
            for k, run in runs:
                np.matmul(h[run], layers[k], out=both[run])
            # a place has two rows, of classes and of tokens
            z = both.reshape(-1, SIDE)
            said = np.arange(0, z.size, SIDE) + np.stack([kind, said - kind * SIDE], axis=1).reshape(-1)
            of, total = softmax(z, said, small)
            out[order[some]] = of.reshape(-1, 2).sum(axis=1, dtype=np.float64)
            if learn:
                errors(z, total, said)
                dh = np.empty((len(h), HIDDEN), h.dtype)
                for k, run in runs:
                    np.matmul(both[run], layers[k, :-1].T, out=dh[run])
                    by_layer[k] += h[run].T @ both[run]
                np.multiply(dh, 1 - h[:, :-1] * h[:, :-1], out=da[some])
                seen[:, some] = ids
        if learn:
            self.step([("kinds", ..., by_layer[:, :, :SIDE].sum(axis=0)), ("tokens", ..., by_layer[:, :, SIDE:]), *self.below(seen, da)])
        return out

    def below(self, seen: np.ndarray, da: np.ndarray) -> list:
        """Gradients below the hidden layer, given that of its input and its neighbours as in hidden()."""
        # units are added up in pairs, as complex numbers: by pair, side, distance and token, over all places that have the token there
        pairs = np.ascontiguousarray(da.view(np.result_type(da, np.complex64)).T)
        sums = np.zeros((len(pairs), 2 * AROUND, TOKENS + 1), pairs.dtype)
        for of, pair in zip(sums, pairs):
            for by_token, ids in zip(of, seen):
                np.add.at(by_token, ids, pair)
        sums = np.ascontiguousarray(sums.transpose(1, 2, 0)).view(da.dtype).reshape(2, AROUND, TOKENS + 1, HIDDEN)
        by_scale = np.einsum("sth,sdth->sdh", self.net["near"], sums)
        sums *= self.net["scale"][:, :, None]
        return [("hidden", ..., da.sum(axis=0)), ("scale", ..., by_scale), ("near", ..., sums.sum(axis=1))]

    def step(self, steps: list) -> None:
        for name, where, g in steps:
            sq = self.sq[name][where]
            sq += g * g
            root = np.sqrt(sq)
            root += np.float32(1e-6)
            self.net[name][where] -= np.divide(STEP * g, root, out=root)


def train(docs: DataFrame, own: list[str], flat: np.ndarray, tokens: int) -> np.ndarray:
    """The network after ROUNDS rounds. In round r each task takes every ROUNDS-th of its rows from the r-th on.

    docs has texts, or what code_texts() made of them. A task sends its network in chunks, which are summed as they come in, by owners of chunks; the driver gets one
    averaged network a round. A network's size is fixed, and tasks have TASK tokens or one of the input's partitions.
    """
    spark = docs.sparkSession
    docs = docs.select("text" if "text" in docs.columns else "tokens")
    docs = docs.coalesce(max(1, min(docs.rdd.getNumPartitions(), -(-tokens // TASK))))
    state = np.concatenate([flat, np.zeros(SIZE, np.float32)])
    chunks = -(-len(state) // CHUNK)
    for r in range(ROUNDS if tokens else 0):
        sent = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch], r: int = r, sent=sent) -> Iterator[pa.RecordBatch]:
            mine = sent.value.copy()
            net, row, n_all = Network(mine[:SIZE], mine[SIZE:]), 0, 0
            for b in batches:
                mine_of = pa.array(range((r - row) % ROUNDS, b.num_rows, ROUNDS), pa.int64())
                row += b.num_rows
                for codes, n in groups(b.take(mine_of), own):
                    x, at = codes // CELLS, centres(n)
                    # rows follow each other in a text, so a step takes places from all over the group
                    at = np.random.default_rng(r).permutation(at)
                    n_all += len(at)
                    for i in range(0, len(at), BLOCK):
                        net.log_p(x, at[i : i + BLOCK], learn=True)
            if n_all:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(chunks), pa.int32()), pa.array([n_all] * chunks, pa.int64()), pa.array([mine[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(chunks)], pa.binary())],
                    names=["chunk", "n", "part"],
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            n_of: Counter[int] = Counter()
            for b in batches:
                for c, n, part in zip(*(b.column(k).to_pylist() for k in ("chunk", "n", "part"))):
                    sums[c] = sums.get(c, 0.0) + n * np.frombuffer(part, np.float32).astype(np.float64)
                    n_of[c] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(sums[c] / n_of[c]).astype(np.float32).tobytes() for c in sums], pa.binary())], names=["chunk", "part"])

        sums = docs.mapInArrow(learn, "chunk int, n long, part binary").repartition("chunk").mapInArrow(add, "chunk int, part binary")
        made = sorted(sums.collect(), key=lambda p: p["chunk"])
        if made:  # a round may have no rows with tokens where there are few
            state = np.concatenate([np.frombuffer(p["part"], np.float32) for p in made])
        sent.destroy()
    return state[:SIZE].copy()


@dataclass
class Model:
    own: list[str]
    flat: np.ndarray  # the network
    share: np.ndarray  # log P(cell | bucket) of the buckets' cells

    def score(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of log P(word | both sides) for texts coded by Coding.batch."""
        net, x, at = Network(self.flat), codes // CELLS, centres(n)
        cell = codes[at] - OWN * CELLS
        logs = np.where(cell >= 0, self.share[np.maximum(cell, 0)], 0) + net.log_p(x, at)
        ends = np.append(0.0, np.cumsum(logs))
        stops = np.cumsum(n)
        return ends[stops] - ends[stops - n]


def vocabulary(docs: DataFrame, scratch: Scratch) -> tuple[list[str], np.ndarray]:
    """The OWN most frequent words of all whole texts, and the counts of all tokens and cells."""
    words = scratch.keep(count_words(docs), "words")
    # words with like endings stand together, so that classes are of like words
    own = sorted((r["word"] for r in words.orderBy(F.desc("n"), "word").limit(OWN).collect()), key=lambda w: w[::-1])
    coding = Coding(own)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TOKENS * CELLS, np.int64)
        for b in batches:
            at = np.array([coding.code(w) for w in b.column("word").to_pylist()], np.int64)
            np.add.at(sums, at, b.column("n").to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["code", "n"])

    found = words.mapInArrow(code, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    by_code = np.zeros((TOKENS, CELLS))
    by_code.reshape(-1)[found["code"].to_numpy()] = found["n"].to_numpy()
    scratch.drop("words")
    return own, by_code


def fit_to(docs: DataFrame, own: list[str], by_code: np.ndarray) -> Model:
    """The network of what train() takes, given its vocabulary()."""
    rare = by_code[OWN:] + 1
    share = np.log(rare / rare.sum(axis=1, keepdims=True)).reshape(-1).astype(np.float32)
    return Model(own, train(docs, own, start(by_code.sum(axis=1)), int(by_code.sum())), share)


def fit(docs: DataFrame, scratch: Scratch) -> Model:
    """The network of all whole texts of docs (column text), and the counts it starts from.

    Null and blank texts have no tokens, and change nothing; repeated rows count each time. An empty table gives the network
    before training, whose tokens are alike. No other column is read. The driver sees OWN words, RARE * CELLS counts and a
    network a round, all of fixed size.
    """
    return fit_to(docs, *vocabulary(docs, scratch))


def fit_score(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """What score() gives for the texts that fit() is given. They are coded once, for all rounds and for the scores."""
    own, by_code = vocabulary(docs, scratch)
    coded = scratch.keep(code_texts(docs, own, id_col), "coded")
    return score(coded, fit_to(coded, own, by_code), id_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per row of texts, or of what code_texts() made of them: the id, n_tokens, log_likelihood (the sum over all tokens of
    the whole text), per_token.

    Null and blank texts have no tokens, a sum of 0 and a null mean. Repeated rows are scored alike; other columns are
    not read. An empty table gives no rows. The model's arrays have a fixed size, so they may be broadcast.
    """
    # plain values, as a broadcast object would need its class on the executors
    sent = docs.sparkSession.sparkContext.broadcast((model.own, model.flat, model.share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat, share = sent.value
        here = Model(own, flat, share)
        for b in batches:
            ns, sums = [], []
            for codes, n in groups(b, own):
                ns.append(n)
                sums.append(here.score(codes, n))
            n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
            s = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)], names=[id_col, "n_tokens", "log_likelihood", "per_token"])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["text"] if "text" in docs.columns else ["tokens", "cells"]
    return docs.select(id_col, *columns).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, log_likelihood double, per_token double")
