"""Best-fit packing in bulk-synchronous rounds over sorted runs of documents and gaps."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, coder, small_groups
from .common import Scratch, running

# The word pattern of the byte-level vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 2


class Encoder:
    """Ids of a byte-level vocabulary file without special tokens added; the file's own added tokens in a text count."""

    def __init__(self, spec: str) -> None:
        import tiktoken

        parsed = json.loads(spec)
        back = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in added}
        self.inner = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = set(added)

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.inner.encode(text, allowed_special="all"), np.uint32)
        return self.inner.encode_to_numpy(text, disallowed_special=())


def tokenized(docs: DataFrame, spec: Broadcast, capacity: int) -> DataFrame:
    """Per row: doc_id, head (length of the first piece, from 1 to capacity), full (pieces of capacity after it), ids of all pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = coder(spec, Encoder)
        for b in batches:
            at = 0
            for texts in small_groups(b.column("text").to_pylist()):
                ids = [np.append(packer.ids(t), np.uint32(END_ID)).astype(np.int32) for t in texts]
                n = np.array([len(x) for x in ids], np.int64)
                ends = pa.array(np.cumsum(np.append(0, n)).astype(np.int32))
                head = (n - 1) % capacity + 1
                arrays = [b.column("doc_id").slice(at, len(texts)), pa.array(head.astype(np.int32)), pa.array(((n - head) // capacity).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "head", "full", "ids"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, head int, full int, ids array<int>")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places counts[length] documents of each length; (length, first rank, first sequence, offset) of runs, and the sequences used.

    Documents and gaps are sorted by length, and stand as runs of equal ones: there are no more runs of documents than
    lengths, so nothing here grows with their number. In each round the longest run of documents left sweeps to its
    successor, the smallest gap that takes it. Its documents, by rank, get one gap each, as many as there are; the
    gaps shrink and are sorted in again, and the rest of the run goes to the next round. A run without any successor
    opens new sequences. So each document gets the smallest gap that takes it at its turn.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed, used = [], 0
    order: list[int] = []  # sizes of gaps that there are, ascending
    def add(gap: int, first: int, n: int) -> None:
        if gap <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        runs = gaps[gap]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + n)
        else:
            runs.append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                n = -(-left // (capacity // length))
                placed.append((length, rank, used, 0))
                rank, left = rank + n, left - n
                add(capacity - length, used, n)
                used += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop(0)
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            m = min(n, left)
            placed.append((length, rank, first, capacity - gap))
            rank, left = rank + m, left - m
            if m < n:
                if gap not in gaps:
                    gaps[gap] = []
                    insort(order, gap)
                gaps[gap].insert(0, (first + m, n - m))
            add(gap - length, first, m)
    return placed, used


def pack(docs: DataFrame, scratch: Scratch, path: str, capacity: int = 1024) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (of ids as 32-bit little-endian integers), sequence_id, offset, ids array<int>.

    docs: doc_id, text; other columns are not read. A document is the ids of its whole text (null: empty), then END_ID,
    by the tokenizer file at path on the driver. Longer ones than capacity are cut so that the first piece may be
    shorter. Pieces of full length are sequences of their own; the first pieces are packed best-fit, the longest
    first, ties by doc_id. Sequences are numbered from 0, those of full pieces last. Repeated rows are documents of
    their own. An empty table gives no rows.

    Tokens are written once; only lengths are sorted, and the places found meet the tokens by a number of the row. The
    driver sees the counts of the lengths, capacity numbers at most; where documents go follows from a run's place and
    their rank in the sorted order, which is a running total.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())
    made = scratch.keep(tokenized(docs, spec, capacity).withColumn("nr", F.monotonically_increasing_id()), "tokens")
    counts = {r["head"]: r["n"] for r in made.groupBy("head").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return made.select("doc_id", F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")], "ids")
    runs, used = best_fit(counts, capacity)
    before, at = {}, 0
    for length in sorted(counts):
        before[length] = at
        at += counts[length]
    runs.sort()
    table = np.array(runs, np.int64)
    # rank in the sorted order, over all lengths, at which each run starts
    table[:, 1] += np.array([before[x] for x in table[:, 0]])
    table = table[np.argsort(table[:, 1])]
    ranked = running(made.select("head", "full", "doc_id", "nr"), ["head", "doc_id", "nr"], {"row": F.lit(1).cast("long"), "fulls": F.col("full").cast("long")}, scratch, "ranked")
    places = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = places.value
        for b in batches:
            head, full, row, fulls = (b.column(c).to_numpy() for c in ("head", "full", "row", "fulls"))
            row = row - 1
            i = np.searchsorted(t[:, 1], row, "right") - 1
            n = full + 1
            of = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            first = piece == 0
            start = np.where(first, 0, head[of] + (piece - 1) * capacity)
            size = np.where(first, head[of], capacity)
            seq = np.where(first, (t[i, 2] + row - t[i, 1])[of], used + (fulls - full)[of] + piece - 1)
            # the pieces of all rows, one after another, are the tokens of all rows
            flat, ends = b.column("ids").flatten(), np.append(0, np.cumsum(size))
            raw = flat.to_numpy().astype("<i4", copy=False)
            crc = pa.array([zlib.crc32(raw[x:y]) for x, y in zip(ends, ends[1:])], pa.int64())
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), crc, pa.array(seq, pa.int64()), pa.array(np.where(first, t[i, 3][of], 0), pa.int64()), ids],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"],
            )

    found = made.select("nr", "ids").join(ranked.hint("shuffle_hash"), "nr")
    return found.select("doc_id", "head", "full", "row", "fulls", "ids").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>")
