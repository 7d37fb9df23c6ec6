"""Suffix-array dedup: bytes of passages that start earlier too, by two-stage suffix sorting of what may repeat.

A string of `length` bytes has an anchor: the smallest hash of the GRAM-byte strings in it, the leftmost of equal ones. Equal
strings have equal anchors at the same place, so only strings whose anchors occur more than once are sorted, and those
with the same anchor meet in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_keys, parts_of

#: Bytes of a gram, or half of the length if that is less; the longer, the fewer chance repeats and the more anchors.
GRAM = 40
#: Bytes looked at together, at most unless one document is longer.
BLOCK = 2_000_000
#: Buckets of anchors: so many, or so many for each partition if that is more; an owner has whole ones.
OWNED, OWNED_EACH = 2048, 8
#: The lower bits of a hash make room for a place while anchors are looked for.
PLACES = (1 << 32) - 1
#: Marks (24 bytes each) that a join may broadcast; more are joined by a shuffle.
BROADCAST_MARKS = 1_000_000
#: Bytes of removed runs that a join may broadcast.
BROADCAST_BYTES = 32_000_000
#: Never a byte of UTF-8 text, so it parts segments.
BORDER = 0xFF

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the grams at all starts, built by doubling."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    table = (np.arange(1, 257, dtype=np.uint64) * _M[0]) ^ ((np.arange(1, 257, dtype=np.uint64) * _M[1]) >> np.uint64(29))
    power, size, out, done = table[data], 1, None, 0
    left, step = gram, 0
    while left:
        if left & size:
            # the parts that add up to gram, smallest first
            part = power[done : done + n]
            out = part.copy() if out is None else out * _M[5] + part
            done += size
            left &= ~size
        if left:
            power = power[:-size] * _M[1 + step % 4] + power[size:]
            size, step = size * 2, step + 1
    out ^= out >> np.uint64(32)
    out *= _M[4]
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, first start, starts - 1) of each anchor: runs of starts in a document whose strings have it."""
    none = np.zeros(0, np.int64)
    gram = gram or min(GRAM, max(1, length // 2))
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    window = length - gram + 1
    low = np.uint64(PLACES)  # the same for all blocks, so that equal strings have equal anchors in any
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < window:
        v = np.minimum(v[: len(v) - (window - size)], v[window - size :])
    at = (v & low).astype(np.int64)  # of the anchor, for each start of a string
    ok = np.zeros(len(at) + 1, np.int32)
    long = sizes >= length
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, starts[long] + sizes[long] - length + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    s = np.flatnonzero(ok)
    if not len(s):
        return none.astype(np.uint64), none, none, none
    a = at[s]
    doc = np.searchsorted(starts, s, "right") - 1
    new = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1) | (np.diff(doc, prepend=-1) != 0))
    n = np.diff(np.append(new, len(s)))
    return h[a[new]], doc[new], s[new] - starts[doc[new]], n - 1


def blocks(sizes: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    first, n = 0, 0
    for i, x in enumerate(sizes):
        n += int(x)
        if n >= limit:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the offsets of each; null texts have none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


MARK = "id long, key long, first int, more int"


def marks_of(id_: np.ndarray, key: np.ndarray, first: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(id_, pa.int64()), pa.array(key.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(more.astype(np.int32))], names=["id", "key", "first", "more"])


def find_marks(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """id, key, first, more: the anchors that occur more than once, each at all of its places.

    A task sends an owner each key; one that occurs twice in its own batch is sent once and without places, as these are
    marked already. So a very common key has a row for each batch.
    """

    owned = max(OWNED, OWNED_EACH * parts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            data, offset = bytes_of(b.column("text"))
            sizes = np.diff(offset)
            got = []
            for x, y in blocks(sizes):
                part = data[offset[x] : offset[y]]
                key, doc, first, more = anchors(part, offset[x:y] - offset[x], sizes[x:y], length)
                got.append((key, doc + x, first.astype(np.int32), more.astype(np.int32)))
            if not got:
                continue
            key, doc, first, more = (np.concatenate(z) for z in zip(*got))
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(key)))
            twice = np.zeros(len(key), bool)
            twice[order] = np.repeat(n > 1, n)
            known = np.flatnonzero(twice)
            rest = np.setdiff1d(order[new], known, assume_unique=True)
            common = sorted_[new[n > 1]]
            bucket = (key[rest] % np.uint64(owned)).astype(np.int64)
            by = np.lexsort((rest, bucket))
            rest, bucket = rest[by], bucket[by]
            shared = (common % np.uint64(owned)).astype(np.int64)
            by = np.argsort(shared, kind="stable")
            common, shared = common[by], shared[by]
            rows = []
            for k in np.unique(np.concatenate([bucket, shared])):
                r = rest[np.searchsorted(bucket, k) : np.searchsorted(bucket, k, "right")]
                c = common[np.searchsorted(shared, k) : np.searchsorted(shared, k, "right")]
                d = ids[doc[r]]
                cut = np.flatnonzero(np.diff(doc[r], prepend=-1))
                rows.append((int(k), key[r].tobytes() + c.tobytes(), d[cut].astype("<i8").tobytes(), np.diff(np.append(cut, len(r))).astype("<i4").tobytes(), first[r].astype("<i4").tobytes(), more[r].astype("<i4").tobytes()))
            # places that are known already travel as they are
            for at in range(0, len(known), 20_000):
                r = known[at : at + 20_000]
                rows.append((-1 - int(at // 20_000 % owned), key[r].tobytes(), ids[doc[r]].astype("<i8").tobytes(), b"", first[r].astype("<i4").tobytes(), more[r].astype("<i4").tobytes()))
            names = ["bucket", "keys", "ids", "times", "first", "more"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if not i else pa.binary()) for i in range(6)], names=names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, firsts, mores = [], [], [], []
        for b in batches:
            for bucket, k, i, t, f, m in zip(*(b.column(j).to_pylist() for j in range(6))):
                k, i, f, m = np.frombuffer(k, np.uint64), np.frombuffer(i, "<i8"), np.frombuffer(f, "<i4"), np.frombuffer(m, "<i4")
                if bucket < 0:
                    yield marks_of(i, k, f, m)
                    continue
                keys.append(k)
                rest = np.full(len(k) - len(f), -1, np.int32)
                ids.append(np.append(np.repeat(i, np.frombuffer(t, "<i4")), np.zeros(len(rest), np.int64)))
                firsts.append(np.append(f, rest))
                mores.append(np.append(m, np.zeros(len(rest), np.int32)))
        if keys:
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = key[1:] == key[:-1]
            twice = np.append(same, False) | np.append(False, same)
            first = np.concatenate(firsts)[order]
            good = twice & (first >= 0)
            yield marks_of(np.concatenate(ids)[order][good], key[good], first[good], np.concatenate(mores)[order][good])

    sent = docs.mapInArrow(look, "bucket int, keys binary, ids binary, times binary, first binary, more binary")
    return sent.repartition(parts, "bucket").mapInArrow(own, MARK)


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of text, right to a depth of `depth` bytes; equal to that depth come in any order.

    Suffixes smaller than their successors are sorted directly. The others follow by scans of the buckets of first
    bytes: a suffix in its place puts the one before it, if that is larger, at the next place of its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    # the place where the run of equal bytes from i on ends says whether i is smaller than i + 1
    nxt = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, bool)
    inside = nxt < len(change)
    j = change[nxt[inside]]
    small[inside] = text[j] < text[j + 1]
    direct = np.flatnonzero(small)
    padded = np.append(text, np.zeros(depth, np.uint8))
    keys = np.ascontiguousarray(sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    edge = np.searchsorted(text[direct], np.arange(257))
    later: list[list[np.ndarray]] = [[] for _ in range(256)]
    later[text[-1]].append(np.array([n - 1]))
    out = []

    def put(order: np.ndarray, own: int) -> np.ndarray:
        """Deals out the larger suffixes before those in order; the ones of the bucket itself come back."""
        before = order[order > 0] - 1
        before = before[~small[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        for c in np.unique(first):
            if c != own:
                later[c].append(before[np.searchsorted(first, c) : np.searchsorted(first, c, "right")])
        return before[first == own]

    for c in range(256):
        front = np.concatenate(later[c]) if later[c] else np.zeros(0, np.int64)
        while len(front):
            out.append(front)
            front = put(front, c)
        own = direct[edge[c] : edge[c + 1]]
        if len(own):
            out.append(own)
            put(own, c)
    return np.concatenate(out)


def later_starts(parts: list[bytes], ids: np.ndarray, first: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(id, from, to) of the bytes in strings that start earlier in another part or place. Parts overlap only in equal places."""
    size = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(bytes([BORDER]).join(parts), np.uint8)
    at = np.cumsum(size + 1) - (size + 1)
    order = two_stage(text, length)
    part = np.searchsorted(at, order, "right") - 1
    inner = order - at[part]
    keep = inner <= size[part] - length
    order, part, inner = order[keep], part[keep], inner[keep]
    if not len(order):
        return []
    view = sliding_window_view(text, length)
    # common prefixes of neighbours: the whole length or not
    joined = np.zeros(len(order), bool)
    for x in range(1, len(order), 200_000):
        y = min(len(order), x + 200_000)
        joined[x:y] = (view[order[x:y]] == view[order[x - 1 : y - 1]]).all(axis=1)
    group = np.cumsum(~joined) - 1
    i, s = ids[part], first[part] + inner
    by = np.lexsort((s, i, group))
    lead = np.flatnonzero(np.diff(group[by], prepend=-1))
    n = np.diff(np.append(lead, len(by)))
    i0, s0 = np.repeat(i[by][lead], n), np.repeat(s[by][lead], n)
    dup = by[(i[by] != i0) | (s[by] != s0)]
    if not len(dup):  # segments with a key in common need not have a string in common
        return []
    i, s = i[dup], s[dup]
    by = np.lexsort((s, i))
    i, s = i[by], s[by]
    new = np.flatnonzero((np.diff(i, prepend=~i[:1]) != 0) | (np.diff(s, prepend=s[:1]) > 1))
    end = np.append(new[1:], len(i)) - 1
    return list(zip(i[new].tolist(), s[new].tolist(), (s[end] + length).tolist()))


def repeats(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """id, lo, hi: bytes covered by strings of `length` bytes that start earlier; ranges may overlap.

    docs: id, text, no two with the same id, and no two with the same text unless shorter than length.
    """
    parts = parts_of(docs.sparkSession)
    marks = scratch.keep(find_marks(docs, length, parts), "marks")
    by_doc = marks.groupBy("id").agg(F.collect_list(F.struct("key", "first", "more")).alias("marks"))
    if marks.count() <= BROADCAST_MARKS:
        by_doc = F.broadcast(by_doc)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by key; one that its batch has earlier is done: all of its strings start earlier."""
        for b in batches:
            data, offset = bytes_of(b.column("text"))
            flat = b.column("marks").flatten()
            key, first, more = (flat.field(j).to_numpy() for j in range(3))
            doc = np.repeat(np.arange(len(b)), np.diff(b.column("marks").offsets.to_numpy()))
            ids = b.column("id").to_numpy()[doc]
            lo = offset[doc] + first
            whole = data.tobytes()
            seen: dict[tuple, int] = {}
            done = []
            for r in np.lexsort((first, ids)).tolist():
                x = lo[r]
                piece = whole[x : x + more[r] + length]
                if (key[r], piece) in seen:
                    done.append(r)
                else:
                    seen[key[r], piece] = r
            rows = np.fromiter(seen.values(), np.int64, len(seen))
            pieces = [p for _, p in seen]
            r = np.append(rows, done).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[r]), pa.array(key[r]), pa.array(first[r], pa.int32()), pa.array((first + more + length)[r], pa.int32()), pa.array([*pieces, *[None] * len(done)], pa.binary())], names=["id", "key", "lo", "hi", "piece"]
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: equal segments first, then the strings of those that differ but have the key of another."""
        found: dict[tuple[int, bytes], tuple[int, int]] = {}
        out: list[tuple[int, int, int]] = []
        for b in batches:
            for i, k, lo, hi, p in zip(*(b.column(j).to_pylist() for j in range(5))):
                if p is None:
                    out.append((i, lo, hi))
                    continue
                at = found.get((k, p))
                if at is None or (i, lo) < at:
                    found[k, p] = (i, lo)
                    if at is not None:
                        out.append((*at, at[1] + len(p)))
                elif (i, lo) != at:
                    out.append((i, lo, lo + len(p)))
        by_key: dict[int, list[bytes]] = {}
        for k, p in found:
            by_key.setdefault(k, []).append(p)
        todo, n = [], 0
        several = [k for k, v in by_key.items() if len(v) > 1]
        for j, k in enumerate(several):
            todo += [(p, *found[k, p]) for p in by_key[k]]
            n += sum(map(len, by_key[k]))
            if n >= 4 * BLOCK or j == len(several) - 1:
                out += later_starts([x[0] for x in todo], np.array([x[1] for x in todo], np.int64), np.array([x[2] for x in todo], np.int64), length)
                todo, n = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["id", "lo", "hi"])

    segments = docs.join(by_doc, "id").mapInArrow(cut, "id long, key long, lo int, hi int, piece binary")
    # segments that are done go anywhere; the others to the owner of their key
    owner = F.when(F.col("piece").isNull(), F.xxhash64("id")).otherwise(F.col("key"))
    segments = segments.withColumn("owner", F.pmod(owner, F.lit(max(OWNED, OWNED_EACH * parts)))).repartition(parts, "owner")
    return segments.drop("owner").mapInArrow(settle, "id long, lo int, hi int")


def merged(found: DataFrame) -> DataFrame:
    """id, lo, hi (array<int>): the maximal runs of a document's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("x").flatten()
            lo, hi = (flat.field(j).to_numpy().astype(np.int64) for j in (0, 1))
            doc = np.repeat(np.arange(len(b), dtype=np.int64), np.diff(b.column("x").offsets.to_numpy()))
            order = np.lexsort((lo, doc))
            # one line of numbers for all documents
            base = doc[order] << 32
            lo, hi = lo[order] + base, np.maximum.accumulate(hi[order] + base)
            new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(lo) else np.zeros(0, np.int64)
            end = np.append(new[1:], len(lo)) - 1
            at = pa.array(np.searchsorted(base[new], np.arange(len(b) + 1, dtype=np.int64) << 32).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(((x[y] - base[new])).astype(np.int32))) for x, y in ((lo, new), (hi, end))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *lists], names=["id", "lo", "hi"])

    by_id = found.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("x"))
    return by_id.mapInArrow(run, "id long, lo array<int>, hi array<int>")


def cut_out(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, lo and hi (array<int>: the maximal removed runs of bytes), kept (binary: the other bytes joined).

    A byte goes if a string of `length` bytes over it also starts earlier: in a document with a smaller doc_id, or
    earlier in the same one; strings are judged on the input. Null texts count as empty, null ids as the smallest. Rows with the same id
    and text are one document; rows with the same id and other text have the same ranges taken. Texts shorter
    than length stay whole. Other columns are not read. An empty table gives no rows.

    length: from 2 on. Copies of a whole text are told by its hash and one with the smallest id is looked at; the others are removed
    whole if they are long enough.
    """
    if length < 2:
        raise ValueError("strings have at least two bytes")
    text = F.coalesce("text", F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id")
    sha = F.sha2(text.cast("binary"), 256)
    hash_ = F.xxhash64(text).alias("h")  # tells texts of the same id apart
    base = scratch.keep(docs.select(id_, hash_, F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha")), "base")
    firsts = base.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.keep(base.join(firsts, "sha").where("id != first").select("id", "h", "n_bytes").distinct(), "copies")
    rows = docs.select(id_, hash_, text.alias("text"))
    own = by_keys(rows, copies, ["id", "h"], "left_anti").where(F.octet_length("text") >= length)
    again = scratch.keep(base.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h"), "again")
    if not again.isEmpty():
        once = by_keys(own, again, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
        own = by_keys(own, again, ["id", "h"], "left_anti").unionByName(once)
    found = scratch.keep(repeats(own.drop("h"), scratch, length), "found")
    whole = copies.where(F.col("n_bytes") >= length).groupBy("id").agg(F.collect_set("h").alias("whole"))
    cuts = scratch.keep(merged(found).join(whole, "id", "full"), "cuts")
    scratch.drop("base", "copies", "again", "marks", "found")
    size = cuts.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("lo"), F.lit(0))).alias("runs")).first()
    few = 80 * size["n"] + 8 * (size["runs"] or 0) <= BROADCAST_BYTES
    touched = rows.join(F.broadcast(cuts) if few else cuts, "id", "left")
    # a whole copy is one run; only the others are looked at for runs inside
    gone = F.coalesce(F.array_contains("whole", F.col("h")), F.lit(False))
    n = F.octet_length("text").cast("int")
    touched = touched.select("id", "text", F.when(gone, F.array(F.lit(0))).otherwise(F.col("lo")).alias("lo"), F.when(gone, F.array(n)).otherwise(F.col("hi")).alias("hi"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offset = bytes_of(b.column("text"))
            whole, lo, hi, kept = data.tobytes(), [], [], []
            for i, (los, his) in enumerate(zip(b.column("lo").to_pylist(), b.column("hi").to_pylist())):
                raw = whole[offset[i] : offset[i + 1]]
                # a row with the same id and a shorter text has fewer bytes to lose
                runs = [(x, min(y, len(raw))) for x, y in zip(los or [], his or []) if x < len(raw)]
                kept.append(b"".join([raw[x:y] for x, y in zip([0, *[y for _, y in runs]], [*[x for x, _ in runs], len(raw)])]))
                lo.append([x for x, _ in runs])
                hi.append([y for _, y in runs])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offset)), *[pa.array(x, pa.list_(pa.int32())) for x in (lo, hi)], pa.array(kept, pa.binary())], names=["id", "n_bytes", "lo", "hi", "kept"])

    out = touched.mapInArrow(take, "id long, n_bytes long, lo array<int>, hi array<int>, kept binary")
    return out.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "lo", "hi", "kept")


def digests(cut: DataFrame) -> DataFrame:
    """Per row of cut_out(): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return cut.select("doc_id", "n_bytes", removed, F.size("lo").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def dedup(docs: DataFrame, scratch: Scratch, length: int = 100) -> DataFrame:
    """The digests of what cut_out() gives."""
    return digests(cut_out(docs, scratch, length))
