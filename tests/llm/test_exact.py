import hashlib
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import exact
from broadsheet.llm.common import Scratch


def brute(rows):
    groups = {}
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups.setdefault(n, []).append(i)
    out = []
    for n, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, first, len(ids), stays and i == first, hashlib.sha256(n.encode()).hexdigest()))
            stays = stays and i != first
    return sorted(map(str, out))


def ran(df, scratch, **more):
    return sorted(str(tuple(r)) for r in exact.dedup(df, scratch, **more).collect())


def weak(text):
    """A hash with many collisions."""
    return F.pmod(F.length(text), F.lit(5)).cast("long")


@pytest.mark.parametrize("how", ["strong", "weak"])
def test_like_brute_force(spark, odd, nothing, corpus, how):
    more = {} if how == "strong" else {"hash_of": lambda c: weak(F.col(c) if isinstance(c, str) else c)}
    frames = [odd, corpus.limit(40) if how == "weak" else corpus]
    for k, df in enumerate(frames):
        df = df.select("doc_id", "text", *[c for c in df.columns if c not in ("doc_id", "text")])
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        fixed = spark.createDataFrame(rows, "doc_id long, text string")
        assert ran(fixed if how == "weak" else df, Scratch(spark, f"x{k}"), **more) == brute(rows)
    assert ran(nothing, Scratch(spark, "none")) == []


def test_beyond_the_broadcast_bounds(spark, corpus, monkeypatch):
    for name in ("BROADCAST_KEYS", "BROADCAST_ENTRIES", "MIN_DEPTH"):
        monkeypatch.setattr(exact, name, 1)
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()] + [(None, "a"), (None, "b"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ran(df, Scratch(spark, "wide"), bucket_keys=5) == brute(rows)


def test_directory_doubles_where_it_is_full(spark):
    keys = spark.range(1 << 12).select((F.col("id") * (1 << 40)).alias("hash"))  # all in the lowest prefixes
    entries = exact.directory(keys, bucket_keys=600, max_depth=14)
    depth = len(entries).bit_length() - 1
    assert len(entries) == 1 << depth and depth == 14 and {d for _, d in entries} == {*range(1, 13), 14}
    for i, (p, d) in enumerate(entries):
        assert i >> (depth - d) == p
    assert exact.directory(keys, bucket_keys=10_000, max_depth=14) == [(0, 0)]
    same = spark.range(1).select(F.lit(5).cast("long").alias("hash"))
    assert exact.directory(same, bucket_keys=1, max_depth=14) == [(0, 0)]


def test_tasks_split_full_entries_like_the_driver(spark, monkeypatch):
    monkeypatch.setattr(exact, "MIN_DEPTH", 3)
    crowd = spark.range(4000).select((F.xxhash64("id").bitwiseAND((1 << 55) - 1)).alias("hash"))  # all under few prefixes
    keys = crowd.union(spark.range(4000).select(F.xxhash64("id").alias("hash"))).distinct()
    n, size = keys.count(), 150
    depth = max(3, (n // size).bit_length() + exact.SPARE_DEPTH)
    entries = exact.directory(keys, size, depth)
    spread = len(entries).bit_length() - 1
    want = {h: (p << (depth - d)) for h in (r["hash"] for r in keys.collect()) for p, d in [entries[(h % (1 << 64)) >> (64 - spread)]]}
    for few in (1 << 18, 1):  # cells by broadcast, and by a shuffle
        monkeypatch.setattr(exact, "BROADCAST_ENTRIES", few)
        assert {r["hash"]: r["bucket"] for r in exact.owned(keys, n, size).collect()} == want
