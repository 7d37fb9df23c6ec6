import zlib
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import shard


def best(sizes, shards):
    def fits(cap):
        n, at = 1, 0
        for x in sizes:
            if x > cap:
                return False
            if at + x > cap:
                n, at = n + 1, 0
            at += x
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("points", [40, 200, 32_768])
@pytest.mark.parametrize("sizes", [[1], [5, 1, 1, 1], [(i * 7919) % 97 + 1 for i in range(500)], [3] * 50 + [900] + [2] * 80])
def test_smallest_capacity(spark, sizes, points):
    ends = spark.createDataFrame([(x,) for x in accumulate(sizes)], "end long")
    cuts = shard.cut_points(ends, 16, points)
    assert cuts[-1] == sum(sizes) and len(cuts) <= 16
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == best(sizes, 16)


def test_operator(odd, nothing, scratch):
    text = F.coalesce("text", F.lit(""))
    rows = shard.shard(odd, F.octet_length(text) + 1, text, "doc_id", scratch, 4).collect()
    assert len(rows) == odd.count()
    by_text, slots = {}, {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["row"] == 1 and r["key"] == "x"
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard.shard(nothing, F.lit(1), F.col("text"), "doc_id", scratch).count() == 0


def test_query(spark):
    from broadsheet.llm.queries import QUERIES

    rows = QUERIES["op3_minimax_shards"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    groups = {}
    for i, t in sorted(docs.items()):
        groups.setdefault(t, []).append(len(t.encode()) + 1)
    total = {}
    for r in rows:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert max(total.values()) == best([sum(x) for x in groups.values()], 16)
