import hashlib

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import merkle
from broadsheet.llm.common import Scratch

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def level(nodes):
    return [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def brute(rows):
    """(id, leaf, subroot, root, sha of the proof) of each row by plain loops."""
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), h(*[value(r[c]) for c in COLUMNS])))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))

    def ups(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(level(out[-1]))
        return out

    inner = {s: ups([leaf for _, leaf in sorted(trees[s])]) for s in order}
    outer = ups([inner[s][-1][0] for s in order])
    found = []
    for k, s in enumerate(order):
        for i, ((known, id_), leaf) in enumerate(sorted(trees[s])):
            proof = []
            for at, levels in ((i, inner[s]), (k, outer)):
                for nodes in levels[:-1]:
                    proof += [d for j, d in enumerate(nodes) if j // 16 == at // 16 and j != at]
                    at //= 16
            found.append((id_ if known else None, leaf, inner[s][-1][0], outer[-1][0], h(*proof)))
    return sorted(map(str, found))


def got(df):
    return sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"])) for r in df.collect())


#: Levels of a block, nodes on the driver: one round, several, and sources that are too many for the driver.
SIZES = [(3, 4096), (1, 64), (1, 16), (2, 16)]


@pytest.mark.parametrize("levels,top", SIZES)
def test_like_brute_force(spark, corpus, scratch, levels, top):
    rows = corpus.select(*COLUMNS).union(corpus.select((F.col("doc_id") + 1000).alias("doc_id"), F.lit("hot"), "lang", "n_chars", "text")).union(corpus.select((F.col("doc_id") + 5000).alias("doc_id"), F.concat(F.lit("own"), "doc_id"), "lang", "n_chars", "text"))
    rows = rows.union(rows.where("source = 'hot'").withColumn("doc_id", F.col("doc_id") + 10_000))
    out = merkle.manifest(rows, scratch, COLUMNS, levels=levels, top=top)
    assert got(out) == brute(rows.collect())
    assert out.where("not verified or folded_root != root").count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 273])
def test_last_runs(spark, scratch, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("é").alias("text"))
    assert got(merkle.manifest(rows, scratch, COLUMNS, levels=1, top=16)) == brute(rows.collect())


def test_odd_rows_and_tampering(spark, odd, nothing, scratch):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(odd, scratch, COLUMNS, tampered={"text": F.upper("text")}, when=hit, proofs=True)
    assert got(out) == brute(odd.collect())
    for r in out.collect():
        changed = odd.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"])) & F.coalesce(hit, F.lit(False)) & (F.upper("text") != F.col("text"))).count() > 0
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
        assert h(r["proof"]) == r["proof_sha256"]
    assert merkle.manifest(nothing, Scratch(spark, "none"), COLUMNS).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(odd, scratch, COLUMNS, top=1)
