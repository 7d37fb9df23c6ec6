"""A Merkle manifest of a table: a digest for each row, a tree for each source, and proofs that are folded for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts_of

#: Nodes of a run.
FAN = 16
#: Levels that are reduced within one task: a block has FAN ** LEVELS nodes.
LEVELS = 3
#: Nodes that may meet on the driver, and so the bound of what is broadcast (about 2 kB a node at most).
TOP = 4096

#: A run that a node is in: its place there, and the run's digests.
Step = tuple[int, tuple[str, ...]]


def h(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(digests: list[str], levels: int | None = None) -> tuple[list[str], list[list[tuple[str, ...]]]]:
    """What is left of nodes after some levels, or (None) when one node remains; and the runs of each level."""
    runs = []
    while len(digests) > 1 if levels is None else len(runs) < levels:
        runs.append([tuple(digests[i : i + FAN]) for i in range(0, len(digests), FAN)])
        digests = [h(r) for r in runs[-1]]
    return digests, runs


def steps(at: int, runs: list[list[tuple[str, ...]]]) -> Iterator[Step]:
    for level in runs:
        yield at % FAN, level[at // FAN]
        at //= FAN


def siblings(path: Iterable[Step]) -> str:
    return "".join(d for i, run in path for d in (*run[:i], *run[i + 1 :]))


def fold(leaf: str, path: Iterable[Step]) -> str:
    """The root that a leaf and its siblings lead to."""
    for i, run in path:
        leaf = h((*run[:i], leaf, *run[i + 1 :]))
    return leaf


def depth_of(n: int) -> int:
    d, reach = 0, 1
    while reach < n:
        d, reach = d + 1, reach * FAN
    return d


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: of each value its bytes in UTF-8, counted, or - where it is null."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def placed(df: DataFrame, tree: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """df with pos, a row's place in its tree from 0, and n, the tree's rows. No task or window has all rows of a large tree.

    Rows are dealt out by ranges and counted in their range and tree; what comes before is the sum over earlier ranges.
    """
    ranged = df.repartitionByRange(parts_of(df.sparkSession), tree, *order).sortWithinPartitions(tree, *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), -1
        for b in batches:
            place = []
            for t in b.column(tree).to_pylist():
                at = at + 1 if t == last else 0
                last = t
                place.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=[*b.schema.names, "place_"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ranged = ranged.mapInArrow(number, f"{fields}, place_ long").withColumn("range_", F.spark_partition_id())
    ranged = scratch.keep(ranged, name)
    counts = ranged.groupBy(tree, "range_").agg(F.count("*").alias("count_"))
    starts = scratch.keep(before_and_all(counts, tree), f"{name}-starts")
    out = ranged.join(starts, [tree, "range_"])
    return out.select(*df.columns, (F.col("place_") + F.col("before_")).alias("pos"), "n")


def before_and_all(counts: DataFrame, tree: str) -> DataFrame:
    """Of rows by tree and range: the rows of the tree in earlier ranges, and in all. A tree has a row for each range that it is in."""
    own = Window.partitionBy(tree)
    earlier = own.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(tree, "range_", F.coalesce(F.sum("count_").over(earlier), F.lit(0)).alias("before_"), F.sum("count_").over(own).alias("n"))


NODE = "tree string, pos long, n long, digest string"


def reduce_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes that are `levels` higher, or the top of a tree that ends before; one task has the nodes of whole blocks."""
    block = FAN**levels

    def up(key: tuple, t: pa.Table) -> pa.Table:
        tree, at = key[0].as_py(), key[1].as_py()
        rows = sorted(zip(t.column("pos").to_pylist(), t.column("digest").to_pylist()))
        n = t.column("n")[0].as_py()
        (top,), _ = climb([d for _, d in rows], min(levels, depth_of(n)))
        return pa.table({"tree": pa.array([tree], pa.string()), "pos": pa.array([at], pa.int64()), "n": pa.array([-(-n // block)], pa.int64()), "digest": [top]})

    by = nodes.select("tree", "pos", "n", "digest").withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    return by.groupBy("tree", "block").applyInArrow(up, NODE)


def top_paths(nodes: list[tuple[str, int, str]]) -> tuple[dict[tuple[str, int], tuple[str, tuple[Step, ...]]], str]:
    """(subroot, path to the root) of each of the remaining nodes, and the root. Paths share the runs that they have in common."""
    trees: dict[str, list[str]] = {}
    for tree, _, digest in sorted(nodes):
        trees.setdefault(tree, []).append(digest)
    inner = {tree: climb(d) for tree, d in trees.items()}
    order = sorted(trees, key=lambda t: t.encode("utf-8"))
    (root,), outer = climb([inner[t][0][0] for t in order])
    found = {}
    for k, t in enumerate(order):
        above = tuple(steps(k, outer))
        for i in range(len(trees[t])):
            found[t, i] = inner[t][0][0], (*steps(i, inner[t][1]), *above)
    return found, root


PATHS = "tree string, pos long, subroot string, at array<int>, run array<array<string>>"


def finish(rows: DataFrame, levels: int, paths: DataFrame | None, top, root: str | None, give: Callable, schema: str) -> DataFrame:
    """give(table, (place, subroot, path) of each row) for each block of rows, with paths of blocks from a broadcast or a table."""
    block = FAN**levels

    def own(t: pa.Table, subroot: str, above: tuple[Step, ...]) -> pa.Table:
        t = t.sort_by("pos")
        n = t.column("n")[0].as_py()
        _, runs = climb(t.column("digest").to_pylist(), min(levels, depth_of(n)))
        first = t.column("pos")[0].as_py()
        return give(t, [(subroot, (*steps(p - first, runs), *above)) for p in t.column("pos").to_pylist()])

    by = rows.withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    if paths is None:
        return by.groupBy("tree", "block").applyInArrow(lambda key, t: own(t, *top.value[key[0].as_py(), key[1].as_py()]), schema)

    def both(t: pa.Table, p: pa.Table) -> pa.Table:
        return own(t, p.column("subroot")[0].as_py(), read_path(p, 0))

    return by.groupBy("tree", "block").cogroup(paths.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(both, schema)


def read_path(t: pa.Table, i: int) -> tuple[Step, ...]:
    return tuple((a, tuple(r)) for a, r in zip(t.column("at")[i].as_py(), t.column("run")[i].as_py()))


def give_paths(t: pa.Table, found: list[tuple[str, tuple[Step, ...]]]) -> pa.Table:
    """Paths of nodes between the leaves and the driver's top tree."""
    return pa.table(
        {
            "tree": t.column("tree"), "pos": t.column("pos"), "subroot": pa.array([s for s, _ in found], pa.string()),
            "at": pa.array([[i for i, _ in p] for _, p in found], pa.list_(pa.int32())), "run": pa.array([[list(r) for _, r in p] for _, p in found], pa.list_(pa.list_(pa.string()))),
        }
    )


def manifest(
    docs: DataFrame, scratch: Scratch, columns: list[str], id_col: str = "doc_id", source_col: str = "source", tampered: dict[str, Column] | None = None, when: Column | None = None, proofs: bool = False, levels: int = LEVELS, top: int = TOP
) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root and verified; with proofs, proof too: the siblings from the leaf on.

    A leaf is the digest of the row's columns. The leaves of a source, by id (null ids first; rows with an id in common by
    leaf), are joined in runs of FAN until one is left, the source's subroot; the subroots, by source (null first), are
    joined in the same way. The fold starts at the leaf that the row has with its columns replaced as `tampered` says
    where `when` is true, else at its own.

    1. Leaves get their places by ranges. Blocks of FAN ** levels leaves are reduced where they are, and their tops again,
       until at most `top` nodes are left; if there are more sources than that, their subroots are reduced in the same way.
    2. The driver builds the tree above, whose size has this bound, and broadcasts the paths from its nodes to the root.
    3. Each block finishes the proofs of its rows and folds each of them to the root.

    Rows that repeat are leaves of their own. An empty table gives no rows. Columns that aren't named aren't read. The
    reserved names that a column of another table may have don't matter, as only leaves and ids go on.
    """
    spark = docs.sparkSession
    if top < FAN or levels < 1:
        raise ValueError("top has to hold a run, and a block a level")
    own = leaf_of([F.col(c) for c in columns])
    other = leaf_of([(tampered or {}).get(c, F.col(c)) for c in columns])
    false = F.lit(False)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("tree"), F.col(id_col).alias("id"), own.alias("digest"), F.when(F.coalesce(when if when is not None else false, false), other).alias("other"),
    )
    leaves = placed(leaves, "tree", ["id", "digest"], scratch, "leaves")
    rounds, renamed = [leaves], {}
    while True:
        nodes = scratch.keep(reduce_blocks(rounds[-1], levels), f"nodes{len(rounds)}")
        size = nodes.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
        rounds.append(nodes)
        if size["k"] <= top:
            break
        if size["n"] == 1:  # one node for each source, and too many of these: they go on as the leaves of one tree
            ranked = placed(nodes.select("tree", "digest", F.lit("").alias("all_")), "all_", ["tree"], scratch, f"sources{len(rounds)}")
            ranked = scratch.keep(ranked.select(F.col("tree").alias("was"), F.lit("").alias("tree"), "pos", "n", "digest"), f"renamed{len(rounds)}")
            renamed[len(rounds) - 1] = ranked
            rounds[-1] = ranked
    found, root = top_paths([(r["tree"], r["pos"], r["digest"]) for r in rounds[-1].select("tree", "pos", "digest").collect()]) if size["k"] else ({}, None)
    above, paths = spark.sparkContext.broadcast(found), None
    for k in range(len(rounds) - 2, 0, -1):
        paths = scratch.keep(finish(rounds[k].select("tree", "pos", "n", "digest"), levels, paths, above, root, give_paths, PATHS), f"paths{k}")
        if k in renamed:  # back to the sources, whose subroots are these nodes
            names = renamed[k].select("was", F.col("pos").alias("at_"), "digest")
            paths = paths.join(names, F.col("pos") == F.col("at_")).select(F.col("was").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "at", "run")

    def give(t: pa.Table, found: list[tuple[str, tuple[Step, ...]]]) -> pa.Table:
        rows = []
        for leaf, other, (subroot, path) in zip(t.column("digest").to_pylist(), t.column("other").to_pylist(), found):
            proof = siblings(path)
            back = fold(leaf if other is None else other, path)
            rows.append((leaf, subroot, root, h([proof]), back, back == root, proof if proofs else None))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.string()]
        made = {c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(names) if proofs or c != "proof"}
        return pa.table({"id": t.column("id")} | made)

    kind = docs.schema[id_col].dataType.simpleString()
    out = finish(leaves, levels, paths, above, root, give, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * proofs)
    return out.withColumnRenamed("id", id_col)

