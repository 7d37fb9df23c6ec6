"""Closed frequent itemsets of baskets, and their rules, by N-lists of prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, parts_of

#: Nodes of a prefix tree; a task builds one tree after another, so this bounds what it holds.
TREE_NODES = 400_000
#: Pairs of nodes whose items are gathered before they are summed up.
GATHERED = 4_000_000

LISTS = "tree long, suffix array<long>, item long, support long, pre array<int>, post array<int>, n array<long>"


def looked_up(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join whose right side is broadcast only if it has been counted and is small."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


class Tree:
    """A prefix tree of paths that come in their order, with the codes of its nodes: pre counts nodes as they open, post as they close."""

    def __init__(self) -> None:
        self.item: list[int] = []
        self.up: list[int] = []
        self.n: list[int] = []
        self.post: list[int] = []
        self.open: list[int] = []
        self.closed = 0

    def shut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.post[self.open.pop()] = self.closed
            self.closed += 1

    def add(self, path: list[int], n: int) -> None:
        """Paths with a common beginning have to come one after the other."""
        depth = 0
        while depth < min(len(path), len(self.open)) and self.item[self.open[depth]] == path[depth]:
            depth += 1
        self.shut(depth)
        for node in self.open:
            self.n[node] += n
        for x in path[depth:]:
            self.up.append(self.open[-1] if self.open else -1)
            self.open.append(len(self.item))
            self.item.append(x)
            self.n.append(n)
            self.post.append(0)


def merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The N-list (pre, post, n) of the union of two itemsets that differ in their first item only, a's being the more frequent.

    Both lists are in the order of pre. No node of a is below another one, so only the last one that opens before a node of b
    can be above it; it is, if it closes later. A node of a gets the counts of the nodes below it.
    """
    at = np.searchsorted(a[0], b[0], "left") - 1
    below = (at >= 0) & (a[1][at] > b[1])
    at, n = at[below], b[2][below]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return a[0][at[first]], a[1][at[first]], np.add.reduceat(n, first) if len(first) else n


def trees(paths: DataFrame) -> DataFrame:
    """The N-list of each item in each prefix tree, and of each pair of items the support in each tree, without lists.

    paths: path array<long> (items from the most frequent on), n: how many baskets have it, dealt out by ranges and sorted.
    Pairs are summed up over the nodes above each node, a step to the root at a time for all nodes of a tree.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, tree = TaskContext.get().partitionId(), 0, Tree()

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal k, tree
            if tree.item:
                tree.shut(0)
                yield from rows(part << 32 | k, tree)
            k, tree = k + 1, Tree()

        for b in batches:
            for path, n in zip(b.column("path").to_pylist(), b.column("n").to_pylist()):
                if len(tree.item) >= TREE_NODES:
                    yield from done()
                tree.add(path, n)
        yield from done()

    def rows(key: int, t: Tree) -> Iterator[pa.RecordBatch]:
        items, item = np.unique(np.array(t.item, np.int64), return_inverse=True)
        up, n, post = np.array(t.up), np.array(t.n, np.int64), np.array(t.post, np.int32)
        order = np.argsort(item, kind="stable")  # nodes are numbered by pre
        edge = np.append(np.flatnonzero(np.diff(item[order], prepend=-1)), len(order)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (order.astype(np.int32), post[order], n[order])]
        none = pa.array([[]] * len(items), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(items)), none, pa.array(items), pa.array(np.add.reduceat(n[order], edge[:-1])), *lists], names=["tree", "suffix", "item", "support", "pre", "post", "n"])
        found, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, above, pairs, counts, gathered = np.arange(len(item)), up, [], [], 0
        while len(node):
            node, above = node[above >= 0], above[above >= 0]
            pairs.append(item[above] * len(items) + item[node])
            counts.append(n[node])
            gathered += len(node)
            above = up[above]
            if gathered > GATHERED or not len(node):
                found, which = np.unique(np.concatenate([found, *pairs]), return_inverse=True)
                total = np.zeros(len(found), np.int64) + np.bincount(which, np.concatenate([total, *counts]), len(found)).astype(np.int64)
                pairs, counts, gathered = [], [], 0
        nothing = [pa.nulls(len(found), pa.list_(pa.int32()))] * 2 + [pa.nulls(len(found), pa.list_(pa.int64()))]
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(items[found % len(items)])), pa.array(items[found // len(items)]), pa.array(total), *nothing], names=["tree", "suffix", "item", "support", "pre", "post", "n"])

    return paths.mapInArrow(build, LISTS)


def list_rows(tree: int, rows: list[tuple]) -> pa.Table:
    kinds = [pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.table({"tree": pa.array([tree] * len(rows), pa.int64())} | dict(zip(["suffix", "item", "support", "pre", "post", "n"], cols)))


def lists_of(t: pa.Table) -> list[tuple[np.ndarray, ...]]:
    cols = [t.column(c).combine_chunks() for c in ("pre", "post", "n")]
    at = cols[0].offsets.to_numpy()
    flat = [c.values.to_numpy() for c in cols]
    return [tuple(f[x:y] for f in flat) for x, y in zip(at, at[1:])]


def of_pairs(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """The N-lists of pairs, from those of items; wanted has the pairs to make in each tree: suffix [y] and x, x being the more frequent."""

    def merged(t: pa.Table) -> pa.Table:
        whole = t.filter(pc.is_valid(t.column("pre")))
        own = dict(zip(whole.column("item").to_pylist(), lists_of(whole)))
        pairs = t.filter(pc.is_null(t.column("pre")))
        out = [(s, x, k, *merge(own[x], own[s[0]])) for s, x, k in zip(*(pairs.column(c).to_pylist() for c in ("suffix", "item", "support")))]
        return list_rows(t.column("tree")[0].as_py(), out)

    return lists.unionByName(wanted.select(*lists.columns)).groupBy("tree").applyInArrow(merged, LISTS)


def extended(lists: DataFrame) -> DataFrame:
    """The N-lists of itemsets with one more item, of each suffix class of a tree by itself.

    A class has the itemsets with one suffix; all say which item stands before it, and `all`, that item's support everywhere.
    Of two items the more frequent one comes first. Where they are in a basket together, there is a row.
    """

    def grown(t: pa.Table) -> pa.Table:
        item, suffix, own = t.column("item").to_pylist(), t.column("suffix")[0].as_py(), lists_of(t)
        order = sorted(range(len(item)), key=lambda i, s=t.column("all").to_pylist(): (-s[i], item[i]))
        out = []
        for j, y in enumerate(order):
            for x in order[:j]:
                both = merge(own[x], own[y])
                if len(both[2]):
                    out.append(([item[y], *suffix], item[x], int(both[2].sum()), *both))
        return list_rows(t.column("tree")[0].as_py(), out)

    return lists.groupBy("tree", "suffix").applyInArrow(grown, LISTS)


def frequent(rows: DataFrame, scratch: Scratch, basket_col: str, item_col: str, min_count: int, one_in: int) -> tuple[DataFrame, int]:
    """items array<long> in ascending order and support of each frequent itemset, and the number of baskets."""
    spark = rows.sparkSession
    pairs = rows.select(F.col(basket_col).alias("basket"), F.col(item_col).cast("long").alias("item")).where("basket is not null and item is not null").distinct()
    pairs = scratch.keep(pairs, "pairs")
    n = pairs.select("basket").distinct().count()

    def enough(supports: DataFrame) -> DataFrame:
        return supports.where((F.col("support") >= min_count) & (F.col("support") * one_in >= n))

    def counted(lists: DataFrame, k: int) -> DataFrame:
        """The frequent itemsets of k items: their supports are the sums over all trees."""
        return scratch.keep(enough(lists.groupBy("suffix", "item").agg(F.sum("support").alias("support"))), f"sets{k}")

    def only(lists: DataFrame, sets: DataFrame) -> DataFrame:
        return looked_up(lists, sets.select("suffix", "item"), ["suffix", "item"], "left_semi")

    ones = scratch.keep(enough(pairs.groupBy("item").agg(F.count("*").alias("support"))), "sets1")
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "item")))
    baskets = looked_up(pairs, ones, ["item"], "inner").groupBy("basket").agg(F.transform(by_count, lambda x: x["item"]).alias("path"))
    paths = baskets.groupBy("path").agg(F.count("*").alias("n"))
    first = scratch.keep(trees(paths.repartitionByRange(parts_of(spark), "path").sortWithinPartitions("path")), "lists1")
    lists, local = first.where("size(suffix) = 0"), first.where("size(suffix) = 1")
    found = [ones.select(F.array("item").alias("items"), "support")]
    k, sets = 2, counted(local, 2)
    while not sets.isEmpty():
        found.append(sets.select(F.array_sort(F.concat(F.array("item"), "suffix")).alias("items"), "support"))
        if k == 2:
            lists = of_pairs(lists, only(local, sets))
        else:
            lists = only(lists, sets)
        alone = looked_up(lists, ones.select("item", F.col("support").alias("all")), ["item"], "inner")
        lists = scratch.keep(extended(alone), f"lists{k + 1}")
        scratch.drop(f"lists{k}")
        k += 1
        sets = counted(lists, k)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out, n


def closed(rows: DataFrame, scratch: Scratch, basket_col: str, item_col: str, min_count: int = 8, one_in: int = 2000, confidence: int = 10) -> DataFrame:
    """Per closed frequent itemset: items array<long> in ascending order, support long, rules array<struct<c, a, s>>.

    A basket is the set of items of the rows with one value of basket_col; rows in which either is null are passed over,
    repeated rows count once. An itemset is frequent if at least min_count baskets, and one in one_in of all, have all of
    its items; it is closed if each proper superset is in fewer. rules, by c: items c such that the rest of the itemset
    implies c: of the a baskets that have the rest at least `confidence` percent have c, and more than the s of all baskets
    would give by chance. An empty table gives no rows; other columns aren't read.

    1. Baskets become paths, from the most frequent item on; equal paths are one with a count. Paths are dealt out by
       ranges, so that those with a common beginning meet, and make prefix trees of bounded size, with codes of pre- and
       postorder. Each tree gives the N-lists of its items, and how often two items stand above each other.
    2. An itemset's N-lists come from those of two of its subsets by a merge, within its tree and suffix class; its support
       is the sum over trees. No task needs more than a class of a tree, and only what is frequent goes on. The work follows
       the number of frequent itemsets, not only of the closed ones.
    3. As a superset has no more baskets than the set, all of a set's baskets are contained in a superset's if the supports
       are equal. So an itemset is closed if none with one more item has its support, and each itemset tells this to those
       with one item less.
    """
    found, n = frequent(rows, scratch, basket_col, item_col, min_count, one_in)
    found = scratch.keep(found, "found")
    less = found.where("size(items) > 1").withColumn("c", F.explode("items"))
    less = less.withColumn("rest", F.array_remove("items", F.col("c")))
    above = less.groupBy(F.col("rest").alias("items")).agg(F.max("support").alias("above"))
    kept = found.join(above, "items", "left").where("above is null or above < support").drop("above")
    rest = found.select(F.col("items").alias("rest"), F.col("support").alias("a"))
    single = found.where("size(items) = 1").select(F.element_at("items", 1).alias("c"), F.col("support").alias("s"))
    ruled = less.join(rest, "rest").join(single, "c")
    ruled = ruled.where((100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * n > F.col("a") * F.col("s")))
    rules = ruled.groupBy("items").agg(F.array_sort(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))
    none = F.array().cast("array<struct<c: bigint, a: bigint, s: bigint>>")
    return kept.join(rules, "items", "left").select("items", "support", F.coalesce("rules", none).alias("rules"))
