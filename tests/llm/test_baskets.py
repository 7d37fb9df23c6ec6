import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import baskets
from broadsheet.llm.common import Scratch


def brute(rows, min_count, one_in, confidence):
    """Every itemset of the rows' baskets, counted one by one."""
    sets = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n, support = len(sets), {}
    for s in sets.values():
        for k in range(1, len(s) + 1):
            for x in combinations(sorted(s), k):
                support[x] = support.get(x, 0) + 1
    often = {x: c for x, c in support.items() if c >= min_count and c * one_in >= n}
    out = []
    for x, c in often.items():
        if any(set(x) < set(y) and d == c for y, d in often.items()):
            continue
        rules = []
        for one in x if len(x) > 1 else ():
            a, s = support[tuple(i for i in x if i != one)], support[one,]
            if 100 * c >= confidence * a and c * n > a * s:
                rules.append((one, a, s))
        out.append((list(x), c, rules))
    return sorted(out)


def ran(df, scratch, *args):
    return sorted((r["items"], r["support"], [tuple(x) for x in r["rules"]]) for r in baskets.closed(df, scratch, "b", "i", *args).collect())


@pytest.mark.parametrize("seed,nodes,confidence", [(1, 400_000, 10), (2, 7, 60), (3, 1, 95)])
def test_like_brute_force(spark, scratch, monkeypatch, seed, nodes, confidence):
    monkeypatch.setattr(baskets, "TREE_NODES", nodes)
    monkeypatch.setattr(baskets, "GATHERED", 5)
    rng = random.Random(seed)
    rows = []
    for b in range(300):
        some = {min(int(rng.expovariate(0.35)), 11) for _ in range(rng.randint(1, 7))} | ({2, 5, 9} if b % 4 == 0 else set()) | ({-7, 1 << 40} if b % 9 == 0 else set())
        rows += [(b, i) for i in some] + [(b, i) for i in list(some)[:1]]
    rows += [(None, 3), (7, None), (None, None)]
    df = spark.createDataFrame(rows, "b long, i long").withColumn("item", F.lit("x")).withColumn("support", F.lit(1)).withColumn("tree", F.lit(2))
    assert ran(df, scratch, 5, 40, confidence) == brute(rows, 5, 40, confidence)


def test_beyond_the_broadcast_bound(spark, scratch, monkeypatch):
    monkeypatch.setattr(baskets, "BROADCAST_ROWS", 0)
    rows = [(b, i) for b in range(40) for i in range(1 + b % 5)]
    assert ran(spark.createDataFrame(rows, "b long, i long"), scratch, 8, 2000, 10) == brute(rows, 8, 2000, 10)


def test_one_basket_with_most_items_and_equal_baskets(spark, scratch):
    rows = [(0, i) for i in range(3000)] + [(b, i) for b in range(1, 60) for i in (1, 2, 3)]
    assert ran(spark.createDataFrame(rows, "b long, i long"), scratch, 8, 2000, 10) == [([1, 2, 3], 60, [])]


def test_small_tables(spark, scratch):
    kinds = "b long, i long"
    assert ran(spark.createDataFrame([], kinds), scratch, 8) == []
    assert ran(spark.createDataFrame([(None, 1), (1, None)], kinds), Scratch(spark, "nulls"), 1) == []
    assert ran(spark.createDataFrame([(1, 5)] * 3, kinds), Scratch(spark, "one"), 1) == [([5], 1, [])]
    assert ran(spark.createDataFrame([("a", 5), ("b", 5), ("b", 6)], "b string, i int"), Scratch(spark, "text"), 1) == [([5], 2, []), ([5, 6], 1, [])]


def test_merge_of_lists():
    """Codes of a small tree: a-b-c twice, a-c once, b-c three times."""
    t = baskets.Tree()
    for path, n in (([1, 2, 3], 2), ([1, 3], 1), ([2, 3], 3)):
        t.add(path, n)
    t.shut(0)
    import numpy as np

    lists = {x: tuple(np.array(v) for v in zip(*[(i, t.post[i], t.n[i]) for i in range(len(t.item)) if t.item[i] == x])) for x in (1, 2, 3)}
    assert [v.tolist() for v in baskets.merge(lists[1], lists[3])] == [[0], [t.post[0]], [3]]
    assert baskets.merge(lists[2], lists[3])[2].tolist() == [2, 3]
    assert baskets.merge(lists[1], lists[2])[2].tolist() == [2]
    assert baskets.merge(baskets.merge(lists[1], lists[3]), baskets.merge(lists[2], lists[3]))[2].tolist() == [2]
