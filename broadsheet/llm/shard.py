"""Sharding: the contiguous partition of ordered atomic groups whose largest shard is smallest."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running

#: Cut points that the driver looks at in one round; the bound doesn't depend on the input.
POINTS = 32_768


def reach(points: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy check: the cuts if each shard takes all that fits capacity, None if shards are too few."""
    cuts, at = [], 0
    for _ in range(shards):
        i = bisect_right(points, at + capacity)
        if not i or points[i - 1] <= at:
            return None
        at = points[i - 1]
        cuts.append(at)
        if at == points[-1]:
            return cuts
    return None


def smallest(points: list[int], low: int, high: int, shards: int) -> int:
    """The smallest capacity in low..high for which reach() finds cuts; high must be feasible."""
    while low < high:
        mid = (low + high) // 2
        if reach(points, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def cut_points(ends: DataFrame, shards: int, points: int = POINTS) -> list[int]:
    """The last running totals of the shards of the minimax partition.

    ends: one column, end, the distinct running totals at the ends of groups. Each round sees at most about
    `points` true cut points, the last of each block of equal width; they bound the best capacity from both sides
    to one block width, and so every cut to a range. Later rounds take narrower blocks inside of these ranges only,
    until all ends there fit; then the search is exact. No round sees more than the bound, whatever the input.
    """
    top = ends.agg(F.max("end")).first()[0]
    if top is None:
        return []
    ranges, low = [(0, top)], -(-top // shards)
    while True:
        in_any = F.lit(False)
        for a, b in ranges:
            in_any = in_any | ((F.col("end") > a) & (F.col("end") <= b))
        inside = ends.where(in_any) if ranges != [(0, top)] else ends
        width = max(1, -(-sum(b - a for a, b in ranges) // points))
        rows = inside.groupBy(F.floor(F.col("end") / F.lit(width)).alias("block")).agg(F.max("end").alias("end"), F.count("*").alias("n")).collect()
        seen = sorted({r["end"] for r in rows} | {top})
        high = smallest(seen, low, top, shards)
        if all(r["n"] == 1 for r in rows):
            return reach(seen, high, shards)
        low, high = max(low, high - width), high
        near, a, b = [], 0, 0
        for _ in range(shards):
            # the true cut lies between the greedy cuts of seen points under low and of any point under high
            i = bisect_right(seen, a + low)
            a = max(a, seen[i - 1]) if i else a
            b = min(top, b + high)
            if near and a - 1 <= near[-1][1]:
                near[-1] = (near[-1][0], max(near[-1][1], b))
            else:
                near.append((max(0, a - 1), b))
            if a >= top:
                break
        if near == ranges or sum(b - a for a, b in near) > 0.5 * sum(b - a for a, b in ranges):
            points *= 2  # blocks can't narrow the ranges: look at more of them
        ranges = near


def shard(df: DataFrame, size: Column, group: Column, order: str, scratch: Scratch, shards: int = 16) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard).

    group: rows with an equal value stay together; groups come in the order of their smallest `order` value, and a
    shard is a run of groups. The largest shard's sum of sizes is as small as such a partition allows. A group
    larger than the mean fills a shard alone if need be. size must be 1 or more. Rows that are equal in all of
    group and order have their slots in any order; a null group is a group, and comes by its order like any other. Columns
    named shard or slot are replaced. An empty table gives an empty result.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    if df.isEmpty():
        return df.select(*own, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # df's own columns stay out of the way of those that are worked with
    rows = df.select(F.struct(*own).alias("kept"), size.cast("long").alias("size"), group.alias("group"), F.col(order).alias("order"))
    keyed = scratch.keep(rows, "keyed")
    firsts = keyed.groupBy("group").agg(F.min("order").alias("first"))
    rows = keyed.join(firsts, "group")
    # all rows of a group have the same first; sizes of 1 or more make running totals distinct
    rows = running(rows, ["first", "group", "order"], {"end": F.col("size"), "row": F.lit(1).cast("long")}, scratch, "ordered")
    rows = scratch.keep(rows, "placed")
    groups = scratch.keep(rows.groupBy("group").agg(F.max("end").alias("end"), F.max("row").alias("last")), "groups")
    cuts = cut_points(groups.select("end"), shards)
    before = {r["end"]: r["last"] for r in groups.where(F.col("end").isin(cuts)).collect()}
    at, starts = F.lit(0), F.lit(0).cast("long")
    for k, c in enumerate(cuts[:-1], 1):
        at = F.when(F.col("end") > c, k).otherwise(at)
        starts = F.when(F.col("end") > c, F.lit(before[c]).cast("long")).otherwise(starts)
    return rows.select("kept.*", at.cast("int").alias("shard"), (F.col("row") - 1 - starts).alias("slot"))
