"""Train and test sets: exact splits, policies by origin, union, folds, runs, compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.sources.tables import Tables

# Label and share of test rows by origin, and whether its training rows make the vocabulary.
POLICY = [("wiki-ads", 1, 1.0, False), ("web-ads", 1, 0.0, True), ("non-ads", 0, 0.4, True)]
SHARDS, FOLDS = 8, 3
#: Digits of a hash that tell its range: 16 ** 5 ranges, each ranked by itself.
CELL_DIGITS = 5


def policy(spark) -> DataFrame:
    return spark.createDataFrame(POLICY, "origin string, label int, test_share double, in_vocabulary boolean")


def exact_split(rows: DataFrame, key: str, origin: str, share: float | None = None) -> DataFrame:
    """rows with part: exactly floor(n * share) test rows of each origin, in the order of a hash of the key.

    share, or the column test_share; 0 to under 0.5, or 1. The rank inside of an origin comes from ranges of the hash, so
    an origin that has most rows isn't ranked by one task.
    """
    if share is not None:
        if not (0 <= share < 0.5 or share == 1):
            raise ValueError("a share is under a half, or 1")
        rows = rows.withColumn("test_share", F.lit(float(share)))
    h = F.md5(F.col(key).cast("string"))
    rows = rows.withColumn("h_", h).withColumn("cell_", F.substring("h_", 1, CELL_DIGITS))
    cells = rows.groupBy(origin, "cell_").agg(F.count("*").alias("c_"))
    w = Window.partitionBy(origin).orderBy("cell_")
    cells = cells.select(origin, "cell_", (F.sum("c_").over(w) - F.col("c_")).alias("before_"), F.sum("c_").over(Window.partitionBy(origin)).alias("n_"))
    rank = F.row_number().over(Window.partitionBy(origin, "cell_").orderBy("h_", key)) + F.col("before_")
    joined = rows.join(cells, [origin, "cell_"]).withColumn("rank_", rank)
    part = F.when(F.col("rank_") <= F.floor(F.col("n_") * F.col("test_share")), "test").otherwise("train")
    return joined.withColumn("part", part).drop("h_", "cell_", "before_", "n_", "rank_", *(["test_share"] if share is not None else []))


def round_robin(rows: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """rows with shard: in turn by the order of the key, of any type. A row's number is its rank in its range plus the rows of earlier ranges.

    Rows are dealt out by ranges of the key, whose ends follow from how keys are spread, so keys may stand in clusters; the
    dealt rows are written down, and only one row a range meets in one place.
    """
    dealt = rows.repartitionByRange(key).withColumn("range_", F.spark_partition_id())
    dealt = Tables(rows.sparkSession, "ranges").keep(dealt, "rows")
    starts = dealt.groupBy("range_").agg(F.count("*").alias("c_"))
    starts = starts.select("range_", (F.sum("c_").over(Window.orderBy("range_")) - F.col("c_")).alias("start_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(key))
    number = F.col("start_") + own - 1
    return dealt.join(F.broadcast(starts), "range_").withColumn("shard", F.pmod(number, F.lit(shards)).cast("int")).drop("range_", "start_")


def folds(rows: DataFrame, key: str, n: int = FOLDS) -> DataFrame:
    return round_robin(rows, key, n).withColumnRenamed("shard", "fold")


def union_sets(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def shuffled(rows: DataFrame, seed: int = 1) -> DataFrame:
    """A random order by ranges of a seeded number; the rows are the same."""
    return rows.orderBy(F.rand(seed))


def latest(runs: DataFrame, *by: str) -> DataFrame:
    """The newest run: a top-1 by task, no full sort. Further columns say which of runs at the same time, the largest first."""
    return runs.orderBy(*[F.desc(c) for c in by]).limit(1)


def last_text(rows: DataFrame, title: str, text: str, seq: str) -> DataFrame:
    """title, text: of rows with the same title the last one's."""
    return rows.groupBy(title).agg(F.max_by(text, seq).alias(text))


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two vocabularies have the same names, and how many each has alone."""
    x, y = a.select("feature").distinct().withColumn("l", F.lit(1)), b.select("feature").distinct().withColumn("r", F.lit(1))
    both = x.join(y, "feature", "full")
    n = both.agg(F.count_if(F.col("r").isNull()).alias("only_a"), F.count_if(F.col("l").isNull()).alias("only_b"))
    return n.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))
