"""What the operators share: the shared folder, written tables, running totals over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word definition, as a character class for regular expressions.
SPACE = r"[\x20\x09-\x0D]"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    It is set to a temporary folder only where it is unset and the master is local, as in tests.
    """
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir", None):
        return root
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="broadsheet-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written under the shared folder; they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.at = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def normal_space(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body has it inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """df in a global order, with inclusive running totals of sums.

    The rows are dealt out by ranges of the order, which may split ties of its leading columns; totals run
    inside of each range, and only one row per range meets in one place.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts_of(spark), *order).withColumn("range_", F.spark_partition_id())
    ranged = scratch.keep(ranged, name)
    totals = ranged.groupBy("range_").agg(*[F.sum(c).alias(f"{k}_all") for k, c in sums.items()])
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_", *[F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_at") for k in sums])
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(f"{k}_in") for k, c in sums.items()]).join(F.broadcast(starts), "range_")
    return out.select(*[c for c in df.columns], *[(F.col(f"{k}_in") + F.col(f"{k}_at")).alias(k) for k in sums])


#: Rows of keys that a join may broadcast (two longs each, which take some 100 bytes of the driver where null keys are equal); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def by_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join (nulls are equal to each other) whose keys are broadcast only if they are few."""
    keys = keys.select(*[F.col(c).alias(f"{c}_key") for c in on]).distinct()
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = F.lit(True)
    for c in on:
        same = same & df[c].eqNullSafe(keys[f"{c}_key"])
    return df.join(keys, same, how)
