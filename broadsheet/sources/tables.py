"""Tables that an operator writes and reads again on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="broadsheet-"))
    return sc.getCheckpointDir()


class Tables:
    """Written tables of one run: they cut the lineage, and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(conf).delete(path, True)
