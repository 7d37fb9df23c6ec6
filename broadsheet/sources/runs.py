"""Run folders: dated, with notes beside the tables, listed and chosen again by what they hold."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers, writers
from .readers import run_folders

#: How a run's folder is named.
STAMP = "%Y-%m-%d-%H-%M"


class EmptySet(ValueError):
    """A set without rows, which nothing can be fitted to."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder of any store, sorted; none if it isn't there."""
    fs, p = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def shards(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "", most: int | None = None) -> list[str]:
    """Paths of the shards in a folder by name; `most` takes the first so many on purpose."""
    found = [f"{folder}/{n}" for n in names_in(spark, folder) if n.startswith(prefix) and n.endswith(suffix)]
    return found if most is None else found[:most]


def new_run(spark: SparkSession, root: str, when: datetime | None = None) -> str:
    """The folder of a run that starts now, made if it isn't there; runs of the same minute share it."""
    path = f"{root}/{(when or datetime.now()).strftime(STAMP)}"
    fs, p = _at(spark, path)
    fs.mkdirs(p)
    return path


def runs(spark: SparkSession, root: str, required: tuple[str, ...] = ()) -> DataFrame:
    """name, run_ts of the runs that have all required files, the newest first."""
    whole = [(n,) for n in names_in(spark, root) if set(required) <= set(names_in(spark, f"{root}/{n}"))]
    return run_folders(spark.createDataFrame(whole, "name string")).orderBy(F.desc("run_ts"), "name")


def note(spark: SparkSession, run: str, **facts: object) -> None:
    """Adds facts to a run; what was noted before stays, and the last of a name counts."""
    # by time, and by chance for two that are written at once, so neither takes the other's place
    at = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    line = json.dumps({"at": at, "facts": facts}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{run}/info/{at}")


def notes(spark: SparkSession, run: str) -> dict:
    """What a run's notes say: a few lines."""
    if not names_in(spark, f"{run}/info"):
        return {}
    said = [json.loads(r["value"]) for r in spark.read.option("recursiveFileLookup", True).text(f"{run}/info").collect()]
    out: dict = {}
    for x in sorted(said, key=lambda x: (isinstance(x["at"], str), x["at"])):
        out |= x["facts"]
    return out


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A set's table; EmptySet if it has no rows."""
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        raise EmptySet(path)
    return rows


class OtherVocabulary(ValueError):
    """A vocabulary that isn't the one a model or a set was made with."""


def vocabulary_hash(vocab: DataFrame) -> str:
    """What a vocabulary's features and numbers are, in one line: the same in any order of its rows, another if any of them is."""
    h = F.xxhash64("feature", F.col("idx").cast("long"))
    r = vocab.agg(F.count("*").alias("n"), F.hex(F.coalesce(F.bit_xor(h), F.lit(0).cast("long"))).alias("x"), F.coalesce(F.sum(F.pmod(F.xxhash64(h), F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def save_vocabulary(spark: SparkSession, run: str, vocab: DataFrame) -> None:
    """The vocabulary of a run, and a note that tells what it is."""
    writers.vocabulary(vocab, f"{run}/vocabulary")
    note(spark, run, vocabulary=vocabulary_hash(vocab))


def load_vocabulary(spark: SparkSession, run: str) -> DataFrame:
    """feature, idx of a run's vocabulary, to extract with as it is; OtherVocabulary if it isn't what the run's notes tell."""
    vocab = readers.vocabulary(spark, f"{run}/vocabulary")
    if vocabulary_hash(vocab) != notes(spark, run).get("vocabulary"):
        raise OtherVocabulary(run)
    return vocab


def bind(spark: SparkSession, model_run: str, data_run: str) -> None:
    """Notes at a model's run which data it learned from, and their vocabulary."""
    note(spark, model_run, data=data_run, vocabulary=notes(spark, data_run).get("vocabulary"))


def check_bound(spark: SparkSession, model_run: str, data_run: str) -> None:
    """OtherVocabulary unless a model's features are those of a data set."""
    ours, theirs = notes(spark, model_run).get("vocabulary"), notes(spark, data_run).get("vocabulary")
    if ours is None or ours != theirs:
        raise OtherVocabulary(f"{model_run} and {data_run}")
