"""Readers of the text formats: dumps, corpora, framed samples, indexes, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = "samplesSeparator"


def framed(spark: SparkSession, path: str, end: str) -> DataFrame:
    """value: what stands before each `end` line; compressed files too. Bytes that aren't UTF-8 raise an error."""
    return spark.read.option("lineSep", end + "\n").text(path).withColumn("value", F.validate_utf8("value"))


def numbered(spark: SparkSession, path: str, end: str = "") -> DataFrame:
    """value, ordinal of the records that aren't empty, from 0 in the order of file names and of places in a file.

    A record's number is its place in its split of a file plus the records of earlier splits; only one row a split meets in one place.
    """
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    rows = spark.read.option("lineSep", end + "\n").text(path).select(F.validate_utf8("value").alias("value"), *[F.col(c).alias(n) for c, n in zip(at, ("file_", "start_"))], F.monotonically_increasing_id().alias("place_"))
    rows = rows.where("value <> ''")
    splits = rows.groupBy("file_", "start_").agg(F.count("*").alias("n"))
    splits = splits.withColumn("before", F.sum("n").over(Window.orderBy("file_", "start_")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("file_", "start_").orderBy("place_")) - 1
    return rows.join(splits, ["file_", "start_"]).select("value", (F.col("before") + own).alias("ordinal"))


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """page_seq, ns, title, raw_text of a dump; bodies stay escaped. Pages without a body or with an empty one go."""
    page = framed(spark, path, "  </page>").where(F.instr("value", "  <page>") > 0)
    cut = page.select(
        F.monotonically_increasing_id().alias("page_seq"),
        F.regexp_extract("value", r"<ns>\s*(-?[0-9]+)\s*</ns>", 1).try_cast("int").alias("ns"),
        F.regexp_extract("value", r"<title>(.*)</title>", 1).alias("title"),
        F.regexp_extract("value", r"(?s)<text[^>]*(?<!/)>(.*)</text>", 1).alias("raw_text"),
    )
    return cut.where("raw_text <> ''")


def ad_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source, text of a corpus of web pages; the source is between the first and the last quote of its line."""
    page = framed(spark, path, "    </page>").where(F.instr("value", "<page ") > 0)
    head = F.regexp_extract("value", r"(?m)^ *<page [^\n]*$", 0)
    return page.select(F.regexp_extract(head, '"(.*)"', 1).alias("source"), F.regexp_extract("value", r"(?s)<page [^\n]*\n(.*)$", 1).alias("text"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """title, text of framed samples."""
    return framed(spark, path, SEPARATOR).where("value <> ''").select(F.substring_index("value", "\n", 1).alias("title"), F.rtrim(F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\n$", "")).alias("text"))


def analysed_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, lines of an analyser's output."""
    return framed(spark, path, SEPARATOR).select(F.monotonically_increasing_id().alias("sample_id"), F.col("value").alias("lines"))


def analysed_records(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, lines of an analyser's output in which any line without a brace ends a sample."""
    whole = analysed_samples(spark, path)
    # cut at the lines without a brace, each with the line end before it; nothing is a row for a line
    part = whole.select("sample_id", F.posexplode(F.split("lines", r"(?:^|\n)[^{\n]*+(?=\n|\z)")).alias("part", "lines"))
    part = part.withColumn("lines", F.ltrim("lines", F.lit("\n"))).where("lines <> ''")
    return part.select(F.concat_ws("-", F.col("sample_id").cast("string"), F.col("part").cast("string")).alias("sample_id"), "lines")


def index(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, source; a source may have several lines."""
    return framed(spark, path, SEPARATOR).where("value <> ''").select(F.monotonically_increasing_id().alias("sample_id"), F.regexp_replace("value", r"\n$", "").alias("source"))


def set_index(spark: SparkSession, path: str) -> DataFrame:
    """label, source of a matrix's rows."""
    return framed(spark, path, SEPARATOR).where("value <> ''").select(F.substring_index("value", "\n", 1).cast("int").alias("label"), F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\n$", "").alias("source"))


def set_rows(spark: SparkSession, path: str, label: int) -> DataFrame:
    """ordinal, source of a matrix's rows of a label."""
    rows = numbered(spark, path, SEPARATOR)
    source = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\n$", "")
    return rows.where(F.substring_index("value", "\n", 1).cast("int") == label).select("ordinal", source.alias("source"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """feature, idx of name:index lines."""
    line = spark.read.text(path).where("value <> ''")
    return line.select(F.regexp_extract("value", r"^(.*):([0-9]+)$", 1).alias("feature"), F.regexp_extract("value", r"^(.*):([0-9]+)$", 2).cast("int").alias("idx"))


def vectors(spark: SparkSession, path: str, size: int = 20, unknown: str | None = None) -> DataFrame:
    """word, vec, idx (by order of the lines); each has to have `size` numbers, and one of them the word for unknown ones if it is named."""
    parts = F.split("value", " ")
    line = numbered(spark, path)
    if unknown is not None and line.where(F.startswith("value", F.lit(unknown + " "))).isEmpty():
        raise ValueError(f"no vector of {unknown}")
    vec = F.transform(F.slice(parts, 2, size), lambda x: x.cast("float"))
    return line.select(F.element_at(parts, 1).alias("word"), F.when(F.size(parts) == size + 1, vec).otherwise(F.raise_error(F.lit(f"a vector hasn't {size} numbers"))).alias("vec"), F.col("ordinal").alias("idx"))


def run_folders(names: DataFrame) -> DataFrame:
    """name, run_ts of names like 2015-04-30-12-05."""
    return names.where(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}-\d{2}-\d{2}$")).withColumn("run_ts", F.to_timestamp("name", "yyyy-MM-dd-HH-mm"))
