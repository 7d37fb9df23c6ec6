"""Writers: Parquet for use here, and the text and binary formats for other tools."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators import dataset

from .readers import SEPARATOR


def sample_table(df: DataFrame, path: str, by: list[str] = ["origin", "label", "part"]) -> None:  # noqa: B006
    """Samples by partition columns, so that a reader of one set reads no other."""
    df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns]).parquet(path)


def _text(df: DataFrame, value, path: str, compression: str | None) -> None:
    df.select(value.alias("value")).write.mode("overwrite").options(**({"compression": compression} if compression else {})).text(path)


def samples(df: DataFrame, path: str, compression: str | None = "bzip2") -> None:
    _text(df, F.concat_ws("\n", "title", "text", F.lit(SEPARATOR)), path, compression)


def shards(df: DataFrame, path: str, key: str, n: int = dataset.SHARDS, compression: str = "bzip2") -> None:
    """Samples in n folders, dealt out in turn by the order of the key."""
    dealt = dataset.round_robin(df, key, n).select("shard", F.concat_ws("\n", "title", "text", F.lit(SEPARATOR)).alias("value"))
    dealt.repartition("shard").write.mode("overwrite").option("compression", compression).partitionBy("shard").text(path)


def index(df: DataFrame, path: str, compression: str | None = None) -> None:
    _text(df, F.concat_ws("\n", "source", F.lit(SEPARATOR)), path, compression)


def set_index(df: DataFrame, path: str, compression: str | None = "bzip2") -> None:
    _text(df, F.concat_ws("\n", F.col("label").cast("string"), "source", F.lit(SEPARATOR)), path, compression)


def wiki_dump(df: DataFrame, path: str, compression: str | None = "bzip2") -> None:
    """Pages (title, ns, text) as a dump has them; markup signs in bodies are escaped."""
    body = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(sign), F.lit(name))
    head = F.concat(F.lit("  <page>\n    <title>"), "title", F.lit("</title>\n    <ns>"), F.col("ns").cast("string"), F.lit("</ns>\n"))
    _text(df, F.concat(head, F.lit('      <text xml:space="preserve">'), body, F.lit("</text>\n  </page>")), path, compression)


def ad_corpus(df: DataFrame, path: str, compression: str | None = "bzip2") -> None:
    """source, text as a corpus of web pages."""
    _text(df, F.concat(F.lit('    <page source="'), "source", F.lit('">\n'), "text", F.lit("\n    </page>")), path, compression)


def analysed(df: DataFrame, path: str, compression: str | None = "bzip2") -> None:
    """Samples' token lines (lines), each sample ended by the separator."""
    _text(df, F.concat_ws("\n", "lines", F.lit(SEPARATOR)), path, compression)


def vectors(df: DataFrame, path: str, order: str) -> None:
    """word, vec as lines of a word and its numbers, in the order of a column."""
    lines = df.orderBy(order)
    _text(lines, F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")), path, None)


def vocabulary(df: DataFrame, path: str) -> None:
    """name:index lines; a colon in a name can't be read back."""
    name = F.when(F.contains("feature", F.lit(":")), F.raise_error(F.lit("a feature's name has a colon"))).otherwise(F.col("feature"))
    _text(df, F.concat_ws(":", name, F.col("idx").cast("string")), path, None)


def lexeme_stream(df: DataFrame, path: str) -> None:
    """A line for each sample: its lexemes with spaces between."""
    _text(df, F.concat_ws(" ", "lexemes"), path, None)


def libsvm(df: DataFrame, path: str) -> None:
    """label, features (vector) in the sparse text format."""
    df.select(F.col("label").cast("double"), "features").write.mode("overwrite").format("libsvm").save(path)


def packed(df: DataFrame) -> DataFrame:
    """key-less records of label, len, ids as label u8, len u32, ids u16, little-endian; ids are padded already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("label", "len", "ids")))
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack(f"<BI{len(i)}H", x, n, *i) for x, n, i in rows], pa.binary())], names=["record"])

    return df.select("label", "len", "ids").mapInArrow(run, "record binary")


def packed_corpus(df: DataFrame, path: str) -> None:
    """The records of packed() as a table of binaries, a row each."""
    packed(df).write.mode("overwrite").parquet(path)


def dense_matrix(df: DataFrame, path: str) -> None:
    """label, features (array of doubles) with nulls as NaN, which stands for a missing value in the matrix."""
    missing = F.transform("features", lambda x: F.coalesce(x, F.lit(float("nan"))))
    df.withColumn("features", missing).write.mode("overwrite").parquet(path)


def catalogue(tree: DataFrame, links: DataFrame, path: str) -> None:
    """A catalogue's tree (category, parent, links_count) and links."""
    tree.write.mode("overwrite").parquet(f"{path}/tree")
    links.write.mode("overwrite").parquet(f"{path}/links")
