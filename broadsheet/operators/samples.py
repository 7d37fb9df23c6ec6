"""Pages to samples: routing, sections, length gates, tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import markup, tokens
from broadsheet.operators.counters import Counters

# Characters that a marked sample has at least, that a section and a whole page exceed, that a raw section has
# at least, and beyond which a page is cut into sections.
MARKED_LEAST, SECTION_OVER, PAGE_OVER, RAW_SECTION_LEAST, LONG_PAGE = 100, 100, 200, 100, 2500
# Fixed value: the template that marks promotional articles.
MARKER = r"\{\{реклама\}\}"


def is_marked(text: Column, marker: str = MARKER) -> Column:
    """Upper or lower case; (?u) makes letters beyond ASCII fold as well."""
    return text.rlike(f"(?iu){marker}")


def route(text: Column) -> Column:
    return F.when(is_marked(text), "marked").when(F.length(text) > LONG_PAGE, "sections").otherwise("page")


def passes(origin: Column, cleaned: Column) -> Column:
    n = F.length(cleaned)
    return F.when(origin == "marked", n >= MARKED_LEAST).when(origin == "sections", n > SECTION_OVER).otherwise(n > PAGE_OVER)


#: Tokens of a block of samples, or so.
BLOCK = 500_000

#: What route() gives.
ORIGINS = ("marked", "sections", "page")


def counted_passes(rows: DataFrame, counters: Counters | None = None) -> DataFrame:
    """The rows (origin, text) that are long enough. counters get the rows of each origin, those that are rejected, and what is kept."""
    good = F.coalesce(passes(F.col("origin"), F.col("text")), F.lit(False))
    if counters is None:
        return rows.where(good)
    seen = {o: F.count_if(F.col("origin") == o) for o in ORIGINS} | {f"rejected_{o}": F.count_if((F.col("origin") == o) & ~good) for o in ORIGINS}
    return counters.watch(counters.watch(rows, "routed", **seen).where(good), "kept", chars=F.sum(F.length("text")))


def samples(pages: DataFrame, emit_tail: bool = False, counters: Counters | None = None) -> DataFrame:
    """page_seq, title, origin, label, part, text from pages (page_seq, ns, title, raw_text).

    Articles only; a marked one gives its marked section, a long one its sections, any other itself. Cheap tests
    come before cleaning, which runs once a row. The marker counts in the body only. One narrow stage without a shuffle.
    """
    pages = pages if counters is None else counters.watch(pages, "pages", articles=F.count_if(F.col("ns") == 0))
    marker = re.compile(MARKER, re.IGNORECASE)

    def pieces(origin: str, text: str) -> list[str | None]:
        if origin == "marked":
            return [markup.marked_section(text, marker)]
        return markup.sections(text, emit_tail) if origin == "sections" else [text]

    def cut(origin: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([pieces(o, t) if t is not None else [] for o, t in zip(origin, text)], dtype=object)

    cut = F.pandas_udf(cut, "array<string>").asNondeterministic()
    kept = pages.where(F.col("ns") == 0).withColumn("origin", route(F.col("raw_text")))
    rows = kept.withColumn("raw", cut("origin", "raw_text")).select("page_seq", "title", "origin", F.posexplode("raw").alias("part", "raw"))
    rows = rows.where((F.col("origin") != "sections") | (F.length("raw") >= RAW_SECTION_LEAST))
    rows = rows.withColumn("text", markup.clear(F.col("raw")))
    return counted_passes(rows, counters).select("page_seq", "title", "origin", (F.col("origin") == "marked").cast("int").alias("label"), "part", "text")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer tasks than there are; what follows costs more than moving the rows.

    Plans with a shuffle, a sort or a join stay as they are: their tasks aren't known before they run.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if any(x in plan.optimizedPlan().toString() for x in ("Aggregate", "Join", "Sort", "Repartition", "Window", "Limit", "Distinct")):
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, form, info by the built-in analysis: a row for each run of letters."""
    df = spread(df.select(key, text))
    found = df.select(key, F.posexplode(forms(F.col(text))).alias("pos", "form"))
    return found.withColumn("info", tokens.rule_analysis(F.col("form")))


def forms(text: Column) -> Column:
    """array<string>: the runs of letters of a text, null for null. Cut at what stands between, as taking matches out copies the whole text for each."""
    return F.array_remove(F.split(text, r"\P{L}+"), "")


def placed_words(df: DataFrame, key: str, text: str = "text", back: int = 2, together: bool = False) -> DataFrame:
    """What lexical.placed() makes of words(), from each text alone: nothing is sorted or shuffled by token. Analyses of tokens before aren't there.

    together: rows of a key come to one task before, while they are texts; what is grouped by the key later stays there. Keys are of one sample each.
    """
    df = df.select(key, text).repartition(key) if together else spread(df.select(key, text))
    # the length is a column before the words are rows, else each of these would take the list along
    df = df.select(key, forms(F.col(text)).alias("l")).withColumn("n", F.size("l").cast("long"))
    # the form k places before: the list behind k nulls
    none = F.array(F.lit(None).cast("string"))
    shifted = [F.concat(*[none] * k, F.col("l")).alias(f"form_{k}") for k in range(1, back + 1)]
    rows = df.select(key, "n", F.posexplode(F.arrays_zip(F.col("l").alias("form"), *shifted)).alias("pos", "t"))
    return rows.select(key, "n", "pos", "t.*").where("form is not null").withColumn("info", tokens.rule_analysis(F.col("form")))


def word_blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """keys, lengths (int32), forms, infos, codes (int32): samples in blocks, a row each, of which forms are the different words with the built-in analysis.

    A sample has the next `lengths` of the codes, which number its words in forms; samples without words are left out. So analyses are looked for once a word of a block, and nothing is
    shuffled by token.
    """
    rows = spread(df.select(key, text)).select(F.col(key).alias("key"), forms(F.col(text)).alias("forms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("forms").is_valid())
            keys, col = b.column("key"), b.column("forms")
            ends = col.offsets.to_numpy().astype(np.int64)
            full = np.flatnonzero(np.diff(ends))
            starts = full[np.flatnonzero(np.diff((ends[full] - ends[0]) // BLOCK, prepend=-1))]
            for x, y in zip(starts, [*starts[1:], len(b)]):
                own = full[(full >= x) & (full < y)]
                said = col.values.slice(ends[x], ends[y] - ends[x]).dictionary_encode()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (keys.take(pa.array(own)), said.dictionary)]
                packed = [pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (np.diff(ends)[own], said.indices.to_numpy())]
                yield pa.RecordBatch.from_arrays([lists[0], packed[0], lists[1], packed[1]], names=["keys", "lengths", "forms", "codes"])

    kind = df.schema[key].dataType.simpleString()
    blocks = rows.mapInArrow(run, f"keys array<{kind}>, lengths binary, forms array<string>, codes binary")
    return blocks.withColumn("infos", F.transform("forms", tokens.rule_analysis))


def block_lines(blocks: DataFrame, key: str) -> DataFrame:
    """key, lines: the token lines form{analysis} of the samples of word_blocks(), made once for each word of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                keys, line = (b.column(c)[i].values for c in ("keys", "line"))
                n, code = (np.frombuffer(b.column(c)[i].as_buffer(), "<i4") for c in ("lengths", "codes"))
                said = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), line.take(pa.array(code)))
                yield pa.RecordBatch.from_arrays([keys, pc.binary_join(said, "\n")], names=["key", "lines"])

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    line = F.zip_with("forms", "infos", lambda x, y: F.concat(x, F.lit("{"), y, F.lit("}")))
    return blocks.select("keys", "lengths", "codes", line.alias("line")).mapInArrow(run, f"key {kind}, lines string").withColumnRenamed("key", key)


def analysis_counts(samples_: DataFrame, lines: str = "lines") -> DataFrame:
    """form, info, n over what analysed() gives: equal lines are counted in each batch first, and read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = pc.list_flatten(pc.split_pattern(b.column(0), "\n")).value_counts()
            yield pa.RecordBatch.from_arrays([said.field(0), said.field(1)], names=["line", "n"])

    counts = samples_.select(F.col(lines).alias("lines")).where("lines is not null").mapInArrow(run, "line string, n long")
    counts = counts.where("line <> ''").groupBy("line").agg(F.sum("n").alias("n"))
    read = counts.select(tokens.form_of(F.col("line")).alias("form"), tokens.info_of(F.col("line")).alias("info"), "n")
    return read.groupBy("form", "info").agg(F.sum("n").alias("n"))


def analysed(samples_: DataFrame, key: str, lines: str = "lines") -> DataFrame:
    """key, pos, form, info of an external analyser's lines, one a token: form{analysis}."""
    line = samples_.select(key, F.posexplode(F.filter(F.split(lines, "\n"), lambda x: x != "")).alias("pos", "line"))
    return line.select(key, "pos", tokens.form_of(F.col("line")).alias("form"), tokens.info_of(F.col("line")).alias("info"))
