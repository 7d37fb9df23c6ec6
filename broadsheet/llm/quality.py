"""Quality rules: row-local counts, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, SPACE_CHARS, Scratch, let

#: A line goes from a host's documents when more than this share of the host's documents has it ...
LINE_SHARE = 0.10
#: ... and at least so many of them.
LINE_DOCS = 20
#: A document is depleted when fewer than this share of the words of its different lines is left.
LEFT_SHARE = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that the text has twice or more, each word once."""

    def count(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    def covered(g: Column) -> Column:
        by_gram = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def twice(x: Column, i: Column, s: Column) -> Column:
            before, after = F.get(s, i - 1)["g"], F.get(s, i + 1)["g"]
            return F.coalesce(before == x["g"], F.lit(False)) | F.coalesce(after == x["g"], F.lit(False))

        starts = let(by_gram, lambda s: F.transform(F.filter(s, lambda x, i: twice(x, i, s)), lambda x: x["i"]))
        starts = F.array_sort(starts)
        # each start adds the words up to the next start, three at most
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w)))


def key_of(text: Column) -> Column:
    """A text's key, of 128 bits as two hashes of it."""
    return F.concat_ws(":", F.xxhash64(text), F.xxhash64(text, F.lit(1)))


def line_of(x: Column) -> Column:
    """A line as it is compared: a hash of it in lower case with white space and digits alike, and its words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, f"{SPACE}+", " "))), "[0-9]+", "0"), " +", " ")
    return let(plain, lambda p: F.struct(F.xxhash64(p).alias("line"), (F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1).alias("words")))


def is_blank(x: Column) -> Column:
    return F.translate(x, SPACE_CHARS, "") == ""


def total_words(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + x["words"]).cast("long")


def measure(docs: DataFrame, columns: list[str] = []) -> DataFrame:  # noqa: B006
    """One narrow row per row of docs: doc_id, source, the text and its key, the base counts, its different lines, the
    hash of each line in order (blank ones are as the empty one), and a struct `own` of further columns."""
    own = F.struct(*[F.col(c) for c in columns]) if columns else F.lit(None)
    text = F.coalesce("text", F.lit(""))
    bare = F.translate("filled", SPACE_CHARS, "")
    lines = F.split("filled", "\n", -1)

    first = docs.select("doc_id", "source", "text", text.alias("filled"), own.alias("own"))
    first = first.select("doc_id", "source", "text", "own", "filled", key_of(F.col("filled")).alias("key"), F.length(bare).alias("word_chars"), (F.length("filled") - F.length(F.translate("filled", "#*$%&|<>", ""))).alias("n_symbols"), words_of(F.col("filled")).alias("words"), F.filter(lines, lambda x: ~is_blank(x)).alias("lines"), F.transform(lines, line_of).alias("marks"))
    return first.select(
        "doc_id",
        "source",
        "text",
        *(["own"] if columns else []),
        "key",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.filter(F.array_distinct("marks"), lambda x: x["line"] != F.xxhash64(F.lit(""))).alias("lines"),
        F.transform("marks", lambda x: x["line"]).alias("marks"),
    )


def judge(docs: DataFrame, scratch: Scratch, line_share: float = LINE_SHARE, line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE, columns: list[str] = [], copies_count: bool = True) -> DataFrame:  # noqa: B006
    """Per row: doc_id, key, the base counts, left_words, base_failed, kept, source, text, n_lost, and the further columns named.

    Base: under 50 words, or over half of the words in repeated windows of three, fails. Beyond it, lines are
    compared in lower case with runs of white space as one space and runs of digits as 0. A line is common to a host
    (the source column; null is a host) when more than line_share of the host's different documents, and line_docs at
    least, have it; rows that repeat an id and its text are one document. With copies_count=False, copies of a text under
    several ids are one as well, so that a text isn't rejected for its own copies, where they go afterwards. Common lines are taken out of the text that is returned, each time
    they occur (n_lost times in all; a null text stays null); the key is that of the text before. A document is rejected
    when of the words of its lines, each different line once, under left_share is left.
    Null texts count as empty, so they fail. Repeated rows are judged alike and all returned. An empty table gives no rows.

    The source text is read once, and split into lines once. A line's documents are counted from partial sums. A host's
    common lines meet its rows by a broadcast if they are few; else each text's own ones by a join. A host has fewer common
    lines than 1 / line_share times its mean number of different lines a document, so comparing all of its rows with
    them takes time in proportion to its lines.
    """
    base = scratch.keep(measure(docs, columns), "base", compression="zstd")
    host = F.coalesce("source", F.lit("")).alias("host")
    who = ["host", "key", "doc_id"] if copies_count else ["host", "key"]
    texts = base.select(host, "key", "doc_id", "lines")
    lines = texts.select(*who, F.explode("lines").alias("x")).select(*who, "x.line")
    lines = lines.distinct()
    sizes = texts.select(*who).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= line_docs)
    common = often.join(sizes, "host").where(F.col("n") > line_share * F.col("docs")).select("host", "line")
    common = scratch.keep(common, "common")
    rows = base.withColumn("host", host)
    if common.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(common.groupBy("host").agg(F.collect_list("line").alias("common"))), "host", "left")
    else:
        gone = lines.join(common, ["host", "line"]).groupBy("host", "key").agg(F.collect_set("line").alias("common"))
        rows = rows.join(scratch.keep(gone, "gone"), ["host", "key"], "left")
    rows = rows.withColumn("lost", F.when(F.col("common").isNotNull(), F.array_intersect("marks", "common")))
    stays = lambda x, i: ~F.coalesce(F.array_contains("lost", F.get("marks", i)), F.lit(False))
    some = F.coalesce(F.size("lost"), F.lit(0)) > 0
    rows = rows.withColumn("left_lines", F.when(some, F.filter(F.split("text", "\n", -1), stays)))
    changed = F.col("left_lines").isNotNull()
    clean = F.when(changed, F.array_join("left_lines", "\n")).otherwise(F.col("text")).alias("text")
    # what is left is counted on the lines that are returned
    recounted = total_words(F.array_distinct(F.transform(F.filter("left_lines", lambda x: ~is_blank(x)), line_of)))
    all_words = total_words(F.col("lines"))
    rows = rows.withColumns({"all_": all_words, "left_words": F.when(changed, recounted).otherwise(all_words)})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_lost = F.when(changed, F.size("marks") - F.size("left_lines")).otherwise(0).cast("long")
    return rows.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_words", failed.alias("base_failed"), (~failed & (F.col("left_words") >= left_share * F.col("all_"))).alias("kept"), "source", clean, n_lost.alias("n_lost"), *[F.col("own")[c].alias(c) for c in columns])
