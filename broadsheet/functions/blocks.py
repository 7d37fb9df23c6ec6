"""Nested blocks taken out by SQL functions and windows: marks, a running depth, and the text outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What opens and closes templates and tables.
TEMPLATES, TABLES = (r"\{\{", r"\}\}"), (r"\{\|", r"\|\}")


def elements(tag: str) -> tuple[str, str]:
    """What opens and closes an element; attributes may not hold a slash."""
    return rf"(?i:<\s*{tag}\b[^>/]*>)", rf"(?i:<\s*/\s*{tag}>)"


def drop_nested(df: DataFrame, key: str, text: str, opens: str, closes: str) -> DataFrame:
    """df with the outermost blocks of a text column taken out, nested ones with them; key tells rows apart.

    A closer outside of all blocks is text. A block that lacks closers ends at the last closer after its opener, and isn't one
    if there is none. Patterns have no groups. Rows without an opener, and null texts, stay as they are and aren't moved.

    Each mark becomes a row with the text after it. The depth is the running sum of openers less closers, above its lowest
    point so far, as closers at depth 0 count for nothing. A text's parts outside of blocks are joined again in order.
    """
    others = [c for c in df.columns if c not in (key, text)]
    has = F.coalesce(F.col(text).rlike(opens), F.lit(False))
    either = f"{opens}|{closes}"
    marks = df.where(has).select(
        key, F.struct(*[F.col(c) for c in others], F.lit(0).alias("none_")).alias("rest_"), F.regexp_extract_all(text, F.lit(either), F.lit(0)).alias("marks_"), F.split(text, either, -1).alias("parts_")
    )
    rows = marks.select(key, "rest_", F.get("parts_", F.lit(0)).alias("head_"), F.posexplode(F.arrays_zip("marks_", F.slice("parts_", 2, F.size("marks_")).alias("after_"))).alias("k_", "x_"))
    # what doesn't belong to a mark travels with the first one
    first = F.col("k_") == 0
    rows = rows.select(key, "k_", F.when(first, F.col("rest_")).alias("rest_"), F.when(first, F.col("head_")).alias("head_"), F.col("x_.marks_").alias("mark_"), F.col("x_.after_").alias("after_"))
    way = Window.partitionBy(key).orderBy("k_")
    whole = Window.partitionBy(key)
    step = F.when(F.col("mark_").rlike(f"^(?:{opens})$"), 1).otherwise(-1)
    rows = rows.withColumn("step_", step).withColumn("sum_", F.sum("step_").over(way))
    rows = rows.withColumn("depth_", F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(way)))
    rows = rows.withColumn("before_", F.coalesce(F.lag("depth_").over(way), F.lit(0)))
    start = (F.col("step_") == 1) & (F.col("before_") == 0)
    rows = rows.withColumn("start_", F.max(F.when(start, F.col("k_"))).over(way)).withColumn("last_", F.max("k_").over(whole))
    rows = rows.withColumn("open_", F.max(F.when((F.col("k_") == F.col("last_")) & (F.col("depth_") > 0), F.col("start_"))).over(whole))
    # the block that lacks closers, if a text has one, and its last closer
    inside = F.coalesce(F.col("start_") == F.col("open_"), F.lit(False)) & (F.col("k_") >= F.col("open_"))
    rows = rows.withColumn("inside_", inside)
    rows = rows.withColumn("end_", F.coalesce(F.max(F.when(F.col("inside_") & (F.col("step_") == -1), F.col("k_"))).over(whole), F.lit(-1)))
    beyond = F.col("inside_") & (F.col("k_") > F.col("end_"))
    mark = F.when(beyond | ((F.col("step_") == -1) & (F.col("before_") == 0)), F.col("mark_")).otherwise("")
    after = F.when(beyond | (F.col("depth_") == 0) | (F.col("inside_") & (F.col("k_") == F.col("end_"))), F.col("after_")).otherwise("")
    kept = rows.select(key, "k_", "rest_", F.concat(F.coalesce("head_", F.lit("")), mark, after).alias("kept_"))
    joined = kept.groupBy(key).agg(F.first("rest_", ignorenulls=True).alias("rest_"), F.array_sort(F.collect_list(F.struct("k_", "kept_"))).alias("x_"))
    out = joined.select(key, F.concat_ws("", F.transform("x_", lambda x: x["kept_"])).alias(text), *[F.col(f"rest_.`{c}`").alias(c) for c in others])
    return df.where(~has).unionByName(out.select(*df.columns))
