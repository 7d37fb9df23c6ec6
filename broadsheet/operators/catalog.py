"""Catalogue pages: links, counts, pagination, the category tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Links on a result page, result pages at most, links beyond which other sort orders are read as well.
PER_PAGE, MAX_PAGES, MORE_ORDERS_OVER = 10, 101, 1010


def links_count(html: Column) -> Column:
    """The number before the word for sites at the end of a heading; 0 if the page has none."""
    return F.coalesce(F.regexp_extract(html, "([0-9]+) сайт(?:ов|а)?</h2>", 1).try_cast("int"), F.lit(0))


def subcategories(html: Column, path: Column) -> Column:
    """Names under a category's path, each once, with a capital first."""
    names = F.transform(F.split(html, "/yca/cat"), lambda x: F.when(F.startswith(x, F.concat(path, F.lit("/"))), F.split_part(F.substring(x, F.length(path) + 2, F.length(x)), F.lit("/"), F.lit(1))))
    return F.filter(F.array_distinct(names), lambda x: x.rlike(r"^\p{Lu}\w*$"))


def result_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'b-result__head[^>]*>\s*<[^>]*?"(http[^"]*)"'), F.lit(1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def first_wins(links: DataFrame, link: str, order: list[str]) -> DataFrame:
    """Each link once, with the smallest of its places; partial minima go before the shuffle."""
    return links.groupBy(link).agg(F.min(F.struct(*order)).alias("first")).select(link, *[F.col(f"first.{c}").alias(c) for c in order])


def pages_of(n: Column) -> Column:
    """array<int> of result page numbers; none for no links."""
    last = F.least(F.ceil(n / PER_PAGE).cast("int"), F.lit(MAX_PAGES))
    return F.when(n > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))


def subtree_sums(tree: DataFrame) -> DataFrame:
    """parent, links: the sum of the direct children's links. tree: category, parent, links_count."""
    return tree.where("parent is not null").groupBy("parent").agg(F.sum("links_count").alias("links"))


def own_links_needed(tree: DataFrame) -> DataFrame:
    """category, read_own (more links than its children have together), more_orders."""
    sums = subtree_sums(tree).withColumnRenamed("parent", "category")
    out = tree.join(sums, "category", "left").withColumn("sub", F.coalesce("links", F.lit(0)))
    return out.select("category", ((F.col("links_count") > 0) & (F.col("links_count") > F.col("sub"))).alias("read_own"), (F.col("links_count") > MORE_ORDERS_OVER).alias("more_orders"))


def walk(tree: DataFrame) -> DataFrame:
    """category, path, level from the roots down, by joins of one level with the next; ends when a level is empty.

    A path doesn't come to a category twice, so a cycle ends there.
    """
    level = tree.where("parent is null").select("category", F.col("category").alias("path"), F.array("category").alias("seen"), F.lit(0).alias("level"))
    out, k = level, 0
    while not level.isEmpty():
        k += 1
        up = level.select(F.col("category").alias("parent"), "path", "seen")
        level = tree.join(up, "parent").where(~F.array_contains("seen", F.col("category")))
        level = level.select("category", F.concat_ws("/", "path", "category").alias("path"), F.array_append("seen", F.col("category")).alias("seen"), F.lit(k).alias("level"))
        out = out.unionByName(level)
    return out.drop("seen")
