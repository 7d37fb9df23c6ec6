"""Exact dedup by an extendible-hash index in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_keys, normal_space

#: Distinct keys that a bucket may have before its directory entry doubles.
BUCKET_KEYS = 20_000
#: The driver's part of the directory has 2 ** MIN_DEPTH entries at most, whatever the input; below a full one tasks go on, until
#: there are some times as many cells as buckets of keys are needed.
MIN_DEPTH, SPARE_DEPTH = 14, 3
#: Cells below full entries that may be broadcast; more are joined by a shuffle.
BROADCAST_ENTRIES = 1 << 18
#: Hashes with more than one row are broadcast up to this count (16 MB), and joined by a shuffle beyond it.
BROADCAST_KEYS = 2_000_000


def sha_of(text: Column) -> Column:
    return F.sha2(normal_space(text).cast("binary"), 256)


def cell_of(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def cell_counts(keys: DataFrame, depth: int) -> DataFrame:
    return keys.groupBy(cell_of(depth).alias("cell")).agg(F.count("*").alias("n"))


def grow(cells: dict[int, int], bucket_keys: int, max_depth: int) -> list[tuple[int, int]]:
    """Per entry (hash prefix of the global depth): the bucket's prefix and local depth.

    Grows as insertion would leave it: while a bucket holds too many keys, it splits by the next bit; where its local
    depth is the global one, the directory doubles.
    """
    counts = [dict() for _ in range(max_depth)] + [cells]
    for d in range(max_depth - 1, -1, -1):
        for cell, n in counts[d + 1].items():
            counts[d][cell >> 1] = counts[d].get(cell >> 1, 0) + n
    depth, entries = 0, [(0, 0)]
    while True:
        full = {e for e in entries if e[1] < max_depth and counts[e[1]].get(e[0], 0) > bucket_keys}
        if not full:
            return entries
        if any(local == depth for _, local in full):
            entries = [e for e in entries for _ in range(2)]
            depth += 1
        entries = [(i >> (depth - e[1] - 1), e[1] + 1) if e in full else e for i, e in enumerate(entries)]


def directory(keys: DataFrame, bucket_keys: int, max_depth: int) -> list[tuple[int, int]]:
    """The directory of keys, from one aggregation of at most 2 ** max_depth rows."""
    return grow({r["cell"]: r["n"] for r in cell_counts(keys, max_depth).collect()}, bucket_keys, max_depth)


def below(keys: DataFrame, full: list[int], bucket_keys: int, top: int, depth: int) -> DataFrame:
    """Per cell of `depth` bits under the full entries of `top` bits: its bucket, by its first cell.

    Buckets split by the next bit like those above, but in the tasks that have a full entry's cells. Only the full
    entries, 2 ** top at most, come from the driver.
    """
    entries = F.broadcast(keys.sparkSession.createDataFrame([(f,) for f in full], "top long"))
    cells = cell_counts(keys, depth).withColumn("top", F.shiftrightunsigned("cell", depth - top))
    cells = cells.join(entries, "top").repartition("top").withColumn("bucket", F.lit(None).cast("long"))
    for d in range(top + 1, depth + 1):
        cells = cells.withColumn("prefix", F.shiftrightunsigned("cell", depth - d))
        held = F.sum("n").over(Window.partitionBy("top", "prefix"))
        settled = (held <= bucket_keys) if d < depth else F.lit(True)
        cells = cells.withColumn("bucket", F.coalesce("bucket", F.when(settled, F.shiftleft("prefix", depth - d))))
    return cells.select("cell", "bucket")


def owned(keys: DataFrame, n_keys: int, bucket_keys: int) -> DataFrame:
    """keys with their bucket, by the number of its first cell."""
    spark = keys.sparkSession
    depth = max(MIN_DEPTH, (n_keys // bucket_keys).bit_length() + SPARE_DEPTH)
    counts = {r["cell"]: r["n"] for r in cell_counts(keys, MIN_DEPTH).collect()}
    entries = grow(counts, bucket_keys, MIN_DEPTH)
    full = sorted(c for c, n in counts.items() if n > bucket_keys) if depth > MIN_DEPTH else []
    spread = len(entries).bit_length() - 1
    known = set(full) if spread == MIN_DEPTH else set()
    look = spark.createDataFrame([(i, None if i in known else p << (depth - d)) for i, (p, d) in enumerate(entries)], "entry long, bucket long")
    out = keys.withColumn("entry", cell_of(spread)).join(F.broadcast(look), "entry").drop("entry")
    if not full:
        return out
    deep = below(keys, full, bucket_keys, MIN_DEPTH, depth).withColumnRenamed("bucket", "deeper")
    deep = F.broadcast(deep) if 1 << depth <= BROADCAST_ENTRIES else deep
    out = out.withColumn("cell", cell_of(depth)).join(deep, "cell", "left")
    return out.withColumn("bucket", F.coalesce("bucket", "deeper")).drop("cell", "deeper")


def dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256 of the text with each run of white space as one space.

    Texts are equal when these forms are, byte by byte; hashes only say which to compare. Rows with an equal text
    form a group; the row with its smallest id stays, in one row even if rows repeat. Null texts count as empty; null
    ids come after all others. Columns other than id and text are not read. An empty table gives no rows.

    1. The index: fingerprints are written to the shared folder. Rows of one key are summed up before they move. The
       directory says which bucket has a key, and each owner task has whole buckets, written in their order. An entry has
       its key's smallest id and number of rows, which is the group unless hashes collide. The driver sees the
       directory's upper 2 ** MIN_DEPTH entries at most; full ones are split further by tasks.
    2. A chain holds the rows of one hash. Texts are read again only for hashes with more than one row. The members,
       split over tasks as need be, are compared with the text at the head of their chain; those that differ make the
       next chain of that hash, until none is left.
    """
    norm = normal_space(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"))
    rows = scratch.keep(rows.select("id", hash_of("norm").alias("hash"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "rows")
    keys = scratch.keep(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("keep_id")), "keys")
    index = scratch.keep(owned(keys, keys.count(), bucket_keys).repartition("bucket").sortWithinPartitions("bucket", "hash"), "index")
    chained = scratch.keep(index.where("n > 1").select("hash"), "chained")
    near = F.broadcast(chained) if chained.count() <= BROADCAST_KEYS else chained
    left = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm")).withColumn("hash", hash_of("norm"))
    left = scratch.keep(left.join(near, "hash", "left_semi"), "chain0")
    link, others = 0, None
    while True:
        heads = left.groupBy("hash").agg(F.min("norm").alias("head"))
        same = F.col("norm") == F.col("head")
        compared = left.join(heads, "hash").where(~same).select("id", "hash", "norm")
        rest = scratch.keep(compared, f"chain{link + 1}")
        scratch.drop(f"chain{link}")
        if rest.isEmpty():
            break
        link += 1
        deeper = rest.select("id", "hash", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.lit(link).alias("link"))
        others = scratch.keep(deeper, f"link{link}") if others is None else others.unionByName(scratch.keep(deeper, f"link{link}"))
        left = rest
    if others is None:
        member = rows.withColumn("link", F.lit(0))
    else:
        # who stayed behind in a chain has the number of the last one that it went on to
        last = others.groupBy(F.col("id").alias("i"), F.col("hash").alias("h"), F.col("sha").alias("s")).agg(F.max("link").alias("link"))
        same = F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")) & (F.col("sha") == F.col("s"))
        member = rows.join(last, same, "left").select("id", "hash", "sha", F.coalesce("link", F.lit(0)).alias("link"))
    # rows that repeat in all of this are one row with a count until the end
    member = member.groupBy("id", "hash", "sha", "link").agg(F.count("*").alias("times"))
    # an index entry is a group, as its rows are equal byte by byte; where hashes collide, each chain of them is one
    group = index.select("hash", F.lit(0).alias("link"), "keep_id", F.col("n").alias("group_size"))
    if others is not None:
        collided = others.select("hash").distinct()
        chains = by_keys(member, collided, ["hash"], "left_semi").groupBy("hash", "link")
        chains = chains.agg(F.min("id").alias("keep_id"), F.sum("times").alias("group_size"))
        group = by_keys(group, collided, ["hash"], "left_anti").unionByName(chains)
    out = member.join(group, ["hash", "link"]).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256"))
