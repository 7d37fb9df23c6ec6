"""Queries that write a given table in a format for other tools and read it again; their SQL is the table itself."""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import functions as F

from broadsheet.operators import analyser, catalog, embed, samples
from broadsheet.plans.catalogue import query, table
from broadsheet.plans.queries import ANALYSED, LOW, docs, known_of, lexemes_of, spoken
from broadsheet.sources import packed, readers, runs, writers
from broadsheet.sources.tables import Tables


def folder(spark, name: str) -> str:
    return f"{Tables(spark, name).at}/{name}"


ESCAPED = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("dump_round_trip", f"SELECT url AS title, 0 AS ns, {ESCAPED} AS raw_text FROM pages WHERE page_id % 3 = 0 AND html <> ''")
def dump_round_trip(spark, sf_dir):
    """Pages of three namespaces; articles come back."""
    at = folder(spark, "dump")
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("title"), (F.col("page_id") % 3).cast("int").alias("ns"), F.col("html").alias("text"))
    writers.wiki_dump(pages, at)
    return readers.wiki_dump(spark, at).where("ns = 0").select("title", "ns", "raw_text")


@query("ad_corpus_round_trip", "SELECT url AS source, html || chr(10) AS text FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def ad_corpus_round_trip(spark, sf_dir):
    at = folder(spark, "ads")
    writers.ad_corpus(table(spark, sf_dir, "pages").where("url is not null and html is not null").select(F.col("url").alias("source"), F.col("html").alias("text")), at)
    return readers.ad_corpus(spark, at)


@query("samples_round_trip", "SELECT doc_id::VARCHAR AS title, rtrim(text, ' ') AS text FROM documents WHERE text IS NOT NULL")
def samples_round_trip(spark, sf_dir):
    at = folder(spark, "samples")
    writers.samples(docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").cast("string").alias("title"), "text"), at)
    return readers.samples(spark, at)


@query("set_index_round_trip", "SELECT quality AS label, source || chr(10) || doc_id AS source FROM labels JOIN documents USING (doc_id)")
def set_index_round_trip(spark, sf_dir):
    """Sources of two lines."""
    at = folder(spark, "index")
    writers.set_index(indexed(spark, sf_dir), at)
    return readers.set_index(spark, at)


def indexed(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return both.select(F.col("quality").alias("label"), F.concat_ws("\n", "source", F.col("doc_id").cast("string")).alias("source"))


@query("set_rows_by_label", "SELECT source || chr(10) || doc_id AS source, count(*) FILTER (quality = 1) OVER () AS n FROM labels JOIN documents USING (doc_id) WHERE quality = 1")
def set_rows_by_label(spark, sf_dir):
    """Rows of one label by their place in the index; places are all different."""
    at = folder(spark, "index")
    writers.set_index(indexed(spark, sf_dir), at)
    found = readers.set_rows(spark, at, 1)
    n = found.agg(F.count_distinct("ordinal").alias("n"))
    return found.join(F.broadcast(n)).select("source", "n")


@query("vocabulary_round_trip", f"WITH {LOW}, c AS (SELECT w, count(*) AS n FROM low GROUP BY w HAVING count(*) >= 23 ORDER BY n DESC, w LIMIT 25000) SELECT w AS feature, (row_number() OVER (ORDER BY n DESC, w) - 1)::INT AS idx FROM c")
def vocabulary_round_trip(spark, sf_dir):
    """Through a run's folder, where its hash is noted and checked."""
    run = runs.new_run(spark, folder(spark, "runs"))
    ids = embed.ranked(embed.word_counts(lexemes_of(spark, sf_dir)))
    runs.save_vocabulary(spark, run, ids.select(F.col("word").alias("feature"), F.col("id").cast("int").alias("idx")))
    return runs.load_vocabulary(spark, run)


@query(
    "vectors_round_trip",
    "SELECT 'w' || vec_id AS word, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS idx, round(list_sum(list_transform(embedding[1:20], lambda x: x::DOUBLE)), 5) AS total, round(embedding[20]::DOUBLE, 6) AS last FROM embeddings",
)
def vectors_round_trip(spark, sf_dir):
    at = folder(spark, "vectors")
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.slice("embedding", 1, embed.DIMENSIONS).alias("vec"), "vec_id")
    writers.vectors(e, at, "vec_id")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return readers.vectors(spark, at, unknown="w0").select("word", "idx", F.round(total, 5).alias("total"), F.round(F.element_at("vec", -1).cast("double"), 6).alias("last"))


@query(
    "dense_matrix_round_trip",
    "SELECT doc_id, quality AS label, n_chars::DOUBLE AS size, lang = 'en' AS missing FROM labels JOIN documents USING (doc_id)",
)
def dense_matrix_round_trip(spark, sf_dir):
    """A null is missing, and NaN in the matrix."""
    at = folder(spark, "dense")
    both = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    rows = both.select("doc_id", F.col("quality").alias("label"), F.array(F.col("n_chars").cast("double"), F.when(F.col("lang") != "en", 1.0)).alias("features"))
    writers.dense_matrix(rows, at)
    return runs.matrix(spark, at).select("doc_id", "label", F.get("features", F.lit(0)).alias("size"), F.isnan(F.get("features", F.lit(1))).alias("missing"))


@query("libsvm_round_trip", "SELECT quality::DOUBLE AS label, n_chars::DOUBLE AS size, toxic::DOUBLE AS toxic FROM labels JOIN documents USING (doc_id)")
def libsvm_round_trip(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    at = folder(spark, "libsvm")
    both = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    writers.libsvm(both.select(F.col("quality").alias("label"), array_to_vector(F.array(F.col("n_chars").cast("double"), F.col("toxic").cast("double"))).alias("features")), at)
    values = vector_to_array("features")
    return spark.read.format("libsvm").option("numFeatures", 2).load(at).select("label", values[0].alias("size"), values[1].alias("toxic"))


@query(
    "packed_round_trip",
    f"""WITH {LOW}, c AS (SELECT w, count(*) AS n FROM low GROUP BY w HAVING count(*) >= 23 ORDER BY n DESC, w LIMIT 25000),
ids AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS id FROM c),
r AS (SELECT doc_id, count(*)::INT AS len, string_agg(coalesce(id, 65535)::VARCHAR, ' ' ORDER BY pos) AS ids FROM low LEFT JOIN ids USING (w) GROUP BY doc_id)
SELECT quality AS label, coalesce(len, 0) AS len, coalesce(ids, '') AS ids FROM labels JOIN documents USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def packed_round_trip(spark, sf_dir):
    """Labelled samples as packed records, which the data source pads and reads without pads."""
    packed.register(spark)
    at, known = folder(spark, "packed"), known_of(spark, sf_dir)
    ids = F.broadcast(spark.createDataFrame(list(known.items()), "word string, id int"))  # a vocabulary's size
    words = embed.encoded(lexemes_of(spark, sf_dir), ids, "doc_id", 65535, 0, length=0)
    labelled = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id"), "doc_id").join(words, "doc_id", "left")
    labelled.select(F.col("quality").alias("label"), "ids").write.format("packed").mode("append").save(at)
    return spark.read.format("packed").load(at).select("label", "len", F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


@query("lexeme_file", f"WITH {LOW} SELECT string_agg(w, ' ' ORDER BY pos) AS line FROM low GROUP BY doc_id")
def lexeme_file(spark, sf_dir):
    at = folder(spark, "lexemes")
    writers.lexeme_stream(spoken(spark, sf_dir).select(F.col("words").alias("lexemes")), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


TOKENS_READ = f"WITH {ANALYSED} SELECT form, info, count(*) AS n FROM an GROUP BY ALL"


def analysed_file(spark, sf_dir, name: str) -> str:
    at = folder(spark, name)
    rows = samples.block_lines(samples.word_blocks(docs(spark, sf_dir), "doc_id"), "doc_id")
    writers.analysed(rows.select("lines"), at)
    return at


@query("analysed_round_trip", TOKENS_READ)
def analysed_round_trip(spark, sf_dir):
    """An analyser's lines, framed by the separator."""
    rows = readers.analysed_samples(spark, analysed_file(spark, sf_dir, "analysed"))
    return samples.analysis_counts(rows)


@query("analysed_records_round_trip", TOKENS_READ)
def analysed_records_round_trip(spark, sf_dir):
    """The same by the rule that any line without a brace ends a sample."""
    rows = readers.analysed_records(spark, analysed_file(spark, sf_dir, "records"))
    return samples.analysis_counts(rows)


#: A small analyser that any Python has: a line for each run of letters, and all lines when a mark has come.
ANALYSER = r"""
import re, sys
for line in sys.stdin:
    for w in re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]+", line):
        print(w + "{" + w.lower() + "=S}")
    if line.strip() == "partSeparator":
        sys.stdout.flush()
"""


@query(
    "piped_analysis",
    "SELECT form, lower(form) || '=S' AS info, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS form FROM documents) GROUP BY ALL",
)
def piped_analysis(spark, sf_dir):
    """Every whole text through a process of each task, in chunks of 40 000 characters at most."""
    lines = analyser.piped(samples.spread(docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", [sys.executable, "-X", "utf8", "-c", ANALYSER])
    return samples.analysis_counts(lines)


@query("result_links", "SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, url AS link, min(page_id) AS first_page FROM pages WHERE contains(url, 'http') GROUP BY ALL")
def result_links(spark, sf_dir):
    """A result page for each host, made of the pages' addresses; its links, each once, from the first page that has it."""
    pages = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("http"))).select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), "url")
    shown = pages.withColumn("html", F.concat(F.lit('<h2 class="b-result__head"><a href="'), "url", F.lit('">x</a></h2> <a href="http://other">y</a>')))
    links = shown.select("host", "page_id", F.explode(catalog.result_links(F.col("html"))).alias("link"))
    return catalog.first_wins(links, "link", ["page_id", "host"]).select("host", "link", F.col("page_id").alias("first_page"))


@query("shards_round_trip", "SELECT doc_id::VARCHAR AS title, 'shard=' || ((row_number() OVER (ORDER BY doc_id) - 1) % 8) AS shard FROM documents WHERE text IS NOT NULL")
def shards_round_trip(spark, sf_dir):
    """Samples dealt out to eight shards, which are found again by their names."""
    at = folder(spark, "shards")
    writers.shards(docs(spark, sf_dir).where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("title"), "text"), at, "doc_id")
    out = None
    for path in runs.shards(spark, at, prefix="shard="):  # as many as there are shards
        own = readers.samples(spark, path).select("title", F.lit(path.rpartition("/")[2]).alias("shard"))
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "run_notes",
    """WITH r AS (SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d-%H-%M') AS run FROM events GROUP BY event_type)
SELECT run, event_type, n, (dense_rank() OVER (ORDER BY run DESC))::INT AS place FROM r""",
)
def run_notes(spark, sf_dir):
    """A run for each kind of event, dated by its first one; what is noted at the runs, the newest first. Runs without notes don't count."""
    root = folder(spark, "dated")
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    for r in kinds.collect():  # a few kinds
        runs.note(spark, runs.new_run(spark, root, r["first"]), **{r["event_type"]: r["n"]})
    runs.new_run(spark, root, datetime(2001, 1, 1))
    found = [(r["name"], kind, n, k + 1) for k, r in enumerate(runs.runs(spark, root, ("info",)).collect()) for kind, n in runs.notes(spark, f"{root}/{r['name']}").items()]
    return spark.createDataFrame(found, "run string, event_type string, n long, place int")
