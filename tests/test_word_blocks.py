import pytest
from pyspark.sql import functions as F

from broadsheet.functions.tokens import CYRILLIC, LATIN
from broadsheet.operators import lexical, samples

TEXTS = [
    "One of the best, one OF the and the; of the", "", None, "  12 -- ", "single", "качество из мир testing самый", "in the and in the and Nation's слово wordéß longest international" + "x" * 20,
    "𝒳𝒴 漢字 ǅ nation ﬁne", "the of", "of\nthe", "x" * 70 + " é ing sing",
]
TWO, THREE = [("of", "the"), ("in", "the"), ("the", "of")], [("one", "of", "the"), ("in", "the", "and")]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(params=[500_000, 3])
def docs(spark, request, monkeypatch):
    monkeypatch.setattr(samples, "BLOCK", request.param)
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3, "doc_id")


@pytest.mark.parametrize("script", [LATIN, CYRILLIC])
def test_like_a_row_for_each_token(docs, script):
    """Features, raw counts, phrases and bigrams of blocks are those of the tokens, whatever a block holds."""
    blocks, toks = samples.word_blocks(docs, "doc_id"), samples.placed_words(docs, "doc_id")
    cols = ("doc_id", "feature", "value")
    assert rows(lexical.block_features(blocks, "doc_id", script, [TWO, THREE]), *cols) == rows(lexical.features(toks, "doc_id", script, TWO, THREE), *cols)
    assert rows(lexical.block_features(blocks, "doc_id", script, shares=False), *cols) == rows(lexical.token_features(toks, "doc_id", script), *cols)
    assert rows(lexical.block_features(blocks, "doc_id", script, [TWO, THREE], marks=False), *cols) == rows(lexical.phrase_counts(toks, "doc_id", [TWO, THREE], script), *cols)
    pairs = lexical.placed_ngrams(toks, "doc_id", 2, script).groupBy("s0", "s1").agg(F.count("*").alias("n"))
    assert rows(lexical.block_bigrams(blocks, script), "s0", "s1", "n") == rows(pairs, "s0", "s1", "n")


def test_a_word_is_analysed_once_a_block(docs, spark):
    """100 texts of two words make one block, of two forms."""
    again = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same same words").alias("text")).coalesce(1)
    got = samples.word_blocks(again, "doc_id").select(F.explode("forms").alias("form")).count()
    assert got == {500_000: 2, 3: 200}[samples.BLOCK]
    assert samples.word_blocks(docs.where("false"), "doc_id").count() == 0
