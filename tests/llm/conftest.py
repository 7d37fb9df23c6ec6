import pytest

from broadsheet.llm.common import Scratch

TEXTS = {
    "null": None, "empty": "", "blank": " \n\t ", "word": "Word", "short": "one two three.", "lines": "a b c d\na b c d\nx = y\n\n", "wide": "été 漢字 🙂 İ ẞ ǅ ́ \x85 \x1f ﬁ",
    "marks": "<|im_end|><|im_start|>x <\\|a <|endoftext|> <|startoftext|>", "runs": "aaaa " * 400, "long": "the quick brown fox jumps over it. " * 9000, "one": "z" * 60_000,
}


@pytest.fixture()
def scratch(spark, request):
    return Scratch(spark, request.node.name.split("[")[0])


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated rows, ids that tie or are null, and columns with names that clash."""
    rows = [(i, t) for i, t in enumerate(TEXTS.values())]
    rows += [rows[5], rows[5], (40, TEXTS["lines"]), (None, "no id at all"), (41, TEXTS["long"])]
    extra = "key string, id long, hash long, size long, n string, shard int, slot int, bucket int, rendered string, words string, row long, first long, marks string"
    return spark.createDataFrame([(i, t, "en", "s" if i != 3 else None, len(t or ""), *["x" if "string" in k else 1 for k in extra.split(", ")]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
