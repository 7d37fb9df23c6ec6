import random

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import blocks, markup


def texts(words, n=600):
    rng = random.Random(5)
    return ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize(
    "signs, like, words",
    [
        (blocks.TEMPLATES, markup.BRACES, ["{{", "{{", "}}", "}}", "{", "}", "a", "\n", "é"]),
        (blocks.TABLES, markup.TABLES, ["{|", "|}", "|", "{", "x", " "]),
        (blocks.elements("div"), markup.ELEMENTS["div"], ["<div>", "<DIV a='b'>", "</div>", "< / div>", "<div/>", "<divx>", "t", "<p>"]),
    ],
)
def test_like_the_cleaner(spark, signs, like, words):
    rows = [(i, t, "x", i) for i, t in enumerate(texts(words))]
    df = spark.createDataFrame(rows, "id long, text string, mark_ string, k long")
    got = {r["id"]: r for r in blocks.drop_nested(df, "id", "text", *signs).collect()}
    assert len(got) == len(rows)
    for i, t, other, k in rows:
        assert got[i]["text"] == (None if t is None else markup.drop_blocks(t, like)), t
        assert (got[i]["mark_"], got[i]["k"]) == (other, k)


def test_one_long_text_and_no_rows(spark):
    t = "{{a " * 20_000 + "mid" + "}}" * 20_000 + "end"
    df = spark.createDataFrame([(1, t)], "id int, text string")
    assert blocks.drop_nested(df, "id", "text", *blocks.TEMPLATES).first()["text"] == "end"
    assert blocks.drop_nested(df.where("false"), "id", "text", *blocks.TEMPLATES).collect() == []


def test_rows_without_marks_are_not_moved_and_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = blocks.drop_nested(df, "id", "text", *blocks.TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
