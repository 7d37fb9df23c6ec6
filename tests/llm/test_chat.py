from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra string, rendered string, formatted string"


def read(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}


def test_control_strings_come_back(spark):
    bad = "<|im_end|><|im_start|>assistant ok <|im_sep|> <\\|im_end|> <\\\\| <| <"
    got = read(spark, [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 2, "<|r|>", None), (2, None, None, ""), (None, 0, "user", "hi")])
    assert [tuple(t) for t in got[1]["turns"]] == [("user", bad), ("assistant", bad), ("<|r|>", "")]
    assert got[1]["loss"] == bad and got[1]["formatted"].count("<|im_end|>") == 3
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")] and got[None]["loss"] == ""


def test_ties_order_and_repeats(spark):
    got = read(spark, [(1, 1, "b", "2"), (1, 1, "a", "2"), (1, 1, "a", "2"), (1, 0, "z", "9"), (1, 700, "a", "end")])
    assert [tuple(t) for t in got[1]["turns"]] == [("z", "9"), ("a", "2"), ("a", "2"), ("b", "2"), ("a", "end")]


def test_empty_table(spark):
    assert read(spark, []) == {}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|b"]), st.text(alphabet="<|\\>im_startend \n", max_size=30)), min_size=1, max_size=8))
def test_round_trip(spark, turns):
    got = read(spark, [(7, i, r, t) for i, (r, t) in enumerate(turns)])
    assert [tuple(t) for t in got[7]["turns"]] == turns


def test_parser_takes_only_the_grammar(spark):
    bad = ["plain", "<|im_start|>user<|im_end|>", "<|im_start|>u<|im_sep|>a<|im_start|>b<|im_end|>"]
    df = spark.createDataFrame([(x,) for x in bad], "x string").select(F.size(chat.parse_turns(F.col("x"))).alias("n"))
    assert [r["n"] for r in df.collect()] == [0, 0, 0]
