import __spark_entry__ as entry
from pyspark.sql import functions as F

from broadsheet.operators import samples
from broadsheet.sources import readers


def test_lines_are_made_and_counted_like_tokens(spark):
    docs = spark.createDataFrame([(0, "One of One, nation"), (1, None), (2, " - "), (3, "of é")], "doc_id long, text string").repartition(2)
    made = samples.block_lines(samples.word_blocks(docs, "doc_id"), "doc_id")
    want = samples.words(docs, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("form", F.lit("{"), "info", F.lit("}"))))).alias("x"))
    got = {r["doc_id"]: r["lines"].split("\n") for r in made.collect()}
    assert got == {r["doc_id"]: [x[1] for x in r["x"]] for r in want.collect()} and set(got) == {0, 3}
    more = made.unionByName(spark.createDataFrame([(4, "a{x{y}\n\na{x{y}"), (5, None), (6, "")], "doc_id long, lines string"))
    counts = samples.analysis_counts(more)
    plain = samples.analysed(more, "doc_id").groupBy("form", "info").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_records_of_odd_lines(spark, tmp_path):
    """Records end at lines without a brace, empty ones too; there is no window or sort over lines."""
    (tmp_path / "a").write_text("\n\na{a=S}\nend\n\nb{b=S}\nc{c\nno brace}\n" + readers.SEPARATOR + "\nfirst\nd{}\n}\n}{\n" + readers.SEPARATOR + "\nonly\n")
    rows = readers.analysed_records(spark, f"{tmp_path}/a")
    found = rows.collect()
    assert sorted(r["lines"] for r in found) == ["a{a=S}", "b{b=S}\nc{c", "d{}", "}{"] and len({r["sample_id"] for r in found}) == 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_a_stream_moves_no_texts(spark):
    plan = entry.queries()["lexeme_stream"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
