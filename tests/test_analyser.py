import sys

import pytest

from broadsheet.operators import analyser, samples

#: A local program in place of an analyser: a line for each word, written out when a mark comes, and a lot of noise for "loud".
PROGRAM = """
import sys
for line in sys.stdin:
    for w in line.split():
        print(w + "{" + w.lower() + ("??" if w.isdigit() else "=S") + "}")
        if w == "loud":
            print("x{x=S}\\n" * 20000, end="")
        if w == "die":
            sys.exit(3)
        if w == "partSeparator":
            sys.stdout.flush()
"""


@pytest.fixture()
def command(tmp_path):
    (tmp_path / "program.py").write_text(PROGRAM)
    return [sys.executable, str(tmp_path / "program.py")]


def test_samples_are_put_together_again(spark, command):
    texts = ["Some words 12 here", None, "", " \n ", "word " * 500, "loud " * 30, "last\nof all"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, texts[0])], "doc_id long, text string").repartition(2)
    got = analyser.piped(df, "doc_id", "text", command, limit=60)
    rows = sorted(((r["doc_id"], r["lines"]) for r in got.collect()), key=str)
    say = lambda t: [w + "{" + w.lower() + ("??" if w.isdigit() else "=S") + "}" for w in (t or "").split()]
    want = [(i, "\n".join(say(t) if i != 5 else (say("loud") + ["x{x=S}"] * 20000) * 30)) for i, t in enumerate(texts)] + [(None, "\n".join(say("no id"))), (0, "\n".join(say(texts[0])))]
    assert rows == sorted(want, key=str)
    forms = samples.analysed(got, "doc_id").where("doc_id = 6").orderBy("pos").collect()
    assert [(r["form"], r["info"]) for r in forms] == [("last", "last=S"), ("of", "of=S"), ("all", "all=S")]


@pytest.mark.parametrize("text, said", [("please die now " * 50, "ended"), ("a partSeparator b", "mark")])
def test_what_goes_wrong_is_told(spark, command, text, said):
    with pytest.raises(Exception, match=said):
        analyser.piped(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", command, limit=40).collect()


def test_chunks():
    assert list(analyser.chunks("", 5)) == [(0, "")]
    assert list(analyser.chunks("ab cd ef\tgh", 4)) == [(0, "ab "), (1, "cd "), (2, "ef\t"), (3, "gh")]
    assert "".join(c for _, c in analyser.chunks(" x" * 10, 3)) == " x" * 10
    with pytest.raises(ValueError):
        list(analyser.chunks("abcdefgh", 4))


def test_chunks_in_sql(spark):
    analyser.register(spark)
    spark.createDataFrame([(1, "ab cd ef"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("chunked_docs")
    rows = spark.sql("SELECT d.id, c.part, c.chunk FROM chunked_docs d, LATERAL text_chunks(d.text, 4) c ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "ab "), (1, 1, "cd "), (1, 2, "ef"), (3, 0, "")]
