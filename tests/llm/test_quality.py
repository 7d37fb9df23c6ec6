import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.llm import quality
from broadsheet.llm.common import Scratch

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b#é\x85\xa0", max_size=60), min_size=1, max_size=25))
def test_counts(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in quality.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_odd_rows(odd, nothing, scratch):
    got = quality.judge(odd, scratch)
    rows = {(r["doc_id"], r["key"]): r for r in got.collect()}
    assert got.count() == odd.count()
    for r in odd.withColumn("k", quality.key_of(F.coalesce("text", F.lit("")))).select("doc_id", "text", "k").collect():
        x = rows[r["doc_id"], r["k"]]
        assert tuple(x[c] for c in BASE) == brute(r["text"])
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
    assert quality.judge(nothing, scratch.__class__(scratch.spark, "e")).count() == 0


def spell(n):
    """A number in letters, as digits count alike in lines."""
    return "".join(chr(97 + int(c)) for c in str(n))


def host(own, n, shared, every):
    words = lambda i, k: " ".join(f"w{spell(i)}x{spell(j)}" for j in range(k))
    return [(i, (shared + "\n" if i % every == 0 else "") + words(i, own), "h1") for i in range(n)]


def test_common_lines_deplete_and_spare(spark):
    line = " ".join(f"common{spell(j)}" for j in range(60))
    rows = host(70, 200, line, 4)  # 50 of 200 texts have the line, and 70 of their own words
    rows += [(1000, line + "\nA few  words only", "h1"), (1001, line.upper() + "\na few words only", "h1"), (1002, line + "\nA few words only", "h2"), (1003, line, None)]
    copies = [(2000 + i, " ".join(f"copy{spell(j)}" for j in range(80)), "h1") for i in range(300)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df, Scratch(spark, "j")).collect()}
    assert all(got[i]["kept"] for i in range(200)), "documents with enough of their own stay"
    assert not got[1000]["kept"] and not got[1001]["kept"] and got[1000]["left_words"] == 4
    assert got[1002]["kept"] and got[1003]["kept"], "the line is rare on these hosts"
    assert not any(got[2000 + i]["kept"] for i in range(300)), "each copy is a document that has the line"
    once = {r["doc_id"]: r for r in quality.judge(df, Scratch(spark, "o"), copies_count=False).collect()}
    assert all(once[2000 + i]["kept"] for i in range(300)), "copies count as one text"
    assert not once[1000]["kept"] and once[1002]["kept"]


def test_rows_that_repeat_are_one_document(spark):
    line = " ".join(f"common{spell(j)}" for j in range(60))
    rows = host(70, 200, "", 1) + [(1000, line, "h1")] * 40 + [(None, line + " x", "h1")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judge(df, Scratch(spark, "r")).where("doc_id = 1000 or doc_id is null").collect()
    assert len(got) == 80 and all(r["kept"] for r in got)


def test_common_lines_go_from_the_texts(spark, monkeypatch):
    import corpus_pipeline

    line = "Read 12 more on  this page"
    own = {i: " ".join(f"w{spell(i)}x{spell(j)}" for j in range(60)) for i in range(100)}
    rows = [(i, f"{line}\n{own[i]}\n\n {line.upper().replace('12', '7')} \nend {spell(i)}" if i < 40 else own[i], "en", "h", 1) for i in range(100)]
    rows += [(200, f"{line}\n{own[0]} more", "en", "other", 1), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted((i, f"{own[i]}\n\nend {spell(i)}" if i < 40 else t) for i, t, *_ in rows)
    for few in (quality.BROADCAST_ROWS, 0):  # a host's lines by broadcast, and each text's by a join
        monkeypatch.setattr(quality, "BROADCAST_ROWS", few)
        rules = quality.judge(df, Scratch(spark, f"c{few}")).where("kept")
        assert sorted((r["doc_id"], r["text"]) for r in rules.collect()) == want
        got = corpus_pipeline.quality_rules(spark, df, "").collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == want
        assert all(r["n_chars"] == (len(r["text"]) if r["doc_id"] < 40 else 1) for r in got)
