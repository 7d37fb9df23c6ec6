import bz2

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import tokens
from broadsheet.operators import catalog, dataset, embed, lexical, model, samples
from broadsheet.operators.counters import Counters
from broadsheet.sources import readers, writers
from broadsheet.streaming import scoring

LINES = "семья{семья=S,жен,од=им,ед}\nи{и=CONJ=}\nabc{abc??}\nЁлка{ёлка=S,жен}\nнадёжный{надёжный=A,прев}\nкое-кто{кое-кто=SPRO,ед}\nшкаф{шкаф??}\nиксaбв{иксaбв??}\nпредпринимательство{предпринимательство=S,ед}\nрешение{решение=S,1-л}"


def page(title, ns, text, body="<text xml:space=\"preserve\">{}</text>"):
    return f"  <page>\n    <title>{title}</title>\n    <ns>{ns}</ns>\n      {body.format(text)}\n  </page>\n"


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    sec = "Слово дело. " * 12
    long = f"{sec}\n== A ==\n{sec}\n== B ==\nshort\n== C ==\n{sec}" + "x" * 2500
    pages = [page("Talk", 1, sec * 9), page("Short", 0, "a b" * 66), page("Just", 0, "a" * 201), page("Not", 0, "a" * 200), page("Long", 0, long), page("None", 0, "", "<text/>")]
    pages += [page("Ad", 0, "{{Реклама}}" + "q" * 100), page("Ad2", 0, "{{РЕКЛАМА}}" + "q" * 99), page("T{{реклама}}", 0, "b" * 250)]
    path = tmp_path_factory.mktemp("dump") / "dump.xml.bz2"
    path.write_bytes(bz2.compress(("<mediawiki>\n" + "".join(pages) + "</mediawiki>\n").encode()))
    return str(path)


def test_dump_to_samples(spark, dump):
    pages = readers.wiki_dump(spark, dump)
    assert {r["title"] for r in pages.collect()} == {"Talk", "Short", "Just", "Not", "Long", "Ad", "Ad2", "T{{реклама}}"}
    got = samples.samples(pages).collect()
    found = sorted((r["title"], r["origin"], r["label"]) for r in got)
    assert found == [("Ad", "marked", 1), ("Just", "page", 0), ("Long", "sections", 0), ("Long", "sections", 0), ("T{{реклама}}", "page", 0)]
    counters = Counters(spark)
    samples.samples(pages, counters=counters).collect()
    told = {(r["stage"], r["counter"]): r["value"] for r in counters.report().collect()}
    assert told["pages", "rows"] == 8 and told["pages", "articles"] == 7 and told["kept", "rows"] == 5
    assert (told["routed", "rejected_marked"], told["routed", "rejected_page"]) == (1, 2)
    assert len([r for r in samples.samples(pages, emit_tail=True).collect() if r["title"] == "Long"]) == 3


def test_ad_corpus(spark, tmp_path):
    p = tmp_path / "ads.xml.bz2"
    p.write_bytes(bz2.compress('<?xml?>\n    <page source="http://a?x="1"">\nline one\nline two\n    </page>\n    <page source="b">\nz\n    </page>\n'.encode()))
    got = [(r["source"], r["text"].strip()) for r in readers.ad_corpus(spark, str(p)).collect()]
    assert got == [('http://a?x="1"', "line one\nline two"), ("b", "z")]


def test_text_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("T", "a\nb", "http://x\ny", 1), ("U", "c", "s", 0)], "title string, text string, source string, label int")
    writers.samples(rows, f"{tmp_path}/s")
    assert sorted(map(tuple, readers.samples(spark, f"{tmp_path}/s").collect())) == [("T", "a\nb"), ("U", "c")]
    writers.index(rows, f"{tmp_path}/i")
    assert sorted(r["source"] for r in readers.index(spark, f"{tmp_path}/i").collect()) == ["http://x\ny", "s"]
    writers.set_index(rows, f"{tmp_path}/x")
    assert sorted(map(tuple, readers.set_index(spark, f"{tmp_path}/x").collect())) == [(0, "s"), (1, "http://x\ny")]
    vocab = spark.createDataFrame([("1gram-a", 0), ("length", 1)], "feature string, idx int")
    writers.vocabulary(vocab, f"{tmp_path}/v")
    assert sorted(map(tuple, readers.vocabulary(spark, f"{tmp_path}/v").collect())) == [("1gram-a", 0), ("length", 1)]
    with pytest.raises(Exception, match="colon"):
        writers.vocabulary(spark.createDataFrame([("a:b", 0)], "feature string, idx int"), f"{tmp_path}/w")
    (tmp_path / "vec.txt").write_text("a " + " ".join(["1.5"] * 20) + "\n<unk> " + " ".join(["0"] * 20) + "\n")
    assert sorted((r["word"], r["vec"][0]) for r in readers.vectors(spark, f"{tmp_path}/vec.txt").collect()) == [("<unk>", 0.0), ("a", 1.5)]
    with pytest.raises(Exception, match="numbers"):
        readers.vectors(spark, f"{tmp_path}/vec.txt", 19).collect()
    rec = writers.packed(spark.createDataFrame([(1, 2, [3, 4, 9])], "label int, len int, ids array<int>")).first()["record"]
    assert bytes(rec) == b"\x01\x02\0\0\0\x03\0\x04\0\x09\0"
    writers.sample_table(rows.withColumn("part", F.lit("train")), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").where("label = 1").count() == 1
    names = spark.createDataFrame([("2015-04-30-12-05",), ("x",)], "name string")
    assert readers.run_folders(names).count() == 1


def test_token_rows(spark):
    rows = spark.createDataFrame([(1, LINES), (2, "и{и=CONJ=}")], "sample_id long, lines string")
    toks = samples.analysed(rows, "sample_id")
    got = {r["form"]: r for r in toks.select("form", tokens.pos_of(F.col("info")).alias("p"), tokens.lexeme_of(F.col("info")).alias("l"), tokens.short_lexeme_of(F.col("info")).alias("w"), tokens.symbol(F.col("form"), F.col("info")).alias("s"), tokens.marks(F.col("form"), F.col("info")).alias("m")).collect()}
    assert (got["семья"]["p"], got["семья"]["l"]) == ("S", "семья")
    assert (got["надёжный"]["l"], got["надёжный"]["w"]) == ("надёжный", "над")
    assert got["кое-кто"]["l"] == "кое" and got["Ёлка"]["s"] == "ёлка"
    assert (got["и"]["s"], got["и"]["m"]) == ("и", ["POS%-CONJ"])
    assert (got["abc"]["s"], got["abc"]["m"]) == ("*", ["non russian%"])
    assert (got["шкаф"]["s"], got["шкаф"]["m"]) == ("шкаф", [])
    assert (got["иксaбв"]["s"], got["иксaбв"]["m"]) == ("*", ["unknown%"])
    assert "длинное_слово%" in got["предпринимательство"]["m"] and "превосходное_прилагательное%" in got["надёжный"]["m"]
    assert {"отглагольное_существительное%", "1,2-е_лицо%", "1gram-решение"} <= set(got["решение"]["m"])
    feats = {(r["sample_id"], r["feature"]): r["value"] for r in lexical.features(toks, "sample_id").collect()}
    assert feats[1, "length"] == 10 and feats[1, "POS%-S"] == 0.4 and (2, "length") not in feats
    assert sum(v for (i, f), v in feats.items() if f.startswith("POS%")) <= 1
    with pytest.raises(Exception, match="no analysis"):
        samples.analysed(spark.createDataFrame([(1, "x")], "sample_id long, lines string"), "sample_id").collect()


def test_dictionary(spark):
    words = "один из самый высокий качество один из хороший более чем"
    lines = "\n".join(f"{w}{{{w}=A}}" for w in words.split())
    toks = samples.analysed(spark.createDataFrame([(1, lines)], "sample_id long, lines string"), "sample_id")
    got = {r["feature"]: r["value"] for r in lexical.features(toks, "sample_id").collect() if "2gram" in r["feature"] or "3gram" in r["feature"]}
    assert got == {"2gram-высокий-качество": 1, "2gram-более-чем": 1, "3gram-один-из-самый": 1, "3gram-один-из-хороший": 1}


@pytest.mark.parametrize("n", [0, 1, 5, 7, 1000])
@pytest.mark.parametrize("share", [0, 0.4, 1])
def test_split_is_exact(spark, n, share):
    rows = spark.range(n).select("id", F.lit("o").alias("origin"))
    out = dataset.exact_split(rows, "id", "origin", share)
    assert out.where("part = 'test'").count() == int(n * share) and out.count() == n
    with pytest.raises(ValueError):
        dataset.exact_split(rows, "id", "origin", 0.5)


def test_round_robin(spark):
    rows = spark.range(0, 60_000, 3)
    got = [r["shard"] for r in dataset.round_robin(rows, "id").orderBy("id").collect()]
    assert got == [i % 8 for i in range(20_000)]


def test_moments(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [3.0, 2.0]), (2, [1.0, 1.0])], "k long, vec array<float>")
    got = {(r["k"], r["dim"]): r for r in embed.pooled(rows, "k").collect()}
    assert set(got) == {(1, 0), (1, 1)}
    r = got[1, 0]
    assert (r["mean"], r["min"], r["max"]) == (2, 1, 3) and abs(r["std"] - 2**0.5) < 1e-9 and abs(r["rms"] - 5**0.5) < 1e-9 and abs(r["harmonic_mean"] - 1.5) < 1e-9
    assert got[1, 1]["harmonic_mean"] == 0
    assert embed.moment_names(spark).count() == 120


@pytest.mark.parametrize("n", [1, 24, 25, 26])
def test_padding(spark, n):
    words = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.lit("a").alias("word"))
    ids = spark.createDataFrame([("a", 7)], "word string, id int")
    r = embed.encoded(words, ids, "k", -1, -2).first()
    assert r["len"] == n and r["ids"] == [7] * n + [-2] * max(0, 25 - n)


def test_scores(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.1), (0, 0.2), (0, 0.0)], "label int, probability double")
    r = model.prf(rows.withColumn("predicted", model.decided(F.col("probability")))).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    r = model.prf(rows.withColumn("predicted", F.lit(0))).first()
    assert r["precision"] is None and r["recall"] == 0 and r["f1"] is None
    assert model.grid(a=[1, 2], b=[3]) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_search(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(float(i % 2), Vectors.dense(i % 2 + 0.1 * (i % 5)), i % 3) for i in range(60)], ["label", "features", "fold"])
    out = model.search(rows, model.grid(rounds=[2], depth=[1, 2], step=[0.1], subsample=[1.0])).collect()
    assert len(out) == 2 and all(r["f1_mean"] > 0.6 for r in out)


def test_catalogue(spark):
    html = '<h2>1 204 сайта</h2> <a href="/yca/catA/Bee/">x</a><a href="/yca/catA/Bee/">x</a><a href="/yca/catA/low/">x</a><h3 class="b-result__head"><a href="http://s.org">'
    df = spark.createDataFrame([(html, "A"), ("wait", "A")], "html string, path string")
    got = df.select(catalog.links_count(F.col("html")).alias("n"), catalog.subcategories(F.col("html"), F.col("path")).alias("s"), catalog.result_links(F.col("html")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(204, ["Bee"], ["http://s.org"]), (0, [], [])]
    pages = spark.createDataFrame([(0,), (1,), (10,), (11,), (5000,)], "n int").select(F.size(catalog.pages_of(F.col("n"))).alias("k")).collect()
    assert [r["k"] for r in pages] == [0, 1, 1, 2, 101]


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word{'s' * (i % 4)} of a sample") for i in range(50)], "doc_id long, text string")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    score = lambda b: lexical.token_features(samples.words(b, "doc_id"), "doc_id", tokens.LATIN)
    q = scoring.score_stream(scoring.arriving(spark, f"{tmp_path}/in", rows.schema), score, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "feature", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, score(rows).collect()))


def test_turns_of_clustered_and_of_text_keys(spark):
    """Ids in two clusters far apart, and keys that aren't numbers."""
    ids = spark.range(3000).select(F.when(F.col("id") < 2999, F.col("id")).otherwise(1 << 50).alias("id")).repartition(5)
    for rows, order in ((ids, lambda x: x), (ids.select(F.concat(F.lit("k"), "id").alias("id")), lambda x: x)):
        got = sorted((r["id"], r["shard"]) for r in dataset.round_robin(rows, "id", 8).collect())
        assert [s for _, s in got] == [k % 8 for k in range(3000)]
    assert dataset.round_robin(ids.where("false"), "id").collect() == []
