import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import catalog, lexical, model
from broadsheet.sources import readers, runs, writers


def test_run_folders(spark, tmp_path):
    root = f"{tmp_path}/runs"
    assert runs.names_in(spark, root) == []
    for minute in (5, 7, 6):
        path = runs.new_run(spark, root, datetime(2015, 4, 30, 12, minute))
        runs.note(spark, path, features=minute, share=0.4)
        runs.note(spark, path, features=minute + 1)
        if minute != 7:
            spark.range(3).write.parquet(f"{path}/train")
    runs.new_run(spark, root, datetime(2015, 4, 30, 12, 6))
    assert [r["name"] for r in runs.runs(spark, root).collect()] == ["2015-04-30-12-07", "2015-04-30-12-06", "2015-04-30-12-05"]
    assert runs.runs(spark, root, ("train", "info")).first()["name"] == "2015-04-30-12-06"
    assert runs.notes(spark, f"{root}/2015-04-30-12-06") == {"features": 7, "share": 0.4}
    assert runs.notes(spark, f"{root}/none") == {}
    assert runs.matrix(spark, f"{root}/2015-04-30-12-06/train").count() == 3
    spark.range(0).write.parquet(f"{root}/empty")
    with pytest.raises(runs.EmptySet):
        runs.matrix(spark, f"{root}/empty")
    assert runs.shards(spark, root, "2015", "-06", most=1) == [f"{root}/2015-04-30-12-06"]


def test_ordinals_follow_the_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k % 2}\nhttp://x/{k}/{i}\n{readers.SEPARATOR}\n" for i in range(20 * (3 - k))))
    got = readers.numbered(spark, f"{tmp_path}/*.txt", readers.SEPARATOR).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(120))
    assert [r["value"].split("\n")[1] for r in got] == [f"http://x/{k}/{i}" for k in range(3) for i in range(20 * (3 - k))]
    ones = readers.set_rows(spark, f"{tmp_path}/*.txt", 1).orderBy("ordinal").collect()
    assert [tuple(r) for r in ones] == [(60 + i, f"http://x/1/{i}") for i in range(40)]


def test_vectors_and_broken_text(spark, tmp_path):
    (tmp_path / "v").write_text("unk 1 2\nb 3 4\n")
    assert [tuple(r) for r in readers.vectors(spark, f"{tmp_path}/v", 2, "unk").orderBy("idx").collect()] == [("unk", [1.0, 2.0], 0), ("b", [3.0, 4.0], 1)]
    with pytest.raises(ValueError):
        readers.vectors(spark, f"{tmp_path}/v", 2, "none")
    (tmp_path / "w").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(Exception, match="UTF-8|UTF8"):
        readers.framed(spark, f"{tmp_path}/w", "").collect()


def test_records_end_at_lines_without_analysis(spark, tmp_path):
    (tmp_path / "a").write_text(f"x{{x=A}}\ny{{y=A}}\nend\nz{{z=A}}\n{readers.SEPARATOR}\nw{{w=A}}\n{readers.SEPARATOR}\n")
    assert sorted(r["lines"] for r in readers.analysed_records(spark, f"{tmp_path}/a").collect()) == ["w{w=A}", "x{x=A}\ny{y=A}", "z{z=A}"]
    assert sorted(r["lines"].strip() for r in readers.analysed_samples(spark, f"{tmp_path}/a").collect())[0] == "w{w=A}"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", f"text {i}") for i in range(20)], "id long, title string, text string")
    writers.shards(rows, f"{tmp_path}/s", "id", 8)
    assert runs.names_in(spark, f"{tmp_path}/s")[1:] == [f"shard={k}" for k in range(8)]
    assert sorted(r["title"] for r in readers.samples(spark, f"{tmp_path}/s/shard=3").collect()) == ["t11", "t19", "t3"]
    dense = spark.createDataFrame([(1, [1.0, None]), (0, [0.0, 2.0])], "label int, features array<double>")
    writers.dense_matrix(dense, f"{tmp_path}/d")
    got = {r["label"]: r["features"] for r in spark.read.parquet(f"{tmp_path}/d").collect()}
    assert got[0] == [0.0, 2.0] and got[1][0] == 1.0 and math.isnan(got[1][1])
    packed = spark.createDataFrame([(1, 2, [7, 8, 0])], "label int, len int, ids array<int>")
    writers.packed_corpus(packed, f"{tmp_path}/p")
    assert bytes(spark.read.parquet(f"{tmp_path}/p").first()["record"]) == b"\x01\x02\x00\x00\x00\x07\x00\x08\x00\x00\x00"
    writers.lexeme_stream(spark.createDataFrame([(["a", "b"],)], "lexemes array<string>"), f"{tmp_path}/l")
    assert spark.read.text(f"{tmp_path}/l").first()["value"] == "a b"
    tree = spark.createDataFrame([("a", None, 3), ("b", "a", 2)], "category string, parent string, links_count int")
    writers.catalogue(tree, spark.createDataFrame([("http://x",)], "link string"), f"{tmp_path}/c")
    assert catalog.walk(spark.read.parquet(f"{tmp_path}/c/tree")).count() == 2


def test_deep_trees_and_cycles(spark):
    chain = [("c0", None)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 12)] + [("c3", "c11")]
    tree = spark.createDataFrame(chain, "category string, parent string")
    assert catalog.walk(tree).agg(F.max("level"), F.count("*")).first() == (11, 12)


def test_models_are_saved_with_reports(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(80).select(F.col("id").alias("ordinal"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("part"))
    rows = rows.withColumn("features", array_to_vector(F.array(F.col("label").cast("double"), F.col("ordinal").cast("double"))))
    fit = model.trees(rounds=2, depth=2).fit(rows.where("part = 'train'"))
    report = model.set_report(model.probabilities(fit, rows), 0.5)
    model.save(fit, report, f"{tmp_path}/m")
    assert {r["part"]: r["f1"] for r in spark.read.json(f"{tmp_path}/m/report").collect()} == {"test": 1.0, "train": 1.0}
    again = model.probabilities(model.load(f"{tmp_path}/m"), rows).select("ordinal", "probability")
    assert again.exceptAll(model.probabilities(fit, rows).select("ordinal", "probability")).isEmpty()
    wanted = rows.where("ordinal < 3").select("ordinal")
    assert model.row_slice(rows, wanted).count() == 3
    assert model.label_conflicts(rows, rows.where("ordinal > 0")).first()["ordinal"] == 0
    counts = spark.createDataFrame([(0, 2), (1, 1)], "idx int, splits int")
    with pytest.raises(Exception, match="no name of feature 1"):
        model.named_importance(counts, spark.createDataFrame([(0, "a b")], "idx int, feature string")).collect()


def test_a_model_is_bound_to_its_vocabulary(spark, tmp_path):
    kinds = "feature string, idx int"
    rows = [("1gram-a", 0), ("length", 1), ("2gram-a-b", 2)]
    vocab = spark.createDataFrame(rows, kinds)
    assert runs.vocabulary_hash(vocab) == runs.vocabulary_hash(spark.createDataFrame(rows[::-1], kinds).repartition(3))
    others = [rows[:2], [("1gram-a", 1), ("length", 0), rows[2]], [*rows, ("x", 3)], []]
    assert len({runs.vocabulary_hash(spark.createDataFrame(o, kinds)) for o in [rows, *others]}) == 5
    data, other, fitted = (runs.new_run(spark, f"{tmp_path}/{n}") for n in ("data", "other", "model"))
    runs.save_vocabulary(spark, data, vocab)
    runs.save_vocabulary(spark, other, spark.createDataFrame(others[1], kinds))
    # extraction with what was loaded: features that it lacks are dropped, and numbers stay
    loaded = runs.load_vocabulary(spark, data)
    feats = spark.createDataFrame([(1, "1gram-a", 2.0), (1, "new", 1.0), (2, "2gram-a-b", 3.0)], "doc_id int, feature string, value double")
    assert sorted(map(tuple, lexical.indexed(feats, loaded, "doc_id").collect())) == [(1, 0, 2.0), (2, 2, 3.0)]
    runs.bind(spark, fitted, data)
    runs.check_bound(spark, fitted, data)
    for x, y in ((fitted, other), (other, data)):
        with pytest.raises(runs.OtherVocabulary):
            runs.check_bound(spark, x, y)
    writers.vocabulary(spark.createDataFrame(others[0], kinds), f"{data}/vocabulary")
    with pytest.raises(runs.OtherVocabulary):
        runs.load_vocabulary(spark, data)


def test_notes_of_writers_at_once(spark, tmp_path):
    from multiprocessing.pool import ThreadPool

    run = runs.new_run(spark, str(tmp_path))
    with ThreadPool(4) as pool:
        pool.map(lambda k: runs.note(spark, run, **{f"n{k}": k}), range(6))
    assert runs.notes(spark, run) == {f"n{k}": k for k in range(6)}
