import bz2
import struct

import pytest

from broadsheet.sources import packed

ROWS = [(1, [7, 65535]), (0, []), (255, list(range(30))), (None, None), (2, [3] * 25)]


@pytest.fixture()
def rows(spark):
    packed.register(spark)
    return spark.createDataFrame(ROWS, "label int, ids array<int>")


def test_round_trip(spark, rows, tmp_path):
    at = str(tmp_path / "x")
    rows.repartition(3).write.format("packed").mode("append").save(at)
    got = spark.read.format("packed").load(at)
    assert got.columns == ["label", "len", "ids"]
    assert sorted((r["label"], r["len"], r["ids"]) for r in got.collect()) == sorted((a or 0, len(b or []), b or []) for a, b in ROWS)
    assert not [p for p in (tmp_path / "x").iterdir() if p.name.startswith("_temporary")]
    assert (tmp_path / "x" / "_SUCCESS").exists()
    # more rows beside, then others instead
    rows.limit(1).write.format("packed").mode("append").save(f"file://{at}")
    assert spark.read.format("packed").load(f"file://{at}").count() == len(ROWS) + 1
    rows.limit(2).write.format("packed").mode("overwrite").save(at)
    assert spark.read.format("packed").load(at).count() == 2


def test_bytes(spark, rows, tmp_path):
    rows.limit(1).coalesce(1).write.format("packed").mode("append").option("pad", 9).save(str(tmp_path / "x"))
    (file,) = (tmp_path / "x").glob("*.bin.bz2")
    assert bz2.decompress(file.read_bytes()) == bytes([1]) + struct.pack("<I", 2) + struct.pack("<25H", 7, 65535, *[9] * 23)


def test_records_cut_anywhere():
    data = b"".join(packed.packed_record(a or 0, b or []) for a, b in ROWS)
    want = [(a or 0, len(b or []), b or []) for a, b in ROWS]
    for n in (1, 2, 5, 54, 55, 56, len(data)):
        assert list(packed.records(iter([data[i : i + n] for i in range(0, len(data), n)]))) == want
    with pytest.raises(ValueError):
        list(packed.records(iter([data[:-1]])))


def test_errors_write_nothing(spark, rows, tmp_path):
    bad = rows.unionByName(spark.createDataFrame([(1, [70_000])], "label int, ids array<int>"))
    with pytest.raises(Exception, match="16"):
        bad.write.format("packed").mode("append").save(str(tmp_path / "x"))
    assert not list((tmp_path / "x").glob("*.bin.bz2"))
    with pytest.raises(Exception, match="nothing at"):
        spark.read.format("packed").load(str(tmp_path / "none")).collect()


def test_empty(spark, rows, tmp_path):
    rows.where("false").write.format("packed").mode("append").save(str(tmp_path / "x"))
    assert spark.read.format("packed").load(str(tmp_path / "x")).count() == 0
