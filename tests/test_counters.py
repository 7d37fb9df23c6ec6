from pyspark.sql import functions as F

from broadsheet.operators.counters import Counters


def test_counts_come_with_the_job(spark):
    c = Counters(spark)
    df = c.watch(spark.range(0, 1000, 1, 7), "read", odd=F.count_if(F.col("id") % 2 == 1))
    kept = c.watch(df.where("id % 3 = 0"), "kept", total=F.sum("id"))
    with c.timed("write"):
        kept.write.format("noop").mode("overwrite").save()
    rows = [tuple(r) for r in c.report().collect()]
    assert rows[:4] == [("read", "rows", 1000), ("read", "odd", 500), ("kept", "rows", 334), ("kept", "total", sum(range(0, 1000, 3)))]
    assert [r[:2] for r in rows[4:]] == [("write", "calls"), ("write", "ms")] and rows[4][2] == 1


def test_stages_of_one_name_and_empty_frames(spark):
    c = Counters(spark)
    for _ in range(2):
        c.watch(spark.range(0).toDF("id"), "none", sum_=F.sum("id")).collect()
    assert [tuple(r) for r in c.report().collect()] == [("none", "rows", 0), ("none", "sum_", 0)]
