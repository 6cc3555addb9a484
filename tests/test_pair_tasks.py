"""Pairs are counted in tasks of bounded size, however many sets there are."""

from pyspark.sql import functions as F

from trailhead.operators import memory


def test_tasks_grow_with_the_sets(spark, monkeypatch):
    monkeypatch.setattr(memory, "TASK_ROWS", 20, raising=False)
    sets = spark.range(800).select(F.expr("id div 4").alias("set_id"), (F.col("id") % 4).alias("file_id"))
    pairs = memory.co_access_pairs(sets)
    assert "hashpartitioning(set_id" in (plan := pairs._jdf.queryExecution().toString()) and ", 40), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in pairs.collect()} == {(a, b, 200) for a in range(4) for b in range(a + 1, 4)}
