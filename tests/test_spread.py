"""Keys are dealt to tasks by their number."""

from pyspark.sql import functions as F

from hirelake.plans.derived import spread


def test_tasks_grow_with_the_keys(spark):
    """A task gets no more keys of a larger table, so its memory doesn't grow with it."""
    few = 4 * spark.sparkContext.defaultParallelism
    for n, tasks in ((0, few), (1_000, few), (few * 50_000, few), (few * 50_000 + 1, few + 1), (2_000_000, 40)):
        d = spread(spark.range(n), "id")
        assert d.rdd.getNumPartitions() == tasks and d.count() == n
    sizes = [r["count"] for r in d.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(sizes) < 52_000 and sum(sizes) == 2_000_000
