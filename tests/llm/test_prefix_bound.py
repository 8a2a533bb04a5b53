"""The bound on shared columns against an enumeration of sizes."""

import pytest
from pyspark.sql import functions as F

from hirelake.llm import ngram_join


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_fewest_shared_holds_for_both_prefixes(spark, percent):
    def after(n):
        return n - min(int((n - -(-percent * n // 100) + 1) * ngram_join.MORE), n)

    got = {r["n"]: r["k"] for r in spark.range(1, 300).select(F.col("id").alias("n"), ngram_join.fewest_shared(F.col("id"), percent).alias("k")).collect()}
    for a in range(1, 300):
        both = [-(-percent * (a + b) // (100 + percent)) - max(after(a), after(b)) for b in range(1, 600) if 100 * min(a, b) >= percent * max(a, b)]
        assert 1 <= got[a] == min(both), a
    if percent == 80:
        assert got[5] == 1  # with a set of 4, whose prefix is one column
