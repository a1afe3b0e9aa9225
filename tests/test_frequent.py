"""The most frequent rows: within the bound, never empty, whatever the counts and ties."""

import pytest
from pyspark.sql import functions as F

from tahlil.functions import frequent


@pytest.mark.parametrize(
    ("counts", "most", "least"),
    [
        ([100_000 + i for i in range(10)] + [1, 2, 3], 5, 5),
        ([10**12 + i for i in range(10)], 5, 4),
        ([7] * 40, 5, 4),
        ([9] * 3 + [7] * 400, 50, 45),
        ([5, 4, 3], 10, 3),
        ([5, None, 3], 1, 1),
        ([], 3, 0),
    ],
)
def test_within_the_bound_and_full(spark, counts, most, least):
    df = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "w string, n long")
    keep = frequent.chosen(df, "n", most, "w")
    got, rest = df.filter(keep).collect(), df.filter(~keep).collect()
    assert least <= len(got) <= most and len(got) + len(rest) == len(counts)
    if got and rest:  # levels of 1/512 of a doubling
        assert min(r.n for r in got) * 1.002 >= max(r.n or 0 for r in rest)


def test_large_table(spark):
    df = spark.range(200_000).select(F.col("id").alias("w"), F.lit(1).alias("n"))
    assert 900 <= df.filter(frequent.chosen(df, "n", 1_000, "w")).count() <= 1_000
