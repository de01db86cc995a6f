import hashlib

import pytest
from pyspark.sql import functions as F

from rollbook.operators import encoding


def plain(rows, seed, prior=0.5, weight=1.0):
    """Means over the rows before, one by one."""
    place = lambda i: int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:15], 16)
    seen, out = {}, {}
    for i, category, y in sorted(rows, key=lambda r: (place(r[0]), r[0])):
        s, n = seen.get(category, (0, 0))
        out[i] = (s + prior * weight) / (n + weight)
        seen[category] = s + y, n + 1
    return out


def numbers(spark, rows, seed=0):
    df = spark.createDataFrame(rows, "id long, c string, y int")
    return {r.id: r.c for r in encoding.ordered_numbers(df, ["c"], "y", "id", seed).collect()}


@pytest.fixture(scope="module")
def rows():
    # A third of all rows are in one category; nulls are a category; some have one row.
    return [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"c{i % 200}" if i < 600 else f"one{i}", i * 7919 % 5 // 4) for i in range(900)]


def test_means_of_the_rows_before(spark, rows):
    for seed in (0, 9):
        got = numbers(spark, rows, seed)
        want = plain(rows, seed)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_a_row_does_not_see_its_own_label(spark, rows):
    before = numbers(spark, rows)
    for i in (0, 7, 301, 899):
        turned = [(k, c, 1 - y if k == i else y) for k, c, y in rows]
        after = numbers(spark, turned)
        assert after[i] == before[i]
    assert any(after[k] != before[k] for k in before) or rows[899][1].startswith("one")


def test_several_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, 5), (2, "a", None, 0, 6), (3, "b", "x", 1, 7)], "id long, `a b` string, feature string, y int, category int")
    got = encoding.with_ordered_numbers(df, ["a b", "feature"], "y", "id")
    assert got.columns == [*df.columns, "__mean_a b", "__mean_feature"] and got.count() == 3
    assert encoding.with_ordered_numbers(df, [], "y", "id") is df
    assert encoding.ordered_numbers(df.limit(0), ["feature"], "y", "id").count() == 0


def test_a_hot_category_is_cut_into_ranges(spark):
    df = spark.range(5000).select("id", F.lit("hot").alias("c"), F.lit(1).alias("y"))
    ranges = encoding._long(df, ["c"], "y", "id", 0).groupBy("__range").count().collect()
    assert len(ranges) == 2**encoding.RANGE_BITS and max(r["count"] for r in ranges) < 150
