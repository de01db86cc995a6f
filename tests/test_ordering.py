import random

import pytest
from pyspark.sql import functions as F

from rollbook.functions.ordering import descending_totals, nth_keys, range_edges, running_totals, use_checkpoint_dir, with_range


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_running_totals_match_one_sorted_pass(spark, partitions):
    rng = random.Random(3)
    # A third of the rows share one first key.
    rows = [(0.5 if i % 3 == 0 else rng.random(), i, rng.randint(0, 3)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "s double, id int, w int").repartition(5)
        got = running_totals(df.withColumn("one", F.lit(1)), [F.col("s").desc(), F.col("id").asc()], {"one": "rank", "w": "w"})
        found = {r.id: (r.cum_rank, r.cum_w, r.total_rank, r.total_w) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = 0
    for rank, (_, id_, w) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        total += w
        assert found[id_][:2] == (rank, total)
    assert {f[2:] for f in found.values()} == {(3000, total)}


@pytest.mark.parametrize("partitions", ["1", "2", "8"])
@pytest.mark.parametrize("values", [[], [0.5], [float("-inf"), -1.0, 0.0, 0.25, float("inf")], [i * 0.37 % 1 for i in range(3000)] + [0.9] * 2000])
def test_descending_totals_match_one_sorted_pass(spark, partitions, values):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.createDataFrame([(x,) for x in values], "s double")
        edges = range_edges(rows, "s")
        assert len(edges) < max(2, int(partitions))
        counts = with_range(rows, "s", edges).groupBy("__range", "s").agg(F.count("*").alias("n"))
        got = descending_totals(counts, "s", {"n": "n"}, {"n": "after"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    distinct, total, expected = sorted(set(values), reverse=True), 0, []
    for i, x in enumerate(distinct):
        total += values.count(x)
        after = values.count(distinct[i + 1]) if i + 1 < len(distinct) else None
        expected.append((x, values.count(x), total, len(values), after))
    assert sorted(map(tuple, got), reverse=True) == expected


def test_nth_keys_narrow_down_to_the_exact_rows(spark):
    df = spark.range(300_000).select(
        (F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 7919 % 300_007).alias("key")
    )
    ordered = sorted((i % 2, i * 7919 % 300_007) for i in range(300_000))
    ranks = [1, 2, 77_777, 150_000, 150_001, 299_999, 300_000]
    assert nth_keys(df, ["label", "key"], ranks) == [ordered[r - 1] for r in ranks]


def test_nth_keys_of_text(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(50)], "k string")
    assert nth_keys(df, ["k"], [10]) == [(sorted(f"s{i}" for i in range(50))[9],)]


def test_checkpoint_dir_is_set(spark):
    assert use_checkpoint_dir(spark)


NAN, INF = float("nan"), float("inf")
KEYS = {
    "long": ("bigint", [5, -3, 2**62, -(2**63), 2**63 - 1, 0, 0, 7, None, None] + list(range(-50, 50))),
    "double": ("double", [0.5, -1e300, 1e300, NAN, NAN, INF, -INF, None, 0.0, 5e-324] + [i / 7 for i in range(60)]),
    "string": ("string", ["", "a", "ab", "abc", "abcd", "abcde", "é", "ééé", "\U0001f600", None, "b", "a"] + [f"long prefix {i}" for i in range(60)]),
}


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_nth_keys_of_odd_values(spark, kind, monkeypatch):
    from rollbook.functions import ordering

    monkeypatch.setattr(ordering, "_COLLECT_ROWS", 3)
    ddl, values = KEYS[kind]
    df = spark.createDataFrame([(x, i % 4) for i, x in enumerate(values)], f"k {ddl}, t int")
    ordered = [tuple(r) for r in df.orderBy("k", "t").collect()]
    ranks = [1, 2, 3, len(values) // 2, len(values) - 2, len(values) - 1, len(values)]
    got = nth_keys(df, ["k", "t"], ranks)
    assert str(got) == str([ordered[r - 1] for r in ranks])


def test_selection_by_counts_moves_no_rows(spark):
    import datetime

    df = spark.createDataFrame([(datetime.date(2020, 1, 1 + i % 28),) for i in range(200)], "d date")
    assert nth_keys(df, ["d"], [1, 200]) == [(datetime.date(2020, 1, 1),), (datetime.date(2020, 1, 28),)]
