import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.functions.bins import edges_passed, even_edges


@pytest.mark.parametrize("low, high, count", [(0.0, 1.0, 100), (0.05, 0.95, 19), (-3.7, 11.3, 51), (5.0, 5.5, 2), (0.5, 0.5, 1)])
def test_equals_searchsorted(spark, low, high, count):
    rng = random.Random(count)
    edges = even_edges(low, high, count)
    near = [x for e in edges for x in (e, np.nextafter(e, -9), np.nextafter(e, 99))]
    values = near + [rng.uniform(low - 1, high + 1) for _ in range(500)]
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    got = df.select("x", edges_passed(F.col("x"), edges).alias("a"), edges_passed(F.col("x"), edges, False).alias("b")).collect()
    for row in got:
        assert row.a == np.searchsorted(edges, row.x, side="right")
        assert row.b == np.searchsorted(edges, row.x, side="left")
