"""Categories as numbers: the mean label of each category's training rows.

The means stay a table, however many categories there are. Scoring joins it; the part
that belongs to one column is sent to every executor only if it is known to be small.
Training rows get another number: the mean of the rows before them in a seeded order, so
that no row's own label is in what it is fitted on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions.ordering import cut_lineage
from rollbook.operators.sampling import hash_order

# Up to this many categories of a column are broadcast (some 20 MB); beyond it the join shuffles.
BROADCAST_CATEGORIES = 200_000
# A category's rows are counted in so many ranges of the seeded order, so a frequent one is no burden on one task.
RANGE_BITS = 6


@dataclass
class CategoryMeans:
    """(feature, category, mean) with the number of categories per feature and the overall mean."""

    table: DataFrame | None
    overall: float
    sizes: dict[str, int]

    def transform(self, df: DataFrame, prefix: str = "__mean_") -> DataFrame:
        """Add one number per category column; unseen categories get the overall mean."""
        columns = df.columns
        for i, (name, size) in enumerate(self.sizes.items()):
            part = self.table.filter(F.col("feature") == name).select(
                F.col("category").alias(f"__category_{i}"), F.col("mean").alias(f"__found_{i}")
            )
            if size <= BROADCAST_CATEGORIES:
                part = F.broadcast(part)
            df = df.join(part, F.col(f"`{name}`").eqNullSafe(F.col(f"__category_{i}")), "left")
        return df.select(
            *[F.col(f"`{c}`") for c in columns],
            *[
                F.coalesce(F.col(f"__found_{i}"), F.lit(self.overall)).alias(prefix + name)
                for i, name in enumerate(self.sizes)
            ],
        )

    def save(self, path: str) -> None:
        if self.table is not None:
            self.table.write.mode("overwrite").partitionBy("feature").parquet(path)

    @classmethod
    def load(cls, path: str, overall: float, sizes: dict[str, int]) -> CategoryMeans:
        table = SparkSession.active().read.parquet(path) if sizes else None
        return cls(table, overall, sizes)


def fit_category_means(
    train: DataFrame, categorical: Sequence[str], label: str, smoothing: float = 0.0
) -> CategoryMeans:
    """Mean label per category, pulled towards the overall mean by `smoothing` rows.

    One pass over the training rows for all columns; rows of a frequent category
    collapse before the shuffle.
    """
    overall = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if not categorical:
        return CategoryMeans(None, overall, {})
    long = train.select(F.col(label).cast("double").alias("__y"), *[F.col(f"`{c}`") for c in categorical]).unpivot(
        ["__y"], [F.col(f"`{c}`") for c in categorical], "feature", "category"
    )
    counted = long.groupBy("feature", "category").agg(F.sum("__y").alias("hits"), F.count(F.lit(1)).alias("n"))
    table = cut_lineage(
        counted.select(
            "feature",
            "category",
            ((F.col("hits") + F.lit(smoothing * overall)) / (F.col("n") + F.lit(float(smoothing)))).alias("mean"),
        )
    )
    found = {r.feature: r.n for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    return CategoryMeans(table, overall, {c: found.get(c, 0) for c in categorical})


def _long(train: DataFrame, categorical: Sequence[str], label: str, id: str, seed: int) -> DataFrame:
    """(id, y, order, range, feature, category) of every row and category column."""
    order = hash_order(F.col(f"`{id}`"), seed)
    own = [F.col(f"`{c}`").cast("string").alias(c) for c in categorical]
    rows = train.select(F.col(f"`{id}`").alias("__id"), F.col(label).cast("double").alias("__y"), order.alias("__order"), *own)
    long = rows.unpivot(["__id", "__y", "__order"], [F.col(f"`{c}`") for c in categorical], "feature", "category")
    # Without an id there is no order; such rows share one range.
    return long.withColumn("__range", F.coalesce(F.shiftright("__order", 60 - RANGE_BITS), F.lit(-1)))


def ordered_numbers(
    train: DataFrame, categorical: Sequence[str], label: str, id: str, seed: int = 0, prior: float = 0.5, weight: float = 1.0
) -> DataFrame:
    """(id, a number for each category column): the mean label of the category's rows that come earlier in a seeded order
    of the unique `id`, counted together with `weight` rows of label `prior`.

    A row's own label is not in its numbers. Running sums are taken within ranges of the order and added to the totals of
    the ranges before, so the rows of one category never have to meet in one task.
    """
    long = _long(train, categorical, label, id, seed)
    group = ["feature", "category", "__range"]
    earlier = Window.partitionBy(*group).orderBy("__order", "__id").rowsBetween(Window.unboundedPreceding, -1)
    inside = long.select(
        "__id", *group, F.coalesce(F.sum("__y").over(earlier), F.lit(0.0)).alias("__s"), F.count("__y").over(earlier).alias("__n")
    )
    # At most 2 ** RANGE_BITS rows for each category.
    before = Window.partitionBy("feature", "category").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = long.groupBy(*group).agg(F.sum("__y").alias("__ys"), F.count("__y").alias("__yn"))
    bases = totals.select(
        *[F.col(c).alias(f"__base_{c}") for c in group],
        F.coalesce(F.sum("__ys").over(before), F.lit(0.0)).alias("__bs"),
        F.coalesce(F.sum("__yn").over(before), F.lit(0)).alias("__bn"),
    )
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__base_{c}"))
    number = (F.col("__s") + F.col("__bs") + F.lit(weight * prior)) / (F.col("__n") + F.col("__bn") + F.lit(float(weight)))
    numbered = inside.join(bases, same).select("__id", "feature", number.alias("number"))
    wide = numbered.groupBy("__id").agg(*[F.max(F.when(F.col("feature") == c, F.col("number"))).alias(c) for c in categorical])
    return wide.withColumnRenamed("__id", id)


def with_ordered_numbers(
    train: DataFrame, categorical: Sequence[str], label: str, id: str, seed: int = 0, weight: float = 1.0, prefix: str = "__mean_"
) -> DataFrame:
    """Add the numbers of `ordered_numbers` to the training rows, under the names that `CategoryMeans.transform` uses."""
    if not categorical:
        return train
    found = ordered_numbers(train, categorical, label, id, seed, weight=weight)
    found = found.select(F.col(f"`{id}`").alias("__own"), *[F.col(f"`{c}`").alias(prefix + c) for c in categorical])
    return train.join(found, F.col(f"`{id}`").eqNullSafe(F.col("__own"))).drop("__own")
