"""Order-dependent work over whole tables without one task that sees every row.

`running_totals` gives exact running sums over a total order: it cuts the order into ranges with
`repartitionByRange`, so they stay balanced for any distribution as long as the order has no large ties, and keeps only
one small row per range outside the executors. `descending_totals` does it for distinct numbers, whose ranges are fixed
beforehand by a sketch of quantiles, so that one shuffle serves range and order. `nth_keys` finds the key at given ranks
by counting digits.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, StringType

#: Number of the range in which a row lies.
RANGE = "__range"
_COLLECT_ROWS = 20_000


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; choose one only for a local session without any."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="rollbook-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back, so later jobs do not recompute it."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], keep: bool = False
) -> DataFrame:
    """Add running sums over `order`, and grand totals, to every row.

    `sums` maps a column to the prefix of its results: `{"n": "n"}` adds `cum_n`
    (this row included) and `total_n`. `order` must be a total order. The ranges are
    written to the checkpoint folder before they are used twice, so a lost executor
    cannot make the two uses disagree. With `keep` the result is written as well.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id())
    )
    per_range = placed.groupBy(RANGE).agg(
        *[F.sum(c).alias(f"__sum_{name}") for c, name in sums.items()]
    )
    # One row per range: at most spark.sql.shuffle.partitions rows.
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(RANGE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    bases = per_range.select(
        RANGE,
        *[
            F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__base_{name}")
            for name in sums.values()
        ],
        *[F.sum(f"__sum_{name}").over(everything).alias(f"total_{name}") for name in sums.values()],
    )
    inside = (
        Window.partitionBy(RANGE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = (
        placed.select(
            "*", *[F.sum(c).over(inside).alias(f"__inside_{name}") for c, name in sums.items()]
        )
        .join(F.broadcast(bases), RANGE)
        .select(
            *df.columns,
            *[
                (F.col(f"__base_{name}") + F.col(f"__inside_{name}")).alias(f"cum_{name}")
                for name in sums.values()
            ],
            *[f"total_{name}" for name in sums.values()],
        )
    )
    return cut_lineage(totals) if keep else totals


def range_edges(df: DataFrame, key: str) -> list[float]:
    """Ascending edges that cut the numbers in `key` into about equal parts, fewer of them than shuffle partitions."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = F.percentile_approx(F.col(key), [i / parts for i in range(1, parts)], max(10_000, 20 * parts))
    return sorted({x + 0.0 for x in df.agg(quantiles).first()[0] or []})


def with_range(df: DataFrame, key: str, edges: Sequence[float]) -> DataFrame:
    """Add the number of the range in which the double `key` lies; an edge belongs to the range above it."""
    inner = [x for x in edges if math.isfinite(x)]
    if not inner:
        return df.withColumn(RANGE, F.lit(0.0))
    splits = [-math.inf, *inner, math.inf]
    return Bucketizer(splits=splits, inputCol=key, outputCol=RANGE).transform(df)


def descending_totals(df: DataFrame, key: str, sums: dict[str, str], following: dict[str, str]) -> DataFrame:
    """Running sums from the largest `key` down, grand totals, and values of the next smaller key.

    `df` has one row per key and `RANGE` from `with_range`. `sums` is as in `running_totals`; `following` maps a column
    to the name its value in the next row gets, null in the last. Rows move once, to their range; across ranges only one
    row each counts: its sums, and its first row's values. Ranges are fixed, so a lost executor recomputes the same.
    """
    head = F.max_by(F.struct(*following), key)
    per_range = df.groupBy(RANGE).agg(*[F.sum(c).alias(f"__sum_{n}") for c, n in sums.items()], head.alias("__head"))
    # One row per range: at most spark.sql.shuffle.partitions rows.
    down = Window.orderBy(F.col(RANGE).desc())
    earlier, everything = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = per_range.select(
        RANGE,
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}") for n in sums.values()],
        *[F.sum(f"__sum_{n}").over(everything).alias(f"total_{n}") for n in sums.values()],
        F.lead("__head").over(down).alias("__next_head"),
    )
    order = Window.partitionBy(RANGE).orderBy(F.col(key).desc())
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.select(
            "*",
            *[F.sum(c).over(inside).alias(f"__inside_{n}") for c, n in sums.items()],
            F.lead(F.struct(*following)).over(order).alias("__next"),
        )
        .join(F.broadcast(bases), RANGE)
        .select(
            *[c for c in df.columns if c != RANGE],
            *[(F.col(f"__base_{n}") + F.col(f"__inside_{n}")).alias(f"cum_{n}") for n in sums.values()],
            *[f"total_{n}" for n in sums.values()],
            *[F.coalesce(F.col("__next"), F.col("__next_head"))[c].alias(name) for c, name in following.items()],
        )
    )


def nth_keys(df: DataFrame, keys: Sequence[str], ranks: Sequence[int]) -> list[tuple]:
    """Key tuples found at the given 1-based ranks in ascending order of `keys` (nulls first); rows may share a key.

    Radix selection: each pass counts the rows by the leading digit of their key, at most `_BUCKETS` of them, and keeps
    only the rows whose digit holds a wanted rank; where these share a key value the next key goes on. Rows are never
    moved: counts are, and in the end one short stretch. All ranks are narrowed in the same pass.
    """
    kinds = {k: _kind(df.schema[k].dataType) for k in keys}
    if None in kinds.values():
        return _nth_by_ranges(df, keys, ranks)
    narrow = df.select(*[F.col(f"`{k}`") for k in keys])
    bounds = [x for i, k in enumerate(keys) for x in (F.min(f"`{k}`").alias(f"low{i}"), F.max(f"`{k}`").alias(f"high{i}"), F.count_if(F.col(f"`{k}`").isNull()).alias(f"nulls{i}"))]
    first = narrow.agg(F.count(F.lit(1)).alias("n"), *bounds).first()
    found: dict[int, tuple] = {}
    items = [_Stretch(F.lit(True), 0, 0, sorted(set(ranks)), 0, first)]
    while items:
        open_items, digits = [], []
        for item in items:
            while item.key < len(keys) and item.single(item.key):
                item.key, item.level = item.key + 1, 0
            if item.key == len(keys) or item.row.n <= _COLLECT_ROWS:
                stretch = narrow.filter(item.condition)
                for rank in item.wanted:
                    found[rank] = tuple(stretch.orderBy(*keys).offset(rank - item.base - 1).limit(1).first())
            else:
                name = keys[item.key]
                open_items.append(item)
                digits.append(_digit(F.col(f"`{name}`"), kinds[name], item))
        if not open_items:
            break
        number, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (item, own) in enumerate(zip(open_items, digits)):
            number, digit = F.when(item.condition, i).otherwise(number), F.when(item.condition, own).otherwise(digit)
        parts = (
            narrow.select("*", number.alias("__item"), digit.alias("__digit"))
            .filter(F.col("__item").isNotNull())
            .groupBy("__item", "__digit")
            .agg(F.count(F.lit(1)).alias("n"), *bounds)
            .collect()
        )
        items = []
        for part in sorted(parts, key=lambda r: (r["__item"], r["__digit"] is not None, r["__digit"] or 0)):
            item, own = open_items[part["__item"]], digits[part["__item"]]
            inside = [r for r in item.wanted if item.base < r <= item.base + part.n]
            if inside:
                same = own.isNull() if part["__digit"] is None else own == F.lit(part["__digit"])
                items.append(_Stretch(item.condition & same, item.key, item.level + 1, inside, item.base, part))
            item.base += part.n
    return [found[r] for r in ranks]


@dataclass
class _Stretch:
    """Rows that hold wanted ranks: the condition they meet, the key and level to go on with, and the rows before them."""

    condition: Column
    key: int
    level: int
    wanted: list[int]
    base: int
    row: Row  # n, and low, high and nulls of each key

    def single(self, key: int) -> bool:
        """Whether all rows have the same value of a key."""
        nulls = self.row[f"nulls{key}"]
        return nulls == self.row.n or not nulls and self.row[f"low{key}"] == self.row[f"high{key}"]


_BITS = 12
#: Digits in a pass at most: 2 ** _BITS for numbers, two bytes for text.
_BUCKETS = 65_536


def _kind(data_type: DataType) -> str | None:
    if isinstance(data_type, IntegralType):
        return "long"
    if isinstance(data_type, (DoubleType, FloatType)):
        return "double"
    return "string" if isinstance(data_type, StringType) else None


def _digit(key: Column, kind: str, item: _Stretch) -> Column:
    """A whole number that grows with the key and parts the rows of `item`, whose least and greatest key are known."""
    low, high = item.row[f"low{item.key}"], item.row[f"high{item.key}"]
    if kind == "string":
        two = F.substring(F.encode(key, "UTF-8"), 2 * item.level + 1, 2)
        # Longer than what was read so far, or at its end: the end comes first.
        return F.when(F.length(two) > 0, F.conv(F.rpad(F.hex(two), 4, "0"), 16, 10).cast("long")).otherwise(
            F.when(key.isNotNull(), F.lit(-1))
        ).cast("long")
    if kind == "long":
        key, width = key.cast("long"), (int(high) - int(low)).bit_length()
        if width > 62:
            return F.shiftright(key, 64 - _BITS)
        return F.shiftright(key - F.lit(int(low)).cast("long"), max(0, width - _BITS))
    if math.isnan(high) or math.isinf(high) or math.isinf(low):
        known = F.when(F.isnan(key), 3).when(key == float("inf"), 2).when(key == float("-inf"), 0)
        return F.when(key.isNotNull(), known.otherwise(1)).cast("long")
    count = 2**_BITS
    share = (key.cast("double") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    return F.least(F.floor(share * count), F.lit(count - 1)).cast("long")


def _nth_by_ranges(df: DataFrame, keys: Sequence[str], ranks: Sequence[int]) -> list[tuple]:
    """`nth_keys` for keys without digits: ranges are cut by sampling, and those with a wanted rank are cut again."""
    narrow = df.select(*keys)
    key = F.struct(*keys)
    ranges = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found: dict[int, tuple] = {}
    work = [(narrow, sorted(set(ranks)), 0)]
    while work:
        rows, wanted, base = work.pop()
        parts = (
            rows.repartitionByRange(ranges, *keys)
            .withColumn(RANGE, F.spark_partition_id())
            .groupBy(RANGE)
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
            .orderBy("low")
            .collect()
        )
        for part in parts:
            inside = [r for r in wanted if base < r <= base + part.n]
            if inside:
                stretch = rows.filter(
                    (key >= key_literal(part.low, keys, df)) & (key <= key_literal(part.high, keys, df))
                )
                if part.low == part.high:
                    found.update({rank: tuple(part.low) for rank in inside})
                elif part.n <= _COLLECT_ROWS:
                    for rank in inside:
                        found[rank] = tuple(stretch.orderBy(*keys).offset(rank - base - 1).limit(1).first())
                else:
                    work.append((stretch, inside, base))
            base += part.n
    return [found[r] for r in ranks]


def key_literal(values: Sequence, keys: Sequence[str], df: DataFrame) -> Column:
    """A struct literal with the types of `keys`, to compare with `struct(keys)`."""
    return F.struct(
        *[F.lit(v).cast(df.schema[k].dataType).alias(k) for v, k in zip(values, keys)]
    )
