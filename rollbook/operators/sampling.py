"""Prevalence sampling and the stratified split.

Both pick the first n rows of each class in a given order. The key of the n-th row is
found by counting narrow (label, key) columns; the wide rows are then filtered against it
without being moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.ordering import key_literal, nth_keys

_HASH = "__hash"


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class, from one pass that also finds any other label."""
    of_class = [F.count_if(F.col(label) == c) for c in (0, 1)]
    counts = df.agg(*[F.coalesce(n, F.lit(0)).alias(f"n{c}") for c, n in enumerate(of_class)], F.count(F.lit(1)).alias("n")).first()
    if counts.n0 + counts.n1 != counts.n:
        raise ValueError(f"label '{label}' must be 0 or 1, found {counts.n - counts.n0 - counts.n1} rows with another value")
    return {0: counts.n0, 1: counts.n1}


def sample_sizes(negatives: int, positives: int, p: float | str) -> dict[int, int]:
    """Rows to keep per class so that the share of positives becomes `p`."""
    total = negatives + positives
    actual = positives / total if total else 0.0
    wanted = actual if p == "actual" else float(p)
    if p == "actual" and (positives == 0 or negatives == 0):
        return {0: negatives, 1: positives}
    if wanted < actual:
        return {0: negatives, 1: math.ceil(negatives * wanted / (1 - wanted))}
    return {0: math.ceil(positives * (1 - wanted) / wanted), 1: positives}


def first_per_class(
    df: DataFrame, label: str, keys: list[str], counts: dict[int, int], sizes: dict[int, int]
) -> Column:
    """Condition that holds for the first `sizes[c]` of the `counts[c]` rows of each class c in order of `keys`."""
    bases = {0: 0, 1: counts[0]}
    cut = [c for c in (0, 1) if 0 < sizes[c] < counts[c]]
    limits = dict(zip(cut, nth_keys(df, [label, *keys], [bases[c] + sizes[c] for c in cut]))) if cut else {}
    keep = F.lit(False)
    for c in (0, 1):
        if sizes[c] <= 0:
            continue
        of_class = F.col(label) == c
        if c in limits:
            last = limits[c][1:]
            if len(keys) == 1:
                of_class &= F.col(keys[0]) <= F.lit(last[0]).cast(df.schema[keys[0]].dataType)
            else:
                of_class &= F.struct(*keys) <= key_literal(last, keys, df)
        keep |= of_class
    return keep


def hash_order(id: Column, seed: int) -> Column:
    """A seeded order of ids: the first 60 bits of the MD5 of `id:seed`, the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", id.cast("string"), F.lit(str(seed)))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def _hash_key(df: DataFrame, id: str, seed: int) -> DataFrame:
    return df.withColumn(_HASH, hash_order(F.col(id), seed))


def prevalence_sample(
    df: DataFrame, label: str, p: float | str, order_key: str, seed: int | None = None
) -> DataFrame:
    """Keep all of one class and as many of the other as prevalence `p` asks for.

    The first rows by `order_key` (unique) are kept, or, with a `seed`, the first in a
    seeded hash order of it.
    """
    counts = class_counts(df, label)
    sizes = sample_sizes(counts[0], counts[1], p)
    if all(sizes[c] >= counts[c] for c in (0, 1)):
        return df
    if seed is None:
        return df.filter(first_per_class(df, label, [order_key], counts, sizes))
    hashed = _hash_key(df, order_key, seed)
    return hashed.filter(first_per_class(hashed, label, [_HASH, order_key], counts, sizes)).drop(_HASH)


def split_sizes(counts: dict[int, int], fraction: float) -> dict[int, int]:
    """Training rows per class: floor(fraction * n) in all, shared by largest remainder."""
    total = sum(counts.values())
    wanted = math.floor(fraction * total)
    if not 0 < wanted < total:
        raise ValueError(f"a fraction of {fraction} of {total} rows leaves one side empty")
    exact = {c: n * wanted / total for c, n in counts.items()}
    sizes = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (sizes[c] - exact[c], c))
    for c in by_remainder[: wanted - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def stratified_split(
    df: DataFrame, label: str, id: str, fraction: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Split into (train, validation) with exact class shares.

    Membership follows a seeded hash of the unique `id`, so it does not depend on
    partitioning.
    """
    hashed = _hash_key(df, id, seed)
    counts = class_counts(df, label)
    in_train = first_per_class(hashed, label, [_HASH, id], counts, split_sizes(counts, fraction))
    return hashed.filter(in_train).drop(_HASH), hashed.filter(~in_train).drop(_HASH)
