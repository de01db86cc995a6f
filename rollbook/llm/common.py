"""Shared small pieces: words, fresh column names, ids, bindings inside expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.ordering import cut_lineage

__all__ = ["chunks", "cut_lineage", "documents", "let", "fresh", "n_words", "running_sums", "word_list"]

#: One or more characters that are no white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_list(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 512) -> Column:
    """Sums of the first 1, 2, ... elements of an array of longs, in blocks so that long arrays stay cheap."""
    def within(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            part, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out"))
        )

    def all_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(block))
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<bigint>>").alias("out"))

        def step(a: Column, start: Column) -> Column:
            return let(
                within(F.slice(v, start, F.lit(block)), a["s"]),
                lambda b: F.struct(b["s"].alias("s"), F.concat(a["out"], F.array(b["out"])).alias("out")),
            )

        return F.flatten(F.aggregate(starts, zero, step)["out"])

    return let(values, lambda v: F.when(F.size(v) > 0, all_blocks(v)).otherwise(F.array().cast("array<bigint>")))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what Python makes of their texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
