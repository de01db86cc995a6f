"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k by their ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut_lineage


@dataclass(frozen=True)
class Resampling:
    buckets: int = 16_384
    share: float = 0.75  # of all rows that the sample keeps
    smoothing: float = 1.0
    length: float = 200.0  # n-grams that a text's mean log ratio is taken to stand for
    cut_bits: int = 12
    target_rows: int = 100_000  # good labels that the target model is fitted on at most, about
    seed: str = "resample"


def features(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of a text's words, pairs of words, and their shapes (capitals, marks), lower-cased but for the shapes."""
    raw = (text or "").encode().split()
    words = [w.lower() for w in raw]
    digest = xxhash.xxh32_intdigest
    one = np.fromiter(map(digest, words), np.uint64, len(words))
    tails = np.fromiter((digest(w[-3:] if not w[-1:].isalnum() else b"caps" if w.isupper() and len(w) > 2 else b"") for w in raw), np.uint64, len(raw))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    mixed = np.concatenate([one, two ^ (two >> np.uint64(32)), tails * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)])
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket in all of `docs`; a task sends at most one row a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in chunks(batches):
            for text in part.column(0):
                total += np.bincount(features(text.as_py(), buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["b", "n"])

    found = np.zeros(buckets)
    for b, n in docs.select("text").mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n")).collect():
        found[b] = n
    return found


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    p, q = target + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def good_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids labelled good (quality 1 and not toxic): all of them, or a hashed sample of about nine tenths of `most`."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    found = good.count()
    if found <= most:
        return good
    return good.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2**40)) < int(2**40 * 0.9 * most / found))


def resample(docs: DataFrame, labels: DataFrame, setting: Resampling = Resampling()) -> DataFrame:
    """doc_id, log_weight, key, kept of each row: the `share` of rows with the largest keys is kept, to the row.

    The target model counts the rows labelled good (quality 1 and not toxic), about `target_rows` of them at most, the raw
    model all rows. A row's weight is
    its mean log ratio times `length`, so long texts do not win by length; the key adds Gumbel noise from a hash of id
    and text, which makes the top rows a sample without replacement by weight. Reruns agree.

    Null and empty texts have weight 0. Rows equal in id and text have one key and stand or fall together, so with them
    the number kept may pass the share. Rows without id carry no label. Without any good label all weights are 0. An empty
    table gives an empty result; extra columns are ignored.
    """
    # At most `target_rows` ids go to every task, so texts are read where they are and none is moved.
    good = F.broadcast(good_ids(labels, setting.target_rows))
    target = _counts(docs.select("doc_id", "text").join(good, "doc_id", "left_semi"), setting.buckets)
    raw = _counts(docs, setting.buckets)
    ratio = log_ratio(target, raw, setting.smoothing) if target.any() else np.zeros(setting.buckets)
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            means = [float(table.value[f].mean()) if len(f) else 0.0 for f in (features(t.as_py(), setting.buckets) for t in part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(means, pa.float64())], ["doc_id", "u", "mean"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(setting.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    scored = docs.select("doc_id", "text", u.alias("u")).mapInArrow(run, f"doc_id {kind}, u double, mean double")
    weight = F.col("mean") * setting.length
    keyed = cut_lineage(scored.select("doc_id", weight.alias("log_weight"), (weight - F.log(-F.log("u"))).alias("key")))
    cut = _cut(keyed, setting)
    return keyed.withColumn("kept", F.col("key") >= F.lit(cut))


def _cut(keyed: DataFrame, setting: Resampling) -> float:
    """The smallest key kept. Counts in equal ranges, narrowed to the range that holds the cut until it holds one key: only counts reach the driver."""
    first = keyed.agg(F.count("*"), F.min("key"), F.max("key")).first()
    want = math.ceil(setting.share * first[0])
    low, high, above = first[1], first[2], 0
    if not want:
        return math.inf
    parts = 2**setting.cut_bits
    while low < high:
        width = (high - low) / parts
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(parts - 1)) if width > 0 else F.lit(0)
        inside = keyed.filter((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        rows = inside.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("p")).collect()
        for r in rows:
            if above + r["n"] >= want:
                break
            above += r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high = r["low"], r["high"]
    return low
