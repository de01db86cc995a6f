"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, n_words

_BUCKETS = 4096
#: Rows of a plan that go to every task (some 100 bytes each); a larger one is joined by key and salt.
_PLAN_ROWS = 200_000
_SALTS = 32


@dataclass(frozen=True)
class Mixture:
    """`weights` go round the sources in code point order (null last); `share` is the mix's size over all sizes."""

    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    most_copies: int = 2
    seed: str = "mix"


def _draw(df: DataFrame, mixture: Mixture) -> Column:
    """A number in (0, 1) that depends on a row's id, source and text alone."""
    parts = [F.coalesce(df[c].cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(mixture.seed), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, mixture: Mixture) -> DataFrame:
    """Target per source from rows (source, size): source, source_size, target.

    Targets are min(limit, weight x level), where one level makes them sum to the mix. With the sources in order of
    limit / weight, the level is the largest of "what is left after the limits of all before, over the weight of all
    from here on": it rises while sources reach their limit and falls afterwards. Works on one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in mixture.weights])
    ranked = per_source.select(
        "source",
        "source_size",
        F.element_at(weights, (F.row_number().over(in_order) - 1) % len(mixture.weights) + 1).alias("w"),
        (F.sum("source_size").over(everything).cast("double") * mixture.share).alias("mix"),
        (F.col("source_size") * float(mixture.most_copies)).alias("limit"),
    )
    filling = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.col("mix") - before) / from_here)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least(F.col("limit"), F.col("w") * level).alias("target"))


def _place(draw: Column, chance: Column) -> Column:
    """Pareto order: random odds over inclusion odds, mapped from (0, inf) to (0, 1)."""
    odds = draw / (1 - draw) * (1 - chance)
    return odds / (odds + chance)


def _bits(size: Column) -> Column:
    """Binary digits of a size, 1 for 0: the class of a document's size."""
    return F.length(F.bin(size))


def _with_plan(rows: DataFrame, plan: DataFrame, keys: dict[str, str]) -> DataFrame:
    """`rows` with the row of `plan` that has their keys (null-safe), where they are while the plan is small.

    A larger plan meets the rows by key and a salt, so that a source with a third of all rows is dealt over many tasks.
    """
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()]
    if plan.count() <= _PLAN_ROWS:
        return rows.join(F.broadcast(plan), same)
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    salted = rows.withColumn("__row_salt", F.floor(F.col("draw") * 2**20).cast("int") % _SALTS)
    return salted.join(plan.withColumn("__salt", salts), [*same, F.col("__row_salt") == F.col("__salt")]).drop("__row_salt", "__salt")


def _chances(classes: DataFrame, mixture: Mixture) -> DataFrame:
    """Per source and class of size: __source, __bits, source_size, target, whole copies, the words still to be found, and the chance of one more copy.

    The chance grows with the binary digits of the size, up to 1: min(1, digits x level), where one level in each source
    makes the chances times the sizes sum to the words needed. The level is found as in `targets`, classes of most digits first.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = targets(classes, mixture).select(
        F.col("source").alias("__source"),
        "source_size",
        "target",
        F.least(F.floor(ratio), F.lit(mixture.most_copies)).cast("int").alias("whole"),
    )
    shares = shares.withColumn(
        "need", F.when(F.col("whole") < mixture.most_copies, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    )
    largest_first = Window.partitionBy("__source").orderBy(F.col("bits").desc())
    before = F.coalesce(F.sum("size").over(largest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum(F.col("bits") * F.col("size")).over(largest_first.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(Window.partitionBy("__source"))
    return (
        classes.join(shares, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("level", F.when(from_here > 0, (F.col("need") - before) / from_here))
        .withColumn("chance", F.when(F.col("need") > 0, F.coalesce(F.least(F.lit(1.0), F.col("bits") * level), F.lit(0.0))).otherwise(0.0))
        .select("__source", F.col("bits").alias("__bits"), "source_size", "target", "whole", "need", "chance")
    )


def _plan(narrow: DataFrame, mixture: Mixture) -> DataFrame:
    """What `_chances` has, and `last`: the place up to which a source's documents get their further copy. At most 64 rows a source."""
    classes = cut_lineage(narrow.groupBy("source", "bits").agg(F.sum("size").alias("size")))
    chances = cut_lineage(_chances(classes, mixture))
    placed = (
        _with_plan(narrow, chances.filter("chance > 0"), {"source": "__source", "bits": "__bits"})
        .select("__source", "size", "need", "draw", _place(F.col("draw"), F.col("chance")).alias("place"))
        .withColumn("bucket", F.floor(F.col("place") * _BUCKETS))
    )
    # First by buckets, at most _BUCKETS rows a source; then exactly, inside the one bucket of each source that holds the cut.
    by_bucket = Window.partitionBy("__source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = placed.groupBy("__source", "bucket", "need").agg(F.sum("size").alias("words"))
    cut = cut_lineage(
        buckets.withColumn("upto", F.sum("words").over(by_bucket))
        .filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need")))
        .select(F.col("__source").alias("__cut"), F.col("bucket").alias("cut_bucket"), (F.col("upto") - F.col("words")).alias("below"))
    )
    inside = _with_plan(placed, cut, {"__source": "__cut", "bucket": "cut_bucket"})
    by_place = Window.partitionBy("__cut").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        inside.groupBy("__cut", "cut_bucket", "below", "need", "place")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(by_place), F.lit(0)))
        .groupBy("__cut", "cut_bucket")
        # A row is given if the mix comes nearer to its target with it.
        .agg(F.max(F.when(2 * F.col("before") + F.col("words") <= 2 * F.col("need"), F.col("place"))).alias("last"))
        .select("__cut", F.coalesce("last", F.col("cut_bucket") / F.lit(float(_BUCKETS))).alias("last"))
    )
    return cut_lineage(
        chances.join(last, F.col("__source").eqNullSafe(F.col("__cut")), "left").select(
            "__source", "__bits", "source_size", "target", "whole", "chance", F.coalesce("last", F.lit(1.0)).alias("last")
        )
    )


def mix(docs: DataFrame, mixture: Mixture = Mixture(), materialise: bool = False) -> DataFrame:
    """How often each document goes into the mix: doc_id, size, source_size, target, taken, copies, source.

    A source whose target is r times its size gets floor(r) whole copies of each document. The rest of the target is
    filled by Pareto order sampling with inclusion chances of the documents' own: they grow with the binary digits of a
    document's size, and a document whose chance reaches 1 is certain. Documents are ranked by random odds over inclusion
    odds, and taken from the front as long as the source's words come nearer to its target. The fixed size of the sample
    is thus measured in words. The random number is a hash of seed, id, source and text, so reruns agree.

    Null text counts as size 0, a very long one by all its words, and an empty table gives an empty result. Null sources
    are one source. Rows equal in id, source and text share one decision, each is counted. Extra columns are ignored, or
    with `materialise` kept: then the documents themselves return, each as often as it was taken. The plan has at most 64
    rows a source; documents are not moved while it is small. Bound: one row per source fits one task.
    """
    narrow = cut_lineage(
        docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), _draw(docs, mixture).alias("draw")).withColumn("bits", _bits(F.col("size")))
    )
    plan = _plan(narrow, mixture)
    copies = F.col("whole") + F.when((F.col("chance") > 0) & (_place(F.col("draw"), F.col("chance")) <= F.col("last")), 1).otherwise(0)
    keys = {"source": "__source", "bits": "__bits"}
    if materialise:
        plan = plan.select("__source", "__bits", "whole", "chance", "last")
        every = docs.select(
            *[docs[c].alias(f"__in_{i}") for i, c in enumerate(docs.columns)],
            docs["source"].alias("source"), _bits(n_words(docs["text"])).alias("bits"), _draw(docs, mixture).alias("draw"),
        )
        taken = _with_plan(every, plan, keys).withColumn("copies", copies).filter("copies > 0")
        repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        return repeated.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)])
    joined = _with_plan(narrow, plan, keys).withColumn("copies", copies)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "chance", "source")


#: The same rule for DuckDB, with one window over each whole source in place of buckets.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS mix, source_size * 2.0::DOUBLE AS limit_ FROM sources),
levels AS (
  SELECT *, (mix - coalesce(sum(limit_) OVER (ORDER BY limit_ / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY limit_ / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
shares AS (SELECT source, source_size, least(limit_, w * max(level) OVER ()) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio,
    least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END), 2)::INT AS whole FROM shares),
needs AS (SELECT *, CASE WHEN whole < 2 THEN target - whole * source_size ELSE 0.0 END AS need FROM plan),
classes AS (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM rows GROUP BY ALL),
steps AS (
  SELECT n.*, c.bits,
    (need - coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(sum(bits * words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM classes c JOIN needs n ON c.source IS NOT DISTINCT FROM n.source),
chances AS (
  SELECT *, CASE WHEN need > 0 THEN coalesce(least(1.0::DOUBLE, bits * max(level) OVER (PARTITION BY source)), 0.0) ELSE 0.0 END AS chance FROM steps),
placed AS (
  SELECT r.*, c.source_size, c.target, c.whole, c.chance, c.need,
    CASE WHEN chance > 0 THEN draw / (1 - draw) * (1 - chance) / (draw / (1 - draw) * (1 - chance) + chance) END AS place
  FROM rows r JOIN chances c ON r.source IS NOT DISTINCT FROM c.source AND length(bin(r.size)) = c.bits),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY source, place) AS tied FROM placed),
counted AS (
  SELECT *, whole + CASE WHEN place IS NOT NULL AND 2 * (upto - tied) + tied <= 2 * need THEN 1 ELSE 0 END AS copies FROM summed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies, chance, source FROM counted
"""
