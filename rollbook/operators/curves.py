"""Evaluation tables of a binary score.

What needs an order starts from `score_table`: one row per distinct score with its counts and
running counts from the highest score down. It is built once, from one pass over the
scored rows that collapses equal scores before the shuffle, and is written to the
checkpoint folder, so the many tables below do not read the scored rows again.
Tables by bins and thresholds take it too, or the plain `score_rows`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.functions.bins import edge_at, edges_passed, even_edges
from rollbook.functions.ordering import RANGE, cut_lineage, descending_totals, range_edges, running_totals, with_range


def score_table(df: DataFrame, score: str, label: str | None = None) -> DataFrame:
    """(score, n, pos, place, cum_n, cum_pos, total_n, total_pos, next_n, next_pos) per distinct score.

    `place` numbers the scores from the highest down. Running counts include the row itself and all higher scores;
    the next counts are those of the next lower score, null in the last row. For scores and labels see `score_rows`.
    The scores are read twice: for a sketch of their quantiles, which fixes the ranges, and for the counts.
    """
    rows = score_rows(df, score, label)
    counts = (
        with_range(rows, "score", range_edges(rows, "score"))
        .groupBy(RANGE, "score")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.lit(1).cast("bigint").alias("__one"))
    )
    ranked = descending_totals(counts, "score", {"n": "n", "pos": "pos", "__one": "rank"}, {"n": "next_n", "pos": "next_pos"})
    return cut_lineage(
        ranked.select("score", "n", "pos", F.col("cum_rank").alias("place"), "cum_n", "cum_pos", "total_n", "total_pos", "next_n", "next_pos")
    )


def score_rows(df: DataFrame, score: str, label: str | None = None) -> DataFrame:
    """(score, n, pos) per row, as a plain table of counts: enough for bins, sweeps, confusion and error histograms.

    These need no order, so one scan and a shuffle of one row per bin do. A null or NaN score and a label other
    than 0 or 1 are errors; without a label all counts of positives are 0.
    """
    given = F.col(score).cast("double")
    empty = given.isNull() | F.isnan(given)
    value = F.when(empty, F.raise_error(F.lit(f"{score} must be a number in every row"))).otherwise(given + F.lit(0.0))  # one zero only
    if label is None:
        positive = F.lit(0)
    else:
        y = F.col(label).cast("int")
        positive = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit(f"{label} must be 0 or 1")))
    return df.select(value.alias("score"), F.lit(1).cast("bigint").alias("n"), positive.cast("bigint").alias("pos"))


def _ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    fallback = F.lit(empty).cast("double")
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(fallback)


def _recall() -> Column:
    # Without positives recall is 1 everywhere on the curve.
    return _ratio(F.col("cum_pos"), F.col("total_pos"), 1.0)


def _precision() -> Column:
    return _ratio(F.col("cum_pos"), F.col("cum_n"))


def curve_points(table: DataFrame) -> DataFrame:
    """(threshold, precision, recall) per distinct score, without the end point."""
    return table.select(F.col("score").alias("threshold"), _precision().alias("precision"), _recall().alias("recall"))


def pr_curve(table: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, plus the end point without a threshold."""
    end = table.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve_points(table).unionByName(end)


def roc_curve(table: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) from (0, 0) on; by default without points on a straight stretch."""
    points = table
    if drop_intermediate:
        points = table.filter(
            F.col("next_n").isNull()  # last point
            | (F.col("cum_n") == F.col("n"))  # first point
            | (F.col("next_n") - F.col("next_pos") != F.col("n") - F.col("pos"))
            | (F.col("next_pos") != F.col("pos"))
        )
    negatives = F.col("total_n") - F.col("total_pos")
    curve = points.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_n") - F.col("cum_pos"), negatives, None).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("total_pos"), None).alias("tpr"),
    )
    start = table.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def _area_terms() -> dict[str, Column]:
    """Aggregates over the score table; each score adds its own slice of an area."""
    before_n, before_pos = F.col("cum_n") - F.col("n"), F.col("cum_pos") - F.col("pos")
    negative = F.col("n") - F.col("pos")
    any_pos = F.col("total_pos") > 0
    step = F.col("pos") / F.col("total_pos")
    slices = F.sum(negative * (before_pos + F.col("pos") / 2.0))
    positives, negatives = F.sum("pos"), F.sum(negative)
    return {
        "roc_auc": F.when(
            (positives > 0) & (negatives > 0), slices / (positives.cast("double") * negatives.cast("double"))
        ),
        "pr_auc": F.sum(
            F.when(any_pos, step * (_precision() + _ratio(before_pos, before_n, 1.0)) / 2.0)
            # Recall is 1 at every score then: the only slice is the one from the top score to the end point.
            .when(before_n == 0, (_precision() + 1.0) / 2.0)
            .otherwise(0.0)
        ),
        "avg_precision": F.sum(F.when(any_pos, step * _precision()).otherwise(0.0)),
    }


def areas(table: DataFrame) -> DataFrame:
    """One row: roc_auc, pr_auc (trapezoids) and avg_precision (steps)."""
    return table.agg(*[term.alias(name) for name, term in _area_terms().items()])


def auc_roc(table: DataFrame) -> DataFrame:
    """Area under the ROC curve; no value if one class is missing."""
    return areas(table).select("roc_auc")


def auc_pr(table: DataFrame) -> DataFrame:
    """Trapezoid area under the precision-recall curve."""
    return areas(table).select("pr_auc")


def avg_precision(table: DataFrame) -> DataFrame:
    """Sum of precision times the gain in recall."""
    return areas(table).select("avg_precision")


def recall_at_k(
    df: DataFrame,
    score: str,
    label: str,
    id: str,
    points: int = v.RECALL_POINTS,
    cap: bool = True,
    table: DataFrame | None = None,
) -> DataFrame:
    """(point, k, cut, recall, lift) over the top `cut` rows by (score descending, id ascending).

    `cap` limits the number of points to the number of rows. Cuts that fall between two
    scores are read off the score table. Only where a cut divides rows of equal score
    and mixed labels are those rows ranked by id, in balanced ranges.
    """
    table = score_table(df, score, label) if table is None else table
    head = table.select("total_n", "total_pos").first()
    if head is None:
        raise ValueError("no rows to evaluate")
    total, positives = head.total_n, head.total_pos
    points = min(total, points) if cap else points
    last = max(points - 1, 1)
    spark = df.sparkSession

    def k_at(i: Column) -> Column:
        if cap:
            return i.cast("double") / F.lit(float(last))
        # Even spacing by a common step, with the last point exactly 1.
        return F.when(i == last, 1.0).otherwise(i.cast("double") * F.lit(1.0 / last))

    def cut_at(i: Column) -> Column:
        return F.floor(F.lit(float(total)) * k_at(i)).cast("bigint")

    # The points whose cut lies in (before, cum_n]: a guess one wider on each side, then the exact test.
    before = F.col("cum_n") - F.col("n")
    low = F.greatest(F.floor(before * F.lit(last / total)) - 1, F.lit(0)).cast("bigint")
    high = F.least(F.ceil((F.col("cum_n") + 1) * F.lit(last / total)) + 1, F.lit(points - 1)).cast("bigint")
    placed = table.select(
        "score",
        "n",
        "pos",
        before.alias("before_n"),
        (F.col("cum_pos") - F.col("pos")).alias("before_pos"),
        F.explode(
            F.filter(
                F.sequence(low, high),
                lambda i: (cut_at(i) > F.col("cum_n") - F.col("n")) & (cut_at(i) <= F.col("cum_n")),
            )
        ).alias("point"),
    ).withColumn("need", cut_at(F.col("point")) - F.col("before_n"))
    plain = (F.col("need") == F.col("n")) | (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    hits = F.when(F.col("need") == F.col("n"), F.col("pos")).when(F.col("pos") == 0, 0).otherwise(F.col("need"))
    known = placed.filter(plain).select("point", (F.col("before_pos") + hits).alias("hits"))
    none = spark.range(points).filter(cut_at(F.col("id")) == 0).select(F.col("id").alias("point"), F.lit(0).cast("bigint").alias("hits"))
    found = known.unionByName(none)

    mixed = placed.filter(~plain)
    if not mixed.isEmpty():
        found = found.unionByName(_hits_in_ties(df, score, label, id, mixed))
    k = k_at(F.col("point"))
    recall = _ratio(F.col("hits"), F.lit(positives))
    return found.select(
        F.col("point").cast("bigint").alias("point"),
        k.alias("k"),
        cut_at(F.col("point")).alias("cut"),
        recall.alias("recall"),
        (recall - k).alias("lift"),
    )


def _hits_in_ties(df: DataFrame, score: str, label: str, id: str, mixed: DataFrame) -> DataFrame:
    """(point, hits) for cuts inside groups of equal score with both labels."""
    # At most one score per point, so at most as many rows as there are points.
    scores = mixed.select("score", "n", "pos").distinct()
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = scores.select(
        "score",
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base_n"),
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("base_pos"),
    )
    rows = df.select(
        F.col(score).cast("double").alias("score"),
        F.col(id).alias("__id"),
        F.lit(1).alias("one"),
        F.col(label).cast("int").alias("y"),
    ).join(F.broadcast(scores.select("score")), "score", "left_semi")
    ranked = running_totals(rows, [F.col("score").desc(), F.col("__id").asc()], {"one": "rank", "y": "y"})
    wanted = mixed.join(F.broadcast(bases), "score").select(
        "point", "before_pos", "base_pos", (F.col("base_n") + F.col("need")).alias("cum_rank")
    )
    return ranked.join(F.broadcast(wanted), "cum_rank").select(
        "point", (F.col("before_pos") + F.col("cum_y") - F.col("base_pos")).alias("hits")
    )


def confusion(table: DataFrame, threshold: float | Column) -> DataFrame:
    """One row (tn, fp, fn, tp) for `score >= threshold`."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged = F.col("score") >= t
    negative = F.col("n") - F.col("pos")
    count = lambda value, where: F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("bigint")
    return table.agg(
        count(negative, ~flagged).alias("tn"),
        count(negative, flagged).alias("fp"),
        count(F.col("pos"), ~flagged).alias("fn"),
        count(F.col("pos"), flagged).alias("tp"),
    )


def _at(threshold: float) -> tuple[Column, Column]:
    """Aggregates over the score table: precision and recall of `score >= threshold`."""
    flagged = F.col("score") >= F.lit(float(threshold))
    tp = F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0))
    shown = F.coalesce(F.sum(F.when(flagged, F.col("n"))), F.lit(0))
    return _ratio(tp, shown), _ratio(tp, F.coalesce(F.sum("pos"), F.lit(0)))


def metrics_at(table: DataFrame, thresholds: Mapping[str, float | None]) -> DataFrame:
    """(name, threshold, precision, recall) for named thresholds; names without a value are skipped."""
    rows = []
    for name, t in thresholds.items():
        if t is not None:
            precision, recall = _at(t)
            rows.append(
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(float(t)).alias("threshold"),
                    precision.alias("precision"),
                    recall.alias("recall"),
                )
            )
    if not rows:
        raise ValueError("no threshold has a value")
    return table.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def summary_at(table: DataFrame, threshold: float) -> DataFrame:
    """One row (prevalence, threshold, precision, recall, auc, ap) in one pass."""
    precision, recall = _at(threshold)
    area = _area_terms()
    return table.agg(
        (F.sum("pos") / F.sum("n")).alias("prevalence"),
        F.lit(float(threshold)).alias("threshold"),
        precision.alias("precision"),
        recall.alias("recall"),
        area["roc_auc"].alias("auc"),
        area["avg_precision"].alias("ap"),
    )


def calibration_bins(table: DataFrame, bins: int = v.CALIBRATION_BINS) -> DataFrame:
    """(bin, n, mean_score, positive_rate) of the non-empty uniform bins; edges belong to the lower bin."""
    inner = even_edges(0.0, 1.0, bins + 1)[1:-1]
    score = F.when(F.col("score").between(0.0, 1.0), F.col("score")).otherwise(
        F.raise_error(F.lit("scores must lie between 0 and 1"))
    )
    bin_of = edges_passed(score, inner, inclusive=False) if inner else F.lit(0)
    return (
        table.select(bin_of.alias("bin"), "score", "n", "pos")
        .groupBy("bin")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"),
            (F.sum("pos") / F.sum("n")).alias("positive_rate"),
        )
    )


def sweep(table: DataFrame, points: int = v.SWEEP_POINTS) -> DataFrame:
    """(threshold, tp, fp, fn, tn) at even thresholds from 0 to 1.

    Every score is put between two thresholds first, so the table is reduced to at most
    `points` + 1 rows before the running sums.
    """
    edges = even_edges(0.0, 1.0, points)
    passed = edges_passed(F.col("score"), edges)
    spark = table.sparkSession
    steps = table.groupBy(passed.alias("passed")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    grid = spark.range(points + 1).select(F.col("id").cast("int").alias("passed"))
    full = grid.join(F.broadcast(steps), "passed", "left").fillna(0, ["n", "pos"])
    # Rows with passed > i are those with score >= threshold i.
    above = Window.orderBy(F.col("passed").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("passed").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = full.select(
        edge_at(edges, F.col("passed") - 1).alias("threshold"),
        "passed",
        F.sum("pos").over(above).alias("tp"),
        (F.sum("n").over(above) - F.sum("pos").over(above)).alias("fp"),
        F.sum("pos").over(whole).alias("all_pos"),
        F.sum("n").over(whole).alias("all_n"),
    ).filter(F.col("passed") > 0)
    return sums.select(
        "threshold",
        "tp",
        "fp",
        (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_n") - F.col("all_pos") - F.col("fp")).alias("tn"),
    )


def ppv_npv(table: DataFrame, points: int = v.SWEEP_POINTS) -> DataFrame:
    """(threshold, ppv, npv); no value where nothing is flagged, or everything is."""
    return sweep(table, points).select(
        "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp"), None).alias("ppv"),
        _ratio(F.col("tn"), F.col("tn") + F.col("fn"), None).alias("npv"),
    )


def flag_rate(table: DataFrame, points: int = v.SWEEP_POINTS) -> DataFrame:
    """(threshold, rate): share of rows with a score at or above the threshold; needs no label."""
    flagged = F.col("tp") + F.col("fp")
    return sweep(table, points).select(
        "threshold", _ratio(flagged, flagged + F.col("fn") + F.col("tn"), None).alias("rate")
    )


def histogram(
    df: DataFrame, column: str, bins: int = v.HISTOGRAM_BINS, by: str | None = None, weight: str | None = None
) -> DataFrame:
    """([by], bin, low, high, n) over even bins from the smallest to the largest value.

    All values of `by` share the edges; empty bins are left out. `weight` counts a row
    that often. A null, NaN or infinite value is an error.
    """
    x = F.col(column).cast("double")
    odd = F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high"), odd.alias("odd")).first()
    if ends.odd:
        raise ValueError(f"{column} must be a finite number in every row, {ends.odd} are not")
    low, high = ends.low, ends.high
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = even_edges(low, high, bins + 1)
    keys = [by] if by else []
    placed = df.select(
        *keys,
        # The largest value belongs to the last bin.
        F.least(edges_passed(x, edges) - 1, F.lit(bins - 1)).alias("bin"),
        (F.col(weight) if weight else F.lit(1)).alias("__w"),
    )
    counts = placed.groupBy(*keys, "bin").agg(F.sum("__w").cast("bigint").alias("n"))
    return counts.select(
        *keys, "bin", edge_at(edges, F.col("bin")).alias("low"), edge_at(edges, F.col("bin") + 1).alias("high"), "n"
    )


def error_score(score: Column, label: Column, signed: bool = False) -> Column:
    """`s - 1` for positives and `1 - s` for negatives; with `signed`, score minus label."""
    return score - label if signed else F.when(label == 1, score - 1).otherwise(F.lit(1.0) - score)


def labelled_counts(table: DataFrame, label: str = v.LABEL) -> DataFrame:
    """The score table as rows (score, label, n), for tables by label."""
    return table.select(
        "score",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("n")),
                F.struct(F.lit(1).alias("y"), F.col("pos").alias("n")),
            )
        ).alias("__c"),
    ).select("score", F.col("__c.y").alias(label), F.col("__c.n").alias("n")).filter("n > 0")


def error_histogram(table: DataFrame, label: str = v.LABEL, bins: int = v.HISTOGRAM_BINS, signed: bool = False) -> DataFrame:
    """Histogram of the error score by label."""
    errors = labelled_counts(table, label).withColumn(
        "error", error_score(F.col("score"), F.col(label), signed)
    )
    return histogram(errors, "error", bins, by=label, weight="n")
