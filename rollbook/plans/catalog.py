"""Named queries over the driver's tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import vocabulary as v
from rollbook.functions.ordering import cut_lineage, use_checkpoint_dir
from rollbook.operators import (
    attribution, calibration, cleaning, curves, encoding, estimator, explanation, model, sampling, sequence, thresholds, yearly,
)
from rollbook.plans import catalog_data as data
from rollbook.plans.explaining import explain
from rollbook.sources import calendar, contract, frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- sources -----------------------------------------------------------------


@query
def year_and_grade(spark, folder):
    orders = data.table(spark, folder, "orders")
    year = calendar.year_name(calendar.year_start(F.col("o_orderdate")))
    path = F.concat(F.lit("/data/ay"), year, F.lit("_grade"), F.col("o_orderkey") % 12 + 1, F.lit(".parquet"))
    return contract.with_year_and_grade(orders.select("o_orderkey", path.alias("path")), F.col("path"))


def _scratch(spark):
    """A folder of this query's own, which all executors share."""
    return f"{use_checkpoint_dir(spark)}/catalog/{uuid.uuid4()}"


def _first_days(months):
    """Marks of the first of each month, by column."""
    return [F.substring("days", sequence.calendar_position(m, 1) + 1, 1).alias(f"{m}_1") for m in months]


@query
def read_years(spark, folder):
    """Two years with other day columns each, written under a path of their own and read back as one table."""
    path, rows = _scratch(spark), cut_lineage(data.unified_customers(spark, folder))
    own = [_student().alias("studentid"), F.col("target").cast("bigint").alias("target")]
    for year, months, grade in ((1996, (6, 9), 1), (1997, (9, 1), 12)):
        part = rows.filter(F.col("year") == year).select(*own, *_first_days(months))
        part.write.parquet(f"{path}/ay{year % 100}{year % 100 + 1}_grade{grade}.parquet")
    read = contract.read_unified(spark, f"{path}/*.parquet", contract=data.customer_contract())
    return read.select("studentid", "target", "6_1", "9_1", "1_1", "acad_year", "grade")


@query
def frames_round_trip(spark, folder):
    """Splits written as frames and read back, the split from the path."""
    path = _scratch(spark)
    halves = sampling.stratified_split(data.scored_orders(spark, folder), "label", "id", 0.7, 42)
    frames.write_frames(dict(zip(("train", "val"), halves)), path)
    return spark.read.parquet(path).select("split", "id", "score", "label")


@query
def scores_round_trip(spark, folder):
    path = _scratch(spark)
    frames.write_scores(data.scored_orders(spark, folder), path)
    return spark.read.csv(path, header=True, schema="id bigint, score double, label int")


@query
def metrics_round_trip(spark, folder):
    path = _scratch(spark)
    frames.write_metrics(frames.metrics_long(curves.confusion(_counts(spark, folder), 0.5), "orders"), path)
    return spark.read.schema("split string, metric string, value double").json(path)


@query
def feature_kinds(spark, folder):
    """The features of the unified table by kind, each with its number of values."""
    rows = data.unified_customers(spark, folder).drop(*data.ENROLMENT)
    kinds = dict(zip(("categorical", "numerical"), cleaning.split_features(rows, None, "target")))
    counted = rows.agg(*[F.count(c).alias(c) for names in kinds.values() for c in names])
    kind_of = F.when(F.col("feature").isin(kinds["categorical"]), "categorical").otherwise("numerical")
    return counted.unpivot([], counted.columns, "feature", "n").select("feature", kind_of.alias("kind"), "n")


@query
def holidays(spark, folder):
    """A calendar document per year, made from the order dates: Sundays, the 25ths and one odd month."""
    date = F.col("o_orderdate")
    days = data.table(spark, folder, "orders").select(
        calendar.year_name(calendar.year_start(date)).alias("acad_year"),
        F.month(date).cast("string").alias("month"),
        F.dayofmonth(date).alias("day"),
        (F.dayofweek(date) == 1).alias("sunday"),
    )
    kinds = days.select(
        "acad_year",
        "month",
        "day",
        F.explode(
            F.filter(
                F.array(F.when(F.col("sunday"), "sundays"), F.when(F.col("day") == 25, "festive")), lambda x: x.isNotNull()
            )
        ).alias("kind"),
    ).distinct()
    per_kind = kinds.groupBy("acad_year", "month", "kind").agg(F.sort_array(F.collect_list("day")).alias("days"))
    per_month = per_kind.groupBy("acad_year", "month").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "days"))).alias("kinds")
    )
    document = per_month.groupBy("acad_year").agg(
        F.to_json(
            F.map_from_entries(
                F.array(
                    F.struct(
                        F.col("acad_year"),
                        F.map_concat(
                            F.map_from_entries(F.collect_list(F.struct("month", "kinds"))),
                            F.create_map(F.lit("13"), F.create_map(F.lit("odd"), F.array(F.lit(1)))),
                        ),
                    )
                )
            )
        ).alias("document")
    )
    return calendar.holidays_from_json(document, "document")


@query
def metrics_long(spark, folder):
    flat = curves.confusion(_counts(spark, folder), 0.5)
    return frames.metrics_long(flat, "orders")


# --- cleaning ----------------------------------------------------------------


@query
def recode(spark, folder):
    mapping = contract.status_map(data.EVENT_MEANING)
    events = data.table(spark, folder, "events").withColumn("status", F.col("event_type"))
    return (
        cleaning.recode_status(events, ["status"], mapping)
        .groupBy("event_type", "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def lower_names(spark, folder):
    events = data.table(spark, folder, "events")
    return cleaning.lower_names(events.toDF(*[c.upper() for c in events.columns]))


@query
def dedup_first(spark, folder):
    return cleaning.dedup_first(data.table(spark, folder, "orders"), "o_custkey", "o_orderkey")


@query
def cast_to_contract(spark, folder):
    customer = data.table(spark, folder, "customer")
    rules = {
        "c_acctbal": ["float", "balance"],
        "c_nationkey": ["string", "nation"],
        "c_custkey": ["int", "key"],
        "c_mktsegment": ["string", "segment"],
    }
    text = customer.withColumns({c: F.col(c).cast("string") for c in ("c_acctbal", "c_custkey")})
    return cleaning.cast_to_contract(text, rules)


def _exam_rows(spark, folder):
    quantity = F.col("l_quantity")
    score = F.when(quantity > 40, None).when(quantity > 35, float("nan")).when(quantity < 5, 0.0).otherwise(quantity)
    return data.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", score.alias("maths_score"), F.lit(None).cast("string").alias("maths_attnd")
    )


@query
def exam_rectify(spark, folder):
    rows = cleaning.rectify_exam_attendance(_exam_rows(spark, folder), ["maths_attnd"])
    return cleaning.fill_exam_scores(rows, ["maths_score"])


@query
def fill_training_means(spark, folder):
    """Rows of later years, cleaned with the means of the earlier ones."""
    rows = data.unified_customers(spark, folder).select(
        _student().alias("studentid"), "target", "nation", "segment", "balance", "urgent_score", "low_score", "year"
    )
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("urgent_attnd", "low_attnd")}).withColumn("arrival", F.col("studentid"))
    rows = cut_lineage(rows)
    rules = {k: e for k, e in data.customer_contract().items() if k in rows.columns}
    early, late = rows.filter("year < 1998").drop("year"), rows.filter("year >= 1998").drop("year")
    _, _, means = cleaning.preprocess(early, rules, {}, "arrival")
    clean, _, _ = cleaning.preprocess(late, rules, {}, "arrival", means=means)
    return clean.select("studentid", F.round("balance", 6).alias("balance"), "urgent_score", "urgent_attnd")


@query
def dedup_first_ties(spark, folder):
    """One row per customer of the smallest date, which several orders may share and some lack."""
    orders = data.table(spark, folder, "orders")
    key = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate").cast("date").cast("string"))
    rows = orders.select("o_custkey", key.alias("day"), (F.col("o_totalprice") > 0).alias("priced"))
    return cleaning.dedup_first(rows, "o_custkey", "day")


@query
def fill_status_and_text(spark, folder):
    events = data.table(spark, folder, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("status"),
        F.when(F.col("value") > 50, F.col("props")).alias("props"),
    )
    return cleaning.fill_strings(cleaning.fill_status(events, ["status"]), ["props"])


@query
def fill_mean(spark, folder):
    value = F.when(F.col("l_tax") > 0.05, None).when(F.col("l_tax") < 0.02, float("nan")).otherwise(F.col("l_tax"))
    rows = data.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", value.alias("tax"), F.col("l_discount").alias("discount")
    )
    filled = cleaning.fill_float_means(rows, ["tax", "discount"])
    return filled.withColumns({c: F.round(c, 9) for c in ("tax", "discount")})


@query
def column_filters(spark, folder):
    return cleaning.apply_filters(
        data.table(spark, folder, "customer"),
        {
            "in": {"c_mktsegment": ["BUILDING", "HOUSEHOLD", "MACHINERY"], "no_such_column": ["x"]},
            "notin": {"c_nationkey": [1, 2, 3], "c_mktsegment": ["MACHINERY"]},
        },
    )


@query
def drop_columns(spark, folder):
    return cleaning.drop_columns(
        data.table(spark, folder, "customer"), ["money", "c_name", "no_such_column"], {"money": ["c_acctbal"]}
    )


@query
def quality_report(spark, folder):
    orders = data.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("studentid"),
        F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").otherwise("2").alias("target"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("6_1"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice").cast("string")).otherwise("cheap").alias("price"),
    )
    rules = {
        "studentid": ["string", "customer"],
        "target": ["int", "label"],
        "6_1": ["string", "day", "all_attendances"],
        "price": ["float", "price", "money"],
    }
    known = {"1-URGENT": "p", "2-HIGH": "p"}
    return cleaning.quality_report(orders, rules, "studentid", "target", known)


@query
def quality_while_cleaning(spark, folder):
    """The counts of a quality report from the pass that writes the cleaned rows."""
    orders = data.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("studentid"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("target"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("6_1"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"),
        F.col("o_orderkey").alias("arrival"),
    )
    rules = {
        "studentid": ["string", "customer"],
        "target": ["int", "label"],
        "6_1": ["string", "day", "all_attendances"],
        "price": ["float", "price", "money"],
    }
    watch = cleaning.QualityWatch()
    clean, _, _ = cleaning.preprocess(orders, rules, {"1-URGENT": "p", "2-HIGH": "p"}, "arrival", watch=watch)
    clean.write.parquet(_scratch(spark))
    return watch.report()


def _student():
    """One student per customer and year."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in data.ENROLMENT])


@query
def preprocess(spark, folder):
    # The first day of every month, marked as in the events.
    days = [
        F.when(mark == "p", "click").when(mark == "a", "error").alias(f"{month}_1")
        for month in range(1, 13)
        for mark in [F.substring("days", sequence.calendar_position(month, 1) + 1, 1)]
    ]
    rows = data.unified_customers(spark, folder).select(
        _student().alias("STUDENTID"),
        F.col("target"),
        F.col("nation"),
        F.col("segment"),
        F.col("balance"),
        F.col("urgent_score"),
        F.lit(None).cast("string").alias("urgent_attnd"),
        F.col("low_score"),
        F.lit(None).cast("string").alias("low_attnd"),
        *days,
        (F.col("year") * 2**40 + F.col("o_custkey")).alias("arrival"),
    )
    clean, _, _ = cleaning.preprocess(
        rows, data.customer_contract(), contract.status_map(data.EVENT_MEANING), "arrival",
        {"notin": {"nation": ["NATION_3"]}, "in": {"segment": ["nan", "BUILDING", "HOUSEHOLD"]}},
    )
    return clean.withColumn("balance", F.round("balance", 6))


# --- enrolment ---------------------------------------------------------------


@query
def dropout_label(spark, folder):
    return data.dropouts(spark, folder)


@query
def unified_row(spark, folder):
    return data.unified_customers(spark, folder)


# --- sampling ----------------------------------------------------------------


@query
def prevalence_sample(spark, folder):
    return sampling.prevalence_sample(data.scored_orders(spark, folder), "label", 0.2, "id")


@query
def prevalence_sample_up(spark, folder):
    return sampling.prevalence_sample(data.scored_orders(spark, folder), "label", 0.5, "id")


@query
def prevalence_sample_seeded(spark, folder):
    return sampling.prevalence_sample(data.scored_orders(spark, folder), "label", 0.25, "id", seed=5)


@query
def prevalence_sample_text_key(spark, folder):
    """The first rows by a text key."""
    rows = data.scored_orders(spark, folder).withColumn("id", F.concat(F.lit("order-"), F.col("id")))
    return sampling.prevalence_sample(rows, "label", 0.2, "id")


@query
def stratified_split(spark, folder):
    halves = sampling.stratified_split(data.scored_orders(spark, folder), "label", "id", 0.7, 42)
    marked = [h.select("id", "label", F.lit(name).alias("split")) for h, name in zip(halves, ("train", "val"))]
    return marked[0].unionByName(marked[1])


@query
def split_sizes(spark, folder):
    halves = sampling.stratified_split(data.scored_orders(spark, folder), "label", "id", 0.7, 42)
    marked = [h.withColumn("split", F.lit(name)) for h, name in zip(halves, ("train", "val"))]
    return (
        marked[0].unionByName(marked[1])
        .groupBy("split", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
    )


# --- sequences ---------------------------------------------------------------


@query
def seq_build(spark, folder):
    return data.event_sequences(spark, folder)


@query
def missing_shares(spark, folder):
    return sequence.missing_shares(data.order_sequences(spark, folder))


@query
def valid_days(spark, folder):
    return sequence.valid_days(
        data.event_sequences(spark, folder), data.sundays(spark, folder), "2324", 0.08
    )


@query
def attendance_features(spark, folder):
    """The flagship: events to day statuses to all default sequence features."""
    return sequence.features_from_long(
        data.event_marks(spark, folder), "user_id", data.sundays(spark, folder), "2324"
    )


@query
def seq_pattern_overlap(spark, folder):
    config = sequence.SequenceConfig(
        month_groups={"jan": [1]}, char_combinations=[(3, ["a", "p"]), (2, ["m", "p"])], partitions=[1, 2],
        binary_months=[],
    )
    return sequence.features_from_long(
        data.event_marks(spark, folder), "user_id", data.sundays(spark, folder), "2324", config
    )


@query
def missing_shares_by_year(spark, folder):
    return yearly.missing_shares(data.order_sequences(spark, folder), "year")


@query
def valid_days_by_year(spark, folder):
    return yearly.valid_days(data.order_sequences(spark, folder), "year", data.order_holidays(spark, folder), 0.995)


def _order_groups(spark, folder, **settings):
    """Every academic year by its own valid days and holidays."""
    return yearly.features_from_long(
        data.order_marks(spark, folder), data.ENROLMENT, "year", data.order_holidays(spark, folder),
        sequence.SequenceConfig(**settings),
    )


@query
def month_groups(spark, folder):
    return _order_groups(
        spark, folder,
        month_groups={"first": [6, 7, 8], "mixed": [5, 12, 1], "none": []}, partitions=[2],
        char_combinations=[(1, ["a", "p"])], binary_months=[], absence_thresholds=[],
    )


@query
def seq_last(spark, folder):
    return _order_groups(
        spark, folder, partitions=[], binary_months=[], absence_thresholds=[]
    )


@query
def seq_binary_absence(spark, folder):
    return _order_groups(spark, folder, month_groups={}, absence_thresholds=[10, 30, 60, 400])


@query
def wide_to_long(spark, folder):
    flags = {f"1_{d}": F.max(F.when((F.dayofmonth("ts") == d) & (F.col("event_type") != "error"), "p")) for d in range(1, 32)}
    wide = data.table(spark, folder, "events").groupBy("user_id").agg(*[x.alias(n) for n, x in flags.items()])
    return sequence.to_long(wide, "user_id")


@query
def seq_from_wide(spark, folder):
    flags = {f"1_{d}": F.max(F.when((F.dayofmonth("ts") == d) & (F.col("event_type") != "error"), "p")) for d in range(1, 32)}
    wide = data.table(spark, folder, "events").groupBy("user_id").agg(*[x.alias(n) for n, x in flags.items()])
    return sequence.sequence_from_wide(wide)


# --- evaluation --------------------------------------------------------------


def _table(spark, folder, digits=None):
    return curves.score_table(data.scored_orders(spark, folder, digits), "score", "label")


def _counts(spark, folder, digits=None):
    return curves.score_rows(data.scored_orders(spark, folder, digits), "score", "label")


@query
def score_table(spark, folder):
    return _table(spark, folder, 3)


@query
def pr_curve(spark, folder):
    return curves.pr_curve(_table(spark, folder))


def _start_as_null(curve):
    """The start point's threshold, above all scores, as null, which any SQL can write."""
    return curve.withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query
def roc_curve(spark, folder):
    return _start_as_null(curves.roc_curve(_table(spark, folder)))


@query
def roc_curve_full(spark, folder):
    return _start_as_null(curves.roc_curve(_table(spark, folder, 2), drop_intermediate=False))


@query
def auc_roc(spark, folder):
    return curves.auc_roc(_table(spark, folder, 2)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query
def auc_pr(spark, folder):
    return curves.auc_pr(_table(spark, folder, 2)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query
def avg_precision(spark, folder):
    return curves.avg_precision(_table(spark, folder, 2)).select(F.round("avg_precision", 9).alias("avg_precision"))


@query
def recall_at_k(spark, folder):
    return curves.recall_at_k(data.scored_orders(spark, folder), "score", "label", "id")


@query
def recall_at_k_ties(spark, folder):
    return curves.recall_at_k(data.scored_orders(spark, folder, 1), "score", "label", "id", points=400)


@query
def recall_at_k_model(spark, folder):
    return curves.recall_at_k(data.scored_orders(spark, folder, 2), "score", "label", "id", cap=False)


@query
def confusion(spark, folder):
    return curves.confusion(_counts(spark, folder), 0.4)


@query
def metrics_at(spark, folder):
    return curves.metrics_at(_counts(spark, folder), {"low": 0.1, "high": 0.9, "none": None, "beyond": 2.0})


@query
def calibration_bins(spark, folder):
    bins = curves.calibration_bins(_counts(spark, folder, 2))
    return bins.withColumns({c: F.round(c, 9) for c in ("mean_score", "positive_rate")})


@query
def hist(spark, folder):
    return curves.histogram(data.table(spark, folder, "lineitem"), "l_extendedprice")


@query
def hist_by_label(spark, folder):
    return curves.histogram(data.scored_orders(spark, folder, 2), "score", by="label")


def _rounded_edges(df):
    return df.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query
def error_hist(spark, folder):
    return _rounded_edges(curves.error_histogram(_counts(spark, folder), "label"))


@query
def error_hist_signed(spark, folder):
    return _rounded_edges(curves.error_histogram(_counts(spark, folder), "label", signed=True))


@query
def ppv_npv(spark, folder):
    return curves.ppv_npv(_counts(spark, folder))


@query
def flag_rate(spark, folder):
    unlabelled = data.scored_orders(spark, folder, 2).drop("label")
    return curves.flag_rate(curves.score_rows(unlabelled, "score"))


@query
def best_thresholds(spark, folder):
    return thresholds.best_thresholds(data.scored_orders(spark, folder, 2), "score", "label", "id")


@query
def split_thresholds(spark, folder):
    scored = data.scored_orders(spark, folder)
    table = curves.score_table(scored, "score", "label")
    own = thresholds.split_thresholds(scored, "score", "label", "id", {"max_f1 (val)": 0.3, "max_lift (val)": None}, table)
    return curves.metrics_at(table, own)


@query
def threshold_for_recall(spark, folder):
    return thresholds.nearest_recall(_table(spark, folder), 0.4)


@query
def summary(spark, folder):
    row = thresholds.summary(_table(spark, folder))
    return row.select("prevalence", "threshold", "precision", "recall", *[F.round(c, 9).alias(c) for c in ("auc", "ap")])


@query
def isotonic(spark, folder):
    scored = data.scored_orders(spark, folder)
    fitted = calibration.fit_calibrator(scored, "score", "label")
    return calibration.calibrate(fitted, scored, "score", "calibrated").select("id", F.round("calibrated", 7).alias("calibrated"))


# --- explanation -------------------------------------------------------------


@query
def group_contrib(spark, folder):
    rows = explanation.group_contributions(data.line_values(spark, folder), data.LINE_GROUPS)
    parts = [
        F.get(f"contribs_{label}", F.lit(i))[part].alias(f"{group}_{label}_{part}")
        for label in (0, 1)
        for i, group in enumerate(data.LINE_GROUPS)
        for part in ("contrib", "top_driver")
    ]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *parts)


@query
def group_rank(spark, folder):
    rows = explanation.group_contributions(data.line_values(spark, folder), data.LINE_GROUPS)
    return explanation.rank_groups(rows, data.LINE_GROUPS).drop("contribs_0", "contribs_1", "shap", "preds_proba_1")


@query
def explained_groups(spark, folder):
    rows = explanation.explain_groups(data.line_values(spark, folder), data.LINE_GROUPS, 0.05)
    kept = [c for c in rows.columns if "_for_" not in c and c != "shap"]
    return rows.select(*kept)


# Two fixed trees of depth two over (quantity, discount); see the equivalent SQL.
FIXED_TREES = [
    [
        dict(id=0, prediction=0.0, cover=100.0, left=1, right=2, feature=0, threshold=25.0),
        dict(id=1, prediction=-1.0, cover=40.0, left=-1, right=-1, feature=-1, threshold=None),
        dict(id=2, prediction=0.5, cover=60.0, left=3, right=4, feature=1, threshold=0.05),
        dict(id=3, prediction=2.0, cover=15.0, left=-1, right=-1, feature=-1, threshold=None),
        dict(id=4, prediction=1.0, cover=45.0, left=-1, right=-1, feature=-1, threshold=None),
    ],
    [
        dict(id=0, prediction=0.0, cover=10.0, left=1, right=2, feature=1, threshold=0.03),
        dict(id=1, prediction=4.0, cover=4.0, left=-1, right=-1, feature=-1, threshold=None),
        dict(id=2, prediction=-2.0, cover=6.0, left=-1, right=-1, feature=-1, threshold=None),
    ],
]


@query
def tree_shap_fixed(spark, folder):
    trees = [attribution.tree_of(nodes, weight)[0] for nodes, weight in zip(FIXED_TREES, (1.0, 0.5))]
    rows = data.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"
    )
    inputs = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")}
    explained = attribution.tree_shap(rows, trees, inputs)
    return explained.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round("shap.quantity", 9).alias("quantity"), F.round("shap.discount", 9).alias("discount"),
    )


@query
def tree_shap_deep(spark, folder):
    """Three features, one of them tested again and again on one way."""
    tree = attribution.tree_of(data.DEEP_TREE, 0.7)[0]
    rows = data.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *data.DEEP_FEATURES.values())
    explained = attribution.tree_shap(rows, [tree], {name: F.col(c) for name, c in data.DEEP_FEATURES.items()})
    return explained.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[(F.round(f"shap.{name}", 9) + 0.0).alias(name) for name in data.DEEP_FEATURES]
    )


# --- model -------------------------------------------------------------------

_PARAMS = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3, "balanced": True}


def _customer_features(spark, folder):
    rows = cut_lineage(data.unified_customers(spark, folder))
    valid = yearly.valid_days(rows, "year", data.order_holidays(spark, folder))
    features = yearly.attendance_features(rows, valid, "year").select(_student().alias("studentid"), "*").drop(*data.ENROLMENT)
    scores = ["urgent_score", "low_score"]
    clean = cleaning.fill_exam_scores(cleaning.fill_strings(features, ["nation", "segment"]), scores)
    return cut_lineage(cleaning.fill_float_means(clean, ["balance"]))


def _fit(spark, folder):
    features = _customer_features(spark, folder)
    train, val = sampling.stratified_split(features, "target", "studentid", 0.7, 7)
    categorical, numerical = cleaning.split_features(features, "studentid", "target")
    return model.train(train, val, "target", "studentid", categorical, numerical, _PARAMS), features


def _categories(spark, folder):
    rows = data.unified_customers(spark, folder)
    return rows.select(_student().alias("studentid"), "target", "nation", "segment")


@query
def category_means(spark, folder):
    """Categories of rows to be scored, by the means of all training rows."""
    rows = cut_lineage(_categories(spark, folder))
    means = encoding.fit_category_means(rows, ["nation", "segment"], "target", smoothing=2.0)
    numbers = [F.round(f"number_{c}", 9).alias(f"number_{c}") for c in ("nation", "segment")]
    return means.transform(rows, "number_").select("studentid", *numbers)


@query
def category_means_ordered(spark, folder):
    """Categories of training rows, each by the rows before it."""
    rows = cut_lineage(_categories(spark, folder))
    found = encoding.ordered_numbers(rows, ["nation", "segment"], "target", "studentid", seed=3)
    return found.select("studentid", *[F.round(c, 9).alias(f"number_{c}") for c in ("nation", "segment")])


@query
def class_weights(spark, folder):
    """Each kind's weights, as the rows that a fit would see them."""
    rows = cut_lineage(_categories(spark, folder))
    kinds = {"Balanced": "balanced", "SqrtBalanced": "root"}
    for kind, name in kinds.items():
        rows = model.with_weights(rows, "target", model.class_weights(rows, "target", kind)).withColumnRenamed("__weight", name)
    return rows.select("studentid", *[F.round(name, 9).alias(name) for name in kinds.values()])


@query
def train_score(spark, folder):
    fitted, features = _fit(spark, folder)
    return fitted.model.transform(features).select("studentid", "target", v.PROBA_0, v.PROBA_1, v.PREDICTION)


@query
def model_checks(spark, folder):
    """What must hold for each row that a saved and loaded model scores."""
    fitted, features = _fit(spark, folder)
    path = _scratch(spark)
    fitted.model.save(path)
    loaded = model.EwsModel.load(path)
    ours = fitted.model.transform(features).select("studentid", *[F.col(c).alias(f"a_{c}") for c in (v.PROBA_0, v.PROBA_1, v.PREDICTION)])
    both = loaded.transform(features).join(ours, "studentid")
    one, p = F.col(v.PROBA_1), F.col(v.PREDICTION)
    return both.select(
        "studentid",
        F.col("target").cast("int").alias("target"),
        (F.abs(one + F.col(v.PROBA_0) - 1) < 1e-12).alias("sums_to_one"),
        one.between(0.0, 1.0).alias("a_probability"),
        (p == (one >= F.lit(loaded.threshold)).cast("int")).alias("follows_threshold"),
        ((one == F.col(f"a_{v.PROBA_1}")) & (p == F.col(f"a_{v.PREDICTION}"))).alias("same_when_loaded"),
    )


def _stump_rows(spark, folder):
    """Orders with features of two values, so that a tree on one of them is one split that SQL can follow."""
    return cut_lineage(
        data.table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("label"),
            ((F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") != "O")).cast("double").alias("large"),
            (F.col("o_orderstatus") != "O").cast("double").alias("closed"),
            (F.col("o_orderkey") % 10 >= 7).alias("validation"),
        )
    )


def _stump_parts(spark, folder):
    rows = _stump_rows(spark, folder)
    return [rows.filter(part).drop("validation") for part in (~F.col("validation"), F.col("validation"))]


@query
def stump_score(spark, folder):
    """A pipeline with one tree of one split, fitted, saved, loaded and applied: scores, calibration and threshold by number."""
    rows = _stump_rows(spark, folder)
    stump = estimator.EarlyWarningClassifier(
        numerical=["large"], labelCol="label", idCol="id", treeParams={"maxIter": 1, "maxDepth": 1, "seed": 1}
    )
    path = _scratch(spark)
    Pipeline(stages=[stump]).fit(rows).write().save(path)
    scored = PipelineModel.load(path).transform(rows)
    return scored.select("id", "label", *[F.round(c, 9).alias(c) for c in (v.PROBA_0, v.PROBA_1)], v.PREDICTION)


@query
def stump_losses(spark, folder):
    """Losses after each of three boosted splits, fitted with class weights."""
    train, val = _stump_parts(spark, folder)
    params = {"maxIter": 3, "maxDepth": 1, "stepSize": 0.3, "seed": 1, "validationTol": 0.0, "balanced": True}
    fitted = model.fit_classifier(train, val, "label", [], ["closed"], params)
    losses = model.loss_table(fitted, train, val, "label")
    return losses.select("iteration", *[F.round(c, 9).alias(c) for c in ("trn", "val")])


@query
def stump_search(spark, folder):
    """The log of a search whose spaces hold one value each: what is drawn, what is not, and the area that decides."""
    train, val = _stump_parts(spark, folder)
    only = {"low": 0.3, "high": 0.3}
    tune = {
        "independent": {
            "maxDepth": {"dtype": "int", "tuning_space": {"low": 1, "high": 1}},
            "impurity": {"dtype": "categorical", "tuning_space": {"choices": ["variance"]}},
        },
        "dependent": {
            "stepSize": {"dependent_on_param": "impurity", "dependent_on_value": ["variance"], "dtype": "float", "tuning_space": only},
            "subsamplingRate": {"dependent_on_param": "impurity", "dependent_on_value": ["other"], "dtype": "float", "tuning_space": only},
        },
    }
    log = model.random_search(train, val, "label", [], ["large"], {"maxIter": 1, "seed": 1}, tune, 2, seed=1)[1]
    drawn = [F.col("params")[p].alias(p) for p in ("maxIter", "maxDepth", "impurity", "stepSize", "subsamplingRate")]
    return log.select("trial", *drawn, F.round("score", 9).alias("score"))


@query
def attribution_checks(spark, folder):
    """Attributions and base value of each row sum to the trees' margin."""
    fitted, features = _fit(spark, folder)
    path = _scratch(spark)
    fitted.model.save(path)
    loaded = model.EwsModel.load(path)
    margin = (2 * vector_to_array("__margin")[1]).alias("margin")
    margins = loaded.classifier.transform(features).select("studentid", margin)
    base = attribution.model_trees(loaded, path)[1]
    values = attribution.shap_values(loaded, features, path)
    total = sum((F.col("shap").getField(c) for c in loaded.features), F.lit(base))
    return values.select("studentid", total.alias("total")).join(margins, "studentid").select(
        "studentid", (F.abs(F.col("total") - F.col("margin")) < 1e-9).alias("adds_up")
    )


@query
def loss_table(spark, folder):
    return _fit(spark, folder)[0].losses


@query
def random_search(spark, folder):
    features = _customer_features(spark, folder)
    train, val = sampling.stratified_split(features, "target", "studentid", 0.7, 7)
    categorical, numerical = cleaning.split_features(features, "studentid", "target")
    tune = {
        "independent": {
            "maxDepth": {"dtype": "int", "tuning_space": {"low": 2, "high": 3}},
            "impurity": {"dtype": "categorical", "tuning_space": {"choices": ["variance"]}},
        },
        "dependent": {
            "subsamplingRate": {
                "dependent_on_param": "impurity", "dependent_on_value": ["variance"], "dtype": "float",
                "tuning_space": {"low": 0.5, "high": 1.0},
            }
        },
    }
    return model.random_search(train, val, "target", categorical, numerical, {"maxIter": 2}, tune, 2, seed=1, id="studentid")[1]


@query
def explain_e2e(spark, folder):
    fitted, features = _fit(spark, folder)
    path = f"{use_checkpoint_dir(spark)}/models/{uuid.uuid4()}"
    fitted.model.save(path)
    groups = {
        "place": ["nation"],
        "trade": ["segment", "balance", "urgent_score", "low_score"],
        "attendance": [f for f in fitted.model.numerical if f.startswith(("full_", "binary_"))],
    }
    scored = fitted.model.transform(features)
    return explain(scored, path, groups, threshold=fitted.model.threshold)
