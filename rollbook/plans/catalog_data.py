"""The driver's tables in the roles the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import enrolment, sequence
from rollbook.sources import calendar

# What a row of the unified customer table stands for.
ENROLMENT = ["o_custkey", "year"]

# Which event types mean what; `signup` is left out on purpose and passes through.
EVENT_MEANING = {"present": ["click", "view", "purchase"], "absent": ["error"], "missing": ["nan"]}

# A fixed tree of depth four over (quantity, discount, tax), with quantity tested up to three times on one way.
DEEP_FEATURES = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
_INNER = [(0, 200, 1, 2, 0, 25.0), (1, 90, 3, 4, 1, 0.05), (2, 110, 5, 6, 2, 0.04), (3, 50, 7, 8, 0, 10.0), (5, 70, 9, 10, 1, 0.03), (7, 20, 11, 12, 0, 4.0), (9, 30, 13, 14, 0, 40.0)]
_LEAVES = [(4, 40, 1.5), (6, 40, -2.0), (8, 30, 0.5), (10, 40, 3.0), (11, 5, -1.0), (12, 15, 2.0), (13, 12, 0.25), (14, 18, -0.75)]
DEEP_TREE = [
    *[dict(id=i, prediction=0.0, cover=float(c), left=a, right=b, feature=f, threshold=t) for i, c, a, b, f, t in _INNER],
    *[dict(id=i, prediction=p, cover=float(c), left=-1, right=-1, feature=-1, threshold=None) for i, c, p in _LEAVES],
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_marks(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, month, day, status): an event is a present mark, an `error` event an absent one."""
    return table(spark, folder, "events").select(
        "user_id",
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.when(F.col("event_type") == "error", "a").otherwise("p").alias("status"),
    )


def event_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.build_sequence(event_marks(spark, folder), "user_id")


def sundays(spark: SparkSession, folder: str) -> DataFrame:
    """Holidays of the events' year: the Sundays they fall on."""
    ts = F.col("ts")
    return (
        table(spark, folder, "events")
        .filter(F.dayofweek(ts) == 1)
        .select(
            calendar.year_name(calendar.year_start(ts)).alias("acad_year"),
            F.month(ts).alias("month"),
            F.dayofmonth(ts).alias("day"),
        )
        .distinct()
    )


def order_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Order days per customer and academic year; failed orders count as absent."""
    date = F.col("o_orderdate")
    return (
        table(spark, folder, "orders")
        .select(
            "o_custkey",
            calendar.year_start(date).alias("year"),
            F.month(date).alias("month"),
            F.dayofmonth(date).alias("day"),
            F.when(F.col("o_orderstatus") == "F", "a").otherwise("p").alias("status"),
        )
    )


def order_holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Holidays of each academic year of the orders: the Sundays and the 25ths that they fall on."""
    date = F.col("o_orderdate")
    return (
        table(spark, folder, "orders")
        .filter((F.dayofweek(date) == 1) | (F.dayofmonth(date) == 25))
        .select(
            calendar.year_name(calendar.year_start(date)).alias("acad_year"),
            F.month(date).alias("month"),
            F.dayofmonth(date).alias("day"),
        )
        .distinct()
    )


def order_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.build_sequence(order_marks(spark, folder), ENROLMENT)


def scored_orders(spark: SparkSession, folder: str, digits: int | None = None) -> DataFrame:
    """(id, score, label): the price as score, a finished order as label; `digits` makes ties."""
    score = F.col("o_totalprice") / 500000
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (score if digits is None else F.round(score, digits)).alias("score"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


def enrolments(spark: SparkSession, folder: str) -> DataFrame:
    """(o_custkey, year): the academic years in which a customer ordered."""
    date = F.col("o_orderdate")
    return (
        table(spark, folder, "orders")
        .select("o_custkey", calendar.year_start(date).alias("year"))
    )


def dropouts(spark: SparkSession, folder: str) -> DataFrame:
    return enrolment.dropout_label(enrolments(spark, folder), "o_custkey", "year")


def line_values(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a row key and attribution values made from its numbers."""
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.struct(
            (F.col("l_discount") - 0.05).alias("discount"),
            (F.col("l_tax") - 0.04).alias("tax"),
            ((F.col("l_quantity") - 25) / 100).alias("quantity"),
            (F.col("l_extendedprice") / 100000 - 0.5).alias("price"),
        ).alias("shap"),
        F.col("l_discount").alias("preds_proba_1"),
    )


LINE_GROUPS = {"terms": ["discount", "tax"], "size": ["quantity"], "money": ["price"]}


def customer_contract() -> dict[str, list]:
    """Contract of the unified customer table below."""
    return {
        "studentid": ["string", "customer"],
        "target": ["int", "ordered nothing in the next year"],
        "nation": ["string", "nation", "place"],
        "segment": ["string", "market segment", "trade"],
        "balance": ["float", "account balance", "trade"],
        **{f"{month}_1": ["string", "orders on the first of a month", "all_attendances"] for month in range(1, 13)},
        "urgent_score": ["float", "highest price of an urgent order", "exam_score_subwise"],
        "urgent_attnd": ["string", "derived from the price", "exam_attnd_subwise"],
        "low_score": ["float", "highest price of a low-priority order", "exam_score_subwise"],
        "low_attnd": ["string", "derived from the price", "exam_attnd_subwise"],
    }


def unified_customers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and year with an order, with label, static columns, scores and `days`."""
    labels = dropouts(spark, folder)
    exams = enrolment.exams_wide(
        table(spark, folder, "orders")
        .withColumn("year", calendar.year_start(F.col("o_orderdate")))
        .withColumn(
            "subject",
            F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "5-LOW", "low"),
        ),
        ENROLMENT,
        "subject",
        "o_totalprice",
        ["urgent", "low"],
    )
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    enrol = (
        labels.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            *ENROLMENT,
            "target",
            F.col("n_name").alias("nation"),
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        )
    )
    return enrolment.unify(enrol, order_sequences(spark, folder), exams, ENROLMENT)
