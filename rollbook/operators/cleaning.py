"""Cleaning of the unified table, each step usable alone.

The order matters to the result and is the one `preprocess` uses: names, first row per
id, column check, casts, status recoding, exam attendance, fills, filters.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import vocabulary as v
from rollbook.functions.ordering import cut_lineage
from rollbook.functions.text import null_if_nan
from rollbook.sources import contract as contracts

# Up to this many ids with copies are sent to every executor (some 20 MB).
BROADCAST_IDS = 500_000


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case all column names; two names that become equal are an error."""
    names = [c.lower() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names differ only in case: {twice}")
    return df.toDF(*names)


def first_of_copies(df: DataFrame, id: str, order_key: str) -> DataFrame:
    """(id, smallest order key, rows that have it) of the ids that occur more than once, written to the checkpoint folder.

    Null keys come first, as in any ascending order. Reads two columns only. Rows are counted by id and key first, which
    spreads an id with very many rows; what is left of an id collapses before the second shuffle.
    """
    own, key = F.col(f"`{id}`").alias("__id"), F.col(f"`{order_key}`").alias("__key")
    counted = df.groupBy(own, key).agg(F.count(F.lit(1)).alias("__n"))
    # Keys that are not null compare by themselves; a null one says so in front.
    first = F.min(F.struct(F.col("__key").isNotNull().alias("there"), F.col("__key").alias("key"), F.col("__n").alias("n")))
    copies = counted.groupBy("__id").agg(first.alias("__first"), F.sum("__n").alias("__rows"))
    return cut_lineage(
        copies.filter(F.col("__rows") > 1).select(
            "__id", F.col("__first.key").alias("__first"), F.col("__first.n").alias("__tied"), F.lit(True).alias("__copied")
        )
    )


def drop_copies(df: DataFrame, firsts: DataFrame, id: str, order_key: str) -> DataFrame:
    """Keep the rows of ids that occur once, and of the others the one in `firsts`.

    With few such ids the rows stay where they are and are only filtered; with many of them an ordinary join takes over,
    whose frequent ids Spark splits. Where several rows of an id have the smallest key, the one with the least hash over
    all columns stays; only these rows are moved, and they meet in a minimum.
    """
    known, tied = firsts.agg(F.count(F.lit(1)), F.count_if(F.col("__tied") > 1)).first()
    if known == 0:
        return df
    side = F.broadcast(firsts) if known <= BROADCAST_IDS else firsts
    joined = df.join(side, F.col(f"`{id}`").eqNullSafe(F.col("__id")), "left")
    own = [F.col(f"`{c}`") for c in df.columns]
    first = F.col(f"`{order_key}`").eqNullSafe(F.col("__first"))
    kept = joined.filter(F.col("__copied").isNull() | (first & (F.col("__tied") == 1))).select(*own)
    if not tied:
        return kept
    rows = joined.filter(F.col("__copied") & first & (F.col("__tied") > 1)).select("__id", F.struct(*own).alias("__row"))
    chosen = rows.groupBy("__id").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
    return kept.unionByName(chosen.select(*[F.col("__row").getField(c).alias(c) for c in df.columns]))


def dedup_first(df: DataFrame, id: str, order_key: str) -> DataFrame:
    """Keep one row per id: that with the smallest `order_key`, null before all others; of rows that tie there the one
    with the least hash over all columns."""
    return drop_copies(df, first_of_copies(df, id, order_key), id, order_key)


def cast_to_contract(df: DataFrame, contract: Mapping[str, list]) -> DataFrame:
    """Cast by contract; order: columns without a type, strings, floats, ints."""
    typed = {t: [c for c, e in contract.items() if e[0] == t and c in df.columns] for t in contracts.SPARK_TYPES}
    named = {c for cols in typed.values() for c in cols}
    kinds = {v.STRING: "string", v.FLOAT: "double", v.INT: "bigint"}
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in named],
        *[
            (null_if_nan(F.col(f"`{c}`").cast("double")) if t == v.FLOAT else F.col(f"`{c}`").cast(kinds[t])).alias(c)
            for t in (v.STRING, v.FLOAT, v.INT)
            for c in typed[t]
        ],
    )


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace values found in `mapping`; others pass through."""
    result = None
    by_status: dict[str, list[str]] = {}
    for raw, status in mapping.items():
        by_status.setdefault(status, []).append(raw)
    for status, raws in by_status.items():
        hit = value.isin(raws)
        result = F.when(hit, status) if result is None else result.when(hit, status)
    return value if result is None else result.otherwise(value)


def recode_status(df: DataFrame, cols: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    """Recode the given status columns."""
    return df.withColumns({c: recode(F.col(f"`{c}`"), mapping) for c in cols})


def exam_attendance(score: Column) -> Column:
    """Missing without a score, present with a positive one, else absent."""
    clean = null_if_nan(score.cast("double"))
    return F.when(clean.isNull(), v.MISSING).when(clean > 0, v.PRESENT).otherwise(v.ABSENT)


def rectify_exam_attendance(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Derive each `<x>_attnd` whose `<x>_score` is present."""
    pairs = {c: c.replace("attnd", "score") for c in cols}
    return df.withColumns(
        {c: exam_attendance(F.col(f"`{s}`")) for c, s in pairs.items() if s in df.columns}
    )


def fill_exam_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scores without a value become 0."""
    return df.withColumns({c: F.coalesce(null_if_nan(F.col(f"`{c}`")), F.lit(0.0)) for c in cols})


def fill_status(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Day statuses without a value become missing."""
    return df.fillna(v.MISSING, list(cols)) if cols else df


def fill_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Other text without a value becomes the word `nan`."""
    return df.fillna("nan", list(cols)) if cols else df


def float_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Means of the given columns over their values, in one pass; NaN counts as no value."""
    if not cols:
        return {}
    row = df.agg(*[F.avg(null_if_nan(F.col(f"`{c}`"))).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def fill_float_means(
    df: DataFrame, cols: Sequence[str], means: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Numbers without a value become the column mean, or the given one."""
    means = float_means(df, cols) if means is None else means
    return df.withColumns(
        {
            c: F.coalesce(null_if_nan(F.col(f"`{c}`")), F.lit(means[c]).cast("double"))
            for c in cols
        }
    )


def apply_filters(df: DataFrame, filters: Mapping[str, Mapping[str, Sequence]] | None) -> DataFrame:
    """Keep rows by the `in` lists and drop rows by the `notin` lists; unknown columns are skipped."""
    for mode, lists in (filters or {}).items():
        if mode not in ("in", "notin"):
            raise ValueError(f"filters are 'in' or 'notin', not '{mode}'")
        for name, values in lists.items():
            if name in df.columns:
                hit = F.coalesce(F.col(f"`{name}`").isin(list(values)), F.lit(False))
                df = df.filter(hit if mode == "in" else ~hit)
    return df


def drop_columns(
    df: DataFrame, names: Iterable[str] | None, groups: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Drop columns by group name or by own name (a group wins); unknown names are skipped."""
    groups, gone = groups or {}, set()
    for name in names or ():
        gone.update(groups.get(name, [name]))
    return df.drop(*[c for c in df.columns if c in gone])


def split_features(df: DataFrame, index: str | None = v.INDEX, label: str | None = v.LABEL) -> tuple[list[str], list[str]]:
    """Categorical (string) and numerical (double) feature columns, without index and label."""
    fields = [f for f in df.schema.fields if f.name not in (index, label)]
    return (
        [f.name for f in fields if isinstance(f.dataType, T.StringType)],
        [f.name for f in fields if isinstance(f.dataType, T.DoubleType)],
    )


def _quality_terms(
    df: DataFrame, contract: Mapping[str, list], label: str | None, statuses: Mapping[str, str] | None
) -> dict[tuple[str, str], Column]:
    """(column, check) -> whether a row fails it."""
    known = set(statuses or {}) | set(v.STATUSES)
    groups = contracts.column_groups(contract)
    terms: dict[tuple[str, str], Column] = {}
    kinds = {v.STRING: "string", v.FLOAT: "double", v.INT: "bigint"}
    for name, entry in contract.items():
        if name not in df.columns:
            continue
        value = F.col(f"`{name}`")
        is_number = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
        empty = value.isNull() | F.isnan(value) if is_number else value.isNull()
        terms[name, "null"] = empty
        if entry[0] != v.STRING:
            terms[name, "bad_cast"] = ~empty & value.try_cast(kinds[entry[0]]).isNull()
        if name in groups.get(v.GROUP_DAYS, ()):
            terms[name, "unknown_status"] = ~value.cast("string").isin(sorted(known))
        if name == label:
            number = value.try_cast("double")
            terms[name, "bad_label"] = ~empty & (number.isNull() | ~number.isin(0.0, 1.0))
    return terms


def quality_report(
    df: DataFrame,
    contract: Mapping[str, list],
    id: str = v.INDEX,
    label: str | None = v.LABEL,
    statuses: Mapping[str, str] | None = None,
) -> DataFrame:
    """Counts of what would stop or distort the cleaning, as rows (column, check, n).

    Checks: `null`, `bad_cast`, `unknown_status`, `bad_label` and, for the id column,
    `duplicate_ids` (ids that occur more than once). One aggregate over the columns
    plus one grouping by id. `QualityWatch` counts the same while a table is cleaned.
    """
    terms = _quality_terms(df, contract, label, statuses)
    counted = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"), F.lit(check).alias("check"), F.count_if(bad).alias("n")
                )
                for (name, check), bad in terms.items()
            ]
        ).alias("rows")
    ).select(F.inline("rows"))
    copies = (
        df.groupBy(F.col(f"`{id}`").alias("id"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .agg(F.count_if(F.col("rows") > 1).alias("n"))
        .select(F.lit(id).alias("column"), F.lit("duplicate_ids").alias("check"), "n")
    )
    return counted.unionByName(copies)


class QualityWatch:
    """The counts of `quality_report`, taken from the pass that writes the cleaned rows.

    Give it to `preprocess` as `watch`, run one action on the cleaned table (write it, say), then ask for the `report`:
    nothing is read a second time. Rows count as they come in, copies and filtered rows included.
    """

    def __init__(self) -> None:
        self._observation = Observation()
        self._names: list[tuple[str, str]] = []
        self._copies: tuple[str, DataFrame] | None = None

    def attach(
        self, df: DataFrame, contract: Mapping[str, list], id: str, label: str | None, statuses: Mapping[str, str], copies: DataFrame
    ) -> DataFrame:
        """`df`, watched; `copies` has a row for each id that occurs more than once."""
        terms = _quality_terms(df, contract, label, statuses)
        self._names, self._copies = list(terms), (id, copies)
        return df.observe(self._observation, *[F.count_if(bad).alias(f"n{i}") for i, bad in enumerate(terms.values())])

    def report(self) -> DataFrame:
        """Rows (column, check, n); waits for the first action on the watched table."""
        if self._copies is None:
            raise ValueError("the watch is not attached to a table")
        id, copies = self._copies
        counts = self._observation.get
        rows = [(name, check, counts[f"n{i}"]) for i, (name, check) in enumerate(self._names)]
        rows.append((id, "duplicate_ids", copies.count()))
        return copies.sparkSession.createDataFrame(rows, "column string, check string, n bigint")


def preprocess(
    df: DataFrame,
    contract: Mapping[str, list],
    statuses: Mapping[str, str],
    order_key: str,
    filters: Mapping[str, Mapping[str, Sequence]] | None = None,
    index: str = v.INDEX,
    label: str | None = v.LABEL,
    means: Mapping[str, float | None] | None = None,
    keep_order: str | None = None,
    watch: QualityWatch | None = None,
) -> tuple[DataFrame, dict[str, list[str]], dict[str, float | None]]:
    """Clean the unified table; returns it with its column groups and the means it used.

    `order_key` (best unique and never null) says which rows come first; it is dropped unless the
    contract lists it, and `keep_order` names a column to keep its values in. The means
    are those of this table (before the filters) unless `means` brings others. With a `watch`
    the pass over the rows counts their flaws, too.
    """
    problems = contracts.check_contract(contract, label or v.LABEL)
    if problems:
        raise ValueError("contract: " + "; ".join(problems))
    df = lower_names(df)
    order_key = order_key.lower()
    payload = df if order_key in contract else df.drop(order_key)
    narrowed, groups = contracts.check_columns(payload, contract, {index, label})
    floats = [c for c, e in narrowed.items() if e[0] == v.FLOAT]
    scores = groups.get(v.GROUP_SCORES, [])
    days = groups.get(v.GROUP_DAYS, [])
    averaged = [c for c in floats if c not in scores]
    given, firsts = df, first_of_copies(df, index, order_key)
    df = drop_copies(given, firsts, index, order_key)
    if means is None:
        # Reads the columns that need a mean and the two that tell copies apart.
        means = float_means(cast_to_contract(df, {c: narrowed[c] for c in averaged}), averaged)
    if watch is not None:
        df = drop_copies(watch.attach(given, narrowed, index, label, statuses, firsts), firsts, index, order_key)
    if keep_order is not None:
        df = df.withColumn(keep_order, F.col(order_key))
    if order_key not in contract:
        df = df.drop(order_key)
    df = cast_to_contract(df, narrowed)
    df = recode_status(df, days, statuses)
    df = rectify_exam_attendance(df, groups.get(v.GROUP_EXAM_ATTENDANCE, []))
    df = fill_exam_scores(df, scores)
    df = fill_status(df, days)
    df = fill_strings(df, [c for c, e in narrowed.items() if e[0] == v.STRING and c not in days])
    df = fill_float_means(df, averaged, means)
    return apply_filters(df, filters), groups, dict(means)
