"""The column contract: name -> [type, description, group?], and checks against it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import vocabulary as v

SPARK_TYPES = {v.STRING: T.StringType(), v.INT: T.LongType(), v.FLOAT: T.DoubleType()}

# Rule per column name; the first that matches applies.
_NAME_RULES = (
    (re.compile(v.DAY_COLUMN), v.STRING, v.GROUP_DAYS),
    (re.compile(r"_score$"), v.FLOAT, v.GROUP_SCORES),
    (re.compile(r"_agg_attnd$"), v.FLOAT, v.GROUP_MONTH_ATTENDANCE),
    (re.compile(r"_attnd$"), v.STRING, v.GROUP_EXAM_ATTENDANCE),
)


def check_contract(contract: Mapping[str, list], label: str = v.LABEL) -> list[str]:
    """Every breach of the contract's rules, in words; empty when there is none."""
    problems = []
    if label not in contract:
        problems.append(f"label column '{label}' is missing")
    elif contract[label] and contract[label][0] != v.INT:
        problems.append(f"label column '{label}' must be of type '{v.INT}'")
    for name, entry in contract.items():
        if not isinstance(entry, (list, tuple)) or not 2 <= len(entry) <= 3:
            problems.append(f"'{name}': an entry holds type, description and at most a group")
            continue
        dtype, description = entry[0], entry[1]
        group = entry[2] if len(entry) == 3 else None
        own = []
        if dtype not in SPARK_TYPES:
            own.append(f"'{name}': type '{dtype}' is not one of {sorted(SPARK_TYPES)}")
        if not isinstance(description, str) or not description:
            own.append(f"'{name}': the description must be non-empty text")
        if not own:
            for pattern, wanted_type, wanted_group in _NAME_RULES:
                if pattern.search(name):
                    if dtype != wanted_type:
                        own.append(f"'{name}': type must be '{wanted_type}', not '{dtype}'")
                    if group != wanted_group:
                        own.append(f"'{name}': group must be '{wanted_group}', not '{group}'")
                    break
        problems.extend(own)
    return problems


def fingerprint(contract: Mapping[str, list]) -> str:
    """A hash of the contract's names, types and groups; descriptions do not count."""
    rules = sorted((name, entry[0], entry[2] if len(entry) > 2 else None) for name, entry in contract.items())
    return hashlib.sha256(json.dumps(rules).encode()).hexdigest()


def check_input(df: DataFrame, needed: Iterable[str]) -> None:
    """Stop if columns are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks features of the model: {missing}")


def contract_schema(contract: Mapping[str, list]) -> T.StructType:
    """The contract as a Spark schema; description and group travel as field metadata."""
    fields = []
    for name, entry in contract.items():
        notes = {"description": entry[1]}
        if len(entry) > 2 and entry[2]:
            notes["group"] = entry[2]
        fields.append(T.StructField(name, SPARK_TYPES[entry[0]], True, notes))
    return T.StructType(fields)


def column_groups(contract: Mapping[str, list] | T.StructType) -> dict[str, list[str]]:
    """Group name -> its columns, in contract order."""
    schema = contract if isinstance(contract, T.StructType) else contract_schema(contract)
    groups: dict[str, list[str]] = {}
    for field in schema.fields:
        group = (field.metadata or {}).get("group")
        if group:
            groups.setdefault(group, []).append(field.name)
    return groups


def check_columns(
    df: DataFrame, contract: Mapping[str, list], reserved: Iterable[str | None] = ()
) -> tuple[dict[str, list], dict[str, list[str]]]:
    """Fail on columns outside the contract or outside every group; narrow both to `df`."""
    present, kept_out = set(df.columns), set(reserved)
    unknown = sorted(present - set(contract))
    if unknown:
        raise ValueError(f"columns without a contract entry: {unknown}")
    groups = column_groups(contract)
    grouped = {name for members in groups.values() for name in members}
    loose = sorted(present - kept_out - grouped)
    if loose:
        raise ValueError(f"columns in no group: {loose}")
    return (
        {name: entry for name, entry in contract.items() if name in present},
        {
            group: [name for name in members if name in present and name not in kept_out]
            for group, members in groups.items()
        },
    )


def status_map(meaning: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Turn {present: [...], absent: [...], missing: [...]} into raw value -> status."""
    if set(meaning) != set(v.STATUS_NAMES):
        raise ValueError(f"expected exactly the keys {sorted(v.STATUS_NAMES)}, got {sorted(meaning)}")
    return {raw: v.STATUS_NAMES[name] for name, raws in meaning.items() for raw in raws}


def read_unified(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", contract: Mapping[str, list] | None = None, **options
) -> DataFrame:
    """Read unified tables; year and grade come from the path.

    The path of every file must hold `ay<yyyy>_grade<n>`, as the name of the file or of
    a folder above it. CSV columns are matched by the header and stay text; the
    contract's types are applied by the cleaning. With a `contract`, Parquet files whose columns differ (each year has
    day columns of its own) are read as one table: a column that some files lack is null there, one that no file has is
    left out, and one that the contract does not name is an error.
    """
    if fmt == "csv":
        options = {"header": True, **options}
    if contract is not None and fmt == "parquet":
        options = {"mergeSchema": True, **options}
    data = spark.read.format(fmt).options(**options).load(path if isinstance(path, str) else list(path))
    if contract is not None:
        known = {name.lower() for name in contract}
        unknown = [c for c in data.columns if c.lower() not in known]
        if unknown:
            raise ValueError(f"columns without a contract entry: {sorted(unknown)}")
    return with_year_and_grade(data, F.col("_metadata.file_path"))


def one_year(df: DataFrame, acad_year: str) -> DataFrame:
    """The rows of one academic year, without the columns `read_unified` added."""
    if "acad_year" not in df.columns:
        return df
    return df.filter(F.col("acad_year") == acad_year).drop("acad_year", "grade")


def with_year_and_grade(df: DataFrame, path: Column) -> DataFrame:
    """Add `acad_year` and `grade` found in `path`; a path without them is an error."""
    pattern = r"ay(\d{4})_grade(\d+)"
    year = F.regexp_extract(path, pattern, 1)
    return df.withColumns(
        {
            "acad_year": F.when(year != "", year).otherwise(
                F.raise_error(F.concat(F.lit("no academic year in "), path))
            ),
            "grade": F.regexp_extract(path, pattern, 2),
        }
    )
