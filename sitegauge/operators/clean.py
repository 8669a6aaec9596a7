"""Value-level cleaning and encoding (PRJ-4..8, 13..25)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scalar import col
from sitegauge.operators.ranges import numbered



def coerce(df: DataFrame, numeric: Sequence[str] = (), dates: Sequence[str] = (), pattern: str = "dd/MM/yyyy") -> DataFrame:
    """Type text columns; values that do not parse become null."""
    typed = {c: F.expr(f"try_cast(trim({c}) AS DOUBLE)") for c in numeric}
    typed |= {c: F.expr(f"cast(try_to_timestamp(trim({c}), '{pattern}') AS DATE)") for c in dates}
    return df.withColumns(typed)


def coercion_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values per column that were present and became null; both frames must come from one read."""
    raw = before.agg(*[F.count(c).alias(c) for c in columns])
    typed = after.agg(*[F.count(c).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', {c}" for c in columns)
    raw = raw.select(F.expr(f"stack({len(columns)}, {stack}) AS (column, present)"))
    typed = typed.select(F.expr(f"stack({len(columns)}, {stack}) AS (column, parsed)"))
    return raw.join(typed, "column").withColumn("newly_null", F.col("present") - F.col("parsed"))


def clean_text(c: str | Column, case: str | None = None) -> Column:
    out = F.trim(F.regexp_replace(col(c), r"[\r\n]+", " "))
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(case, lambda v: v)(out)


def strip_control(c: str | Column) -> Column:
    """Control and non-breaking characters to spaces, runs of spaces to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[\x00-\x1F\x7F ]", " "), r" +", " "))


def strip_parentheses(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[()]", "")


def first_number(c: str | Column) -> Column:
    return _number(F.regexp_extract(col(c), r"(-?\d+(?:\.\d+)?)", 1))


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("double"))


def max_number(c: str | Column) -> Column:
    """Largest number in the text: '132/33kV' gives 132."""
    found = F.regexp_extract_all(col(c), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_max(F.transform(found, lambda v: v.cast("double")))


def percent_ratio(c: str | Column) -> Column:
    return _number(F.regexp_extract(col(c), r"(-?\d+(?:\.\d+)?)\s*%", 1)) / 100


def band_midpoint(c: str | Column) -> Column:
    """Middle of an 'a-b%' band, as a percentage."""
    pattern = r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)"
    return (_number(F.regexp_extract(col(c), pattern, 1)) + _number(F.regexp_extract(col(c), pattern, 2))) / 2


def grade_digit(c: str | Column) -> Column:
    return _number(F.regexp_extract(col(c), r"(\d)", 1)).cast("int")


def area_code(c: str | Column) -> Column:
    found = F.regexp_extract(col(c), r"(E\d{8})", 1)
    return F.when(found != "", found)


# Organisational words dropped from authority names before they are matched.
ORGANISATION_WORDS = r"\b(metropolitan|borough|district|county|city|council|london|unitary|authority|of|the)\b"


def reconcile_name(c: str | Column) -> Column:
    """Join key for an organisation name: organisational words off, letters and digits kept."""
    bare = F.regexp_replace(F.lower(col(c)), ORGANISATION_WORDS, "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def infinite_to_null(c: Column) -> Column:
    return F.when(F.abs(c) == float("inf"), None).otherwise(F.when(~F.isnan(c), c))


def fill_sentinels(df: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    """Infinities and NaN to null on doubles, then the per-column fill."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    df = df.withColumns({c: infinite_to_null(F.col(c)) for c in fill if c in doubles})
    return df.na.fill({c: v for c, v in fill.items()})


def plausible_coordinates(df: DataFrame, x: str = "x", y: str = "y", floor: float = 1000.0) -> DataFrame:
    return df.filter((F.col(x) > floor) & (F.col(y) > floor))


def named_cohorts(df: DataFrame, cohorts: Mapping[str, str], aggs: Mapping[str, str]) -> DataFrame:
    """Metrics for each named predicate, in one pass: one row per cohort."""
    names = list(aggs)
    measured = df.agg(*[
        F.expr(aggs[a].replace("$cohort", f"({p})")).alias(f"{n}__{a}") for n, p in cohorts.items() for a in names
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("cohort"), *[F.col(f"{n}__{a}").alias(a) for a in names]) for n in cohorts
    ])
    return measured.select(F.explode(rows).alias("r")).select("r.*")


def golden_cohort(df: DataFrame, rules: Mapping[str, tuple[str, list[Column]]], id: str) -> DataFrame:
    """One row per rule: the first row by the rule's order among those its predicate keeps."""
    picked = None
    for name, (predicate, order) in rules.items():
        one = df.filter(F.expr(predicate)).orderBy(*order, F.col(id)).limit(1).withColumn("rule", F.lit(name))
        picked = one if picked is None else picked.unionByName(one)
    return picked


def reclassify(sources: Sequence[Column], mapping: Mapping[str, str], default: str) -> Column:
    """Super-class of the first source column whose value is mapped."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(*[F.element_at(table, s) for s in sources], F.lit(default))


def row_hash_id(parts: Sequence[Column], salt: str) -> Column:
    """Salted SHA-256 of the parts joined by '|'; give numbers through ``fixed_text``."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)


def fixed_text(c: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("NULL"))


def expand_scenarios(df: DataFrame, values: Sequence[float], name: str = "scenario_mw") -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def code_map(df: DataFrame, columns: Sequence[str], missing: str = "missing") -> DataFrame:
    """(column, value, code): codes count from 0 in alphabetical order within each column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value"))
        for c in columns
    ])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return numbered(values, ["column"], ["value"], "code").withColumn("code", F.col("code").cast("int"))


def encode_ordinal(df: DataFrame, columns: Sequence[str], missing: str = "missing") -> DataFrame:
    codes = code_map(df, columns, missing).persist()
    for c in columns:
        one = codes.filter(F.col("column") == c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"{c}_code"))
        value = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        df = df.join(one, value == F.col(f"_{c}"), "left").drop(f"_{c}")
    return df


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None, max_cardinality: int | None = None,
            synonyms: Mapping[str, str] | None = None) -> DataFrame:
    """0/1 columns per category. Without a list of them ``max_cardinality`` must be set: a column with more is dropped."""
    if categories is None and max_cardinality is None:
        raise ValueError("one_hot needs categories or max_cardinality")
    value = F.col(column)
    for old, new in (synonyms or {}).items():
        value = F.when(F.col(column) == old, new).otherwise(value)
    if categories is None:
        distinct = df.select(column).distinct().dropna()
        found = [r[0] for r in distinct.limit(max_cardinality + 1).collect()]
        if len(found) > max_cardinality:
            return df.drop(column)
        categories = sorted(found)
    from sitegauge.operators.shape import snake

    return df.withColumns({
        f"{column}_{snake(str(c))}": F.coalesce((value == c).cast("int"), F.lit(0)) for c in categories
    }).drop(column)


def select_by_nearest_source(df: DataFrame, distances: Mapping[str, str], columns: Mapping[str, Mapping[str, str]],
                             limit: float = 5000.0) -> DataFrame:
    """Take each output column from the source whose valid distance is smallest.

    distances   source -> distance column; below 0 or above the limit is invalid
    columns     output -> {source -> input column}
    """
    valid = F.array(*[
        F.struct(F.when(F.col(d).between(0, limit), F.col(d)).alias("d"), F.lit(s).alias("s"))
        for s, d in distances.items()
    ])
    best = F.array_min(F.filter(valid, lambda v: v["d"].isNotNull()))
    df = df.withColumns({"source": best["s"], "source_m": best["d"]})
    picked = {}
    for out, inputs in columns.items():
        expr = F.lit(None)
        for s, c in inputs.items():
            expr = F.when(F.col("source") == s, F.col(c)).otherwise(expr)
        picked[out] = expr
    return df.withColumns(picked)
