"""Column expressions that spell out how missing values behave.

The feature definitions treat a missing value as "not equal to anything", "not greater than
anything" and "zero in a sum".  SQL's three-valued logic differs in each of those places, so every
rule that depends on it goes through one of the helpers below.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

YES, NO, UNKNOWN = "YES", "NO", "UNKNOWN"

# Texts read as "missing" when a delimited file is loaded.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yes_no(flag: Column) -> Column:
    """'YES' where the flag is true, 'NO' where it is false or missing."""
    return F.when(flag, F.lit(YES)).otherwise(F.lit(NO))


def true_or_zero(flag: Column) -> Column:
    """1 where the flag is true, 0 where it is false or missing."""
    return F.coalesce(flag, F.lit(False)).cast("int")


def any_eq(c: str | Column, value: Any) -> Column:
    """Aggregate: does any row of the group equal the value?"""
    return yes_no(F.bool_or(as_col(c) == F.lit(value)))


def any_in(c: str | Column, values: list[Any]) -> Column:
    return yes_no(F.bool_or(as_col(c).isin(values)))


def any_ne(c: str | Column, value: Any) -> Column:
    """Aggregate: does any row differ from the value?  A missing row does."""
    return yes_no(F.bool_or(~as_col(c).eqNullSafe(F.lit(value))))


def any_gt(a: str | Column, b: str | Column) -> Column:
    """Aggregate: is a above b in any row where both are present?"""
    return yes_no(F.bool_or(as_col(a) > as_col(b)))


def nsum(c: str | Column) -> Column:
    """Aggregate sum that is 0, not null, when every value is missing."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def varied(c: str | Column) -> Column:
    """Aggregate: more than one distinct value, counting 'missing' as a value of its own.

    Works from min, max and two flags instead of a distinct count: the state is constant in size,
    so the map-side combine collapses a hot group and no row expansion takes place.
    """
    x = as_col(c)
    several = F.coalesce(F.min(x) != F.max(x), F.lit(False))
    mixed = F.bool_or(x.isNull()) & F.bool_or(x.isNotNull())
    return yes_no(several | mixed)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is 0 (an infinity would break every scaler downstream)."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def row_sum(cols: list[str]) -> Column:
    """Sum across columns; a missing cell adds 0."""
    return reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_mean(cols: list[str]) -> Column:
    """Mean across the columns that are present; null when none is."""
    present = reduce(add, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(row_sum(cols), present.cast("double"))


def row_any(flags: list[Column]) -> Column:
    return reduce(or_, [F.coalesce(f, F.lit(False)) for f in flags])


def cap_above(c: str, limit: float) -> Column:
    """Replace values over the limit by the limit; a missing value stays missing."""
    return F.when(F.col(c) > limit, F.lit(limit)).otherwise(F.col(c))


def raise_to(c: str, limit: float) -> Column:
    """Replace values under the limit by the limit; a missing value stays missing."""
    return F.when(F.col(c) < limit, F.lit(limit)).otherwise(F.col(c))


def keep_unless(df: DataFrame, *conditions: Column) -> DataFrame:
    """Drop rows where a condition is true; rows where it is missing stay."""
    return df.filter(~row_any(list(conditions)))


def set_where(df: DataFrame, condition: Column, values: dict[str, Any]) -> DataFrame:
    """Masked update: write the values where the condition is true, keep the rest.

    All masks and values are evaluated on the incoming columns.  Columns absent from the frame are
    skipped, so one rule set serves narrower inputs too.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    updates = {}
    for name, value in values.items():
        if name in types:
            new = value if isinstance(value, Column) else F.lit(value)
            updates[name] = F.when(condition, new.cast(types[name])).otherwise(F.col(name))
    return df.withColumns(updates) if updates else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN cells null in every floating column, as NaN sorts and averages differently."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def columns_named(df: DataFrame, starts: tuple[str, ...] = (), ends: tuple[str, ...] = ()) -> list[str]:
    """Columns whose name starts or ends with one of the given texts."""
    return [c for c in df.columns if (starts and c.startswith(starts)) or (ends and c.endswith(ends))]
